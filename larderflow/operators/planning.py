"""Weekly proposals, plan edits and admission of whole weeks, as queries over customers (households), their orders (nights) and lines (plates)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.operators.relational import query, table
from larderflow.plans import edits, proposal, rules
from larderflow.sources.shared import written

# proposals: what a household has ordered are the recipes that it can cook

DISHES_SQL = """households AS (SELECT c_custkey AS household, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 6 END AS sessions, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 3 END AS max_new FROM customer),
lines AS (SELECT o_custkey AS household, l_partkey AS recipe, CAST(l_quantity AS BIGINT) AS q, l_discount, l_returnflag, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
recipes AS (SELECT household, recipe, p_name AS title, p_size % 2 = 0 AS friendly, NOT bool_or(l_returnflag = 'A') AS is_new,
  (CASE WHEN bool_or(l_discount >= 0.09) THEN 30 ELSE 0 END) + sum(CASE WHEN q = 50 THEN 20 WHEN q >= 45 THEN 5 ELSE 0 END) - (CASE WHEN max(l_shipdate) >= TIMESTAMP '1998-06-01' THEN 40 ELSE 0 END)
  + (CASE WHEN NOT bool_or(l_returnflag = 'A') THEN {novelty} ELSE 0 END) - (CASE WHEN recipe % 31 = 0 THEN 100 ELSE 0 END) AS score
  FROM lines JOIN part ON recipe = p_partkey WHERE p_size % 7 <> 0 GROUP BY household, recipe, p_name, p_size HAVING NOT bool_or(q = 1)),
urgent AS (SELECT o_custkey AS household, isodow(o_orderdate) - 1 AS night, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2),
kept AS (SELECT household, night, CASE o_orderstatus WHEN 'F' THEN 'cook' WHEN 'O' THEN 'out' ELSE 'leftover' END AS kind, CASE WHEN o_orderstatus <> 'O' THEN (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) END AS recipe
  FROM urgent JOIN orders USING (o_orderkey))"""

WEEK_SQL = """plan{n} AS (SELECT household, open_n, cooks, open_n - cooks AS rests, max_new FROM (
  SELECT h.household, max_new, 7 - count(k.night) AS open_n, greatest(0, least(coalesce(sessions, 4) - count(k.night) FILTER (WHERE kind = 'cook'), 7 - count(k.night))) AS cooks FROM households h LEFT JOIN kept k ON k.household = h.household GROUP BY h.household, sessions, max_new)),
r1{n} AS (SELECT r.*, cooks, rests, max_new, row_number() OVER (PARTITION BY r.household, friendly ORDER BY score DESC, title, recipe) AS f FROM {recipes} r JOIN plan{n} p ON p.household = r.household
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.household = r.household AND k.recipe = r.recipe)),
r2{n} AS (SELECT *, row_number() OVER (PARTITION BY household ORDER BY NOT (friendly AND f <= rests), score DESC, title, recipe) AS i FROM r1{n}),
r3{n} AS (SELECT *, sum(is_new::int) OVER (PARTITION BY household ORDER BY i) AS news FROM r2{n}),
r4{n} AS (SELECT *, row_number() OVER (PARTITION BY household ORDER BY i) AS place FROM r3{n} WHERE NOT is_new OR max_new IS NULL OR news <= max_new),
q{n} AS (SELECT household, list({{'recipe': recipe, 'friendly': friendly}} ORDER BY place) AS dishes FROM r4{n} WHERE place <= cooks GROUP BY household),
s{n} AS (SELECT p.household, open_n, coalesce(dishes, []) AS dishes FROM plan{n} p LEFT JOIN q{n} ON q{n}.household = p.household),
w{n} AS (
  SELECT household, -1 AS night, 0 AS used, 0 AS last, 0 AS served, open_n - len(dishes) AS rests, -1 AS since, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS recipe, CAST(NULL AS INTEGER) AS source, false AS kept FROM s{n}
  UNION ALL
  SELECT household, night, CASE WHEN cooks THEN used + 1 ELSE used END, CASE WHEN cooks THEN used + 1 WHEN again THEN last ELSE 0 END, CASE WHEN again THEN served + 1 ELSE 0 END, CASE WHEN again THEN rests - 1 ELSE rests END,
    CASE WHEN cooks THEN night WHEN again THEN since ELSE -1 END, CASE WHEN k_kind IS NOT NULL THEN k_kind WHEN again THEN 'leftover' WHEN cooks THEN 'cook' ELSE 'open' END,
    CASE WHEN k_kind IS NOT NULL THEN k_recipe WHEN again THEN dishes[last].recipe WHEN cooks THEN dishes[used + 1].recipe END, CASE WHEN again THEN since END, k_kind IS NOT NULL
  FROM (SELECT *, k_kind IS NULL AND NOT again AND used < len(dishes) AS cooks FROM (
    SELECT w.household, w.night + 1 AS night, used, last, served, rests, since, dishes, k.kind AS k_kind, k.recipe AS k_recipe,
      k.kind IS NULL AND last > 0 AND coalesce(dishes[last].friendly, false) AND served < CASE WHEN used >= len(dishes) THEN 2 ELSE 1 END AND rests > 0 AS again
    FROM w{n} w JOIN s{n} ON s{n}.household = w.household LEFT JOIN kept k ON k.household = w.household AND k.night = w.night + 1 WHERE w.night < 6)))"""


def _dishes(spark, d, variety):
    """households, recipes with scores without those of kept nights, kept nights with their orders."""
    orders, part = table(spark, d, "orders"), table(spark, d, "part")
    households = table(spark, d, "customer").select(F.col("c_custkey").alias("household"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 6).alias("sessions"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 3).alias("max_new"))
    kind = F.when(F.col("o_orderstatus") == "F", "cook").when(F.col("o_orderstatus") == "O", "out").otherwise("leftover")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("household"), F.weekday("o_orderdate").alias("night")).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("o")).select("household", "night", "o.*")
    kept = urgent.select("household", "night", kind.alias("kind"), "o_orderkey", (F.col("o_orderstatus") != "O").alias("at_home"))
    # a kept night's recipe is its order's least: known where lines meet their orders, so recipes are not looked for in kept nights afterwards
    owned = orders.select("o_orderkey", F.col("o_custkey").alias("household")).join(kept.filter("at_home").select("o_orderkey", "at_home"), "o_orderkey", "left")
    q = F.col("l_quantity").cast("bigint")
    # a line's answers as bits, yes and no apart (neither: unknown), so that there is little to carry and to hold for each recipe
    bits = {"interested": F.col("l_discount") >= 0.09, "recent": F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz"), "cooked": F.col("l_returnflag") == "A", "known": F.col("l_returnflag") != "A", "refused": q == 1, "eaten": q != 1, "held": None}
    bit = {name: 1 << i for i, name in enumerate(bits)}
    has = lambda name: F.col("bits").bitwiseAND(bit[name]) != 0
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("recipe"), reduce(Column.__add__, [F.when(c, bit[x]).otherwise(0) for x, c in bits.items() if c is not None]).alias("bits"), F.when(q == 50, 20).when(q >= 45, 5).otherwise(0).alias("points"))
    lines = lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("held", F.when(F.col("at_home") & (F.col("recipe") == F.min("recipe").over(Window.partitionBy("l_orderkey"))), bit["held"]).otherwise(0))
    told = lines.groupBy("household", "recipe").agg(F.bit_or(F.col("bits").bitwiseOR(F.col("held"))).alias("bits"), F.sum("points").alias("points")).filter(has("eaten") & ~has("refused") & ~has("held"))
    known = told.join(part.filter("p_size % 7 <> 0").select(F.col("p_partkey").alias("recipe"), F.col("p_name").alias("title"), (F.col("p_size") % 2 == 0).alias("friendly")), "recipe")
    known = known.withColumn("is_new", F.when(has("cooked"), False).when(has("known"), True))
    scored = known.withColumn("score", rules.score(has("interested"), F.col("points"), has("recent"), F.col("is_new"), F.col("recipe") % 31 == 0, variety))
    return households, scored.select("household", "recipe", "title", "score", "is_new", "friendly"), kept


@query("WITH RECURSIVE " + DISHES_SQL.format(novelty="15") + ",\n" + WEEK_SQL.format(n="", recipes="recipes") + "\nSELECT household, CAST(night AS INTEGER) AS night, kind, recipe, CAST(source AS INTEGER) AS source, kept FROM w WHERE night >= 0")
def k05_week_proposals(spark, d):
    """Seven nights for every household: cookings chosen by score under limits of sessions and new recipes, leftovers after those that suit, kept nights as they are."""
    households, recipes, kept = _dishes(spark, d, F.lit("adventurous"))
    least = table(spark, d, "lineitem").join(kept.filter("at_home").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("recipe"))
    return proposal.fresh_proposals(households, recipes, kept.join(least, "o_orderkey", "left"))


@query("""WITH RECURSIVE """ + DISHES_SQL.format(novelty="15") + """,
other AS (SELECT household, recipe, title, friendly, is_new, score - CASE WHEN is_new THEN 30 ELSE 0 END AS score FROM recipes),
""" + WEEK_SQL.format(n="1", recipes="other") + ",\n" + WEEK_SQL.format(n="2", recipes="recipes") + """,
t1 AS (SELECT household, night, kept, CASE kind WHEN 'cook' THEN coalesce(p_name, '?') WHEN 'leftover' THEN 'leftovers of ' || coalesce(p_name, '?') ELSE kind END AS was FROM w1 LEFT JOIN part ON p_partkey = recipe WHERE night >= 0),
t2 AS (SELECT household, night, kept, CASE kind WHEN 'cook' THEN coalesce(p_name, '?') WHEN 'leftover' THEN 'leftovers of ' || coalesce(p_name, '?') ELSE kind END AS now FROM w2 LEFT JOIN part ON p_partkey = recipe WHERE night >= 0)
SELECT household, CAST(night AS INTEGER) AS night, was, now FROM t1 JOIN t2 USING (household, night) WHERE NOT t2.kept AND was <> now""")
def k06_proposal_changes(spark, d):
    """What changes in every household's proposal if it asks for adventure instead of what it knows."""
    # a new recipe has 15 with adventure and -15 with what is known
    return proposal.changes(*_dishes(spark, d, F.lit("adventurous")), before=-30, after=0)


# plans: a household's latest order of a weekday is that night's assignment

PLAN_SQL = """kinds AS (SELECT o_custkey AS household, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS night, o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'out' WHEN o_orderstatus = 'F' THEN 'cook' WHEN o_orderstatus = 'O' THEN 'leftover' ELSE 'open' END AS kind,
  o_orderpriority = '1-URGENT' AS locked, o_orderkey % 5 AS revision, row_number() OVER (PARTITION BY o_custkey, isodow(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest,
  row_number() OVER (PARTITION BY o_custkey, isodow(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS oldest FROM orders),
latest AS (SELECT *, max(CASE WHEN kind = 'cook' THEN night * 10000000000 + id END) OVER (PARTITION BY household ORDER BY night ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 10000000000 AS before FROM kinds WHERE newest = 1),
assignments AS (SELECT household, night, id, kind, CASE kind WHEN 'cook' THEN id WHEN 'leftover' THEN before END AS event, locked, revision FROM latest),
events AS (SELECT household, id AS event, CASE WHEN kind = 'cook' THEN 'scheduled' ELSE 'deferred' END AS status, CASE WHEN kind = 'cook' THEN night END AS cook_night, revision + 1 AS revision FROM latest WHERE kind IN ('cook', 'open')),
plates AS (SELECT DISTINCT household, l_orderkey AS event, l_linenumber % 2 + 1 AS member, CASE WHEN l_returnflag = 'R' THEN 'lunch' ELSE 'dinner' END AS meal, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS night FROM lineitem JOIN events ON event = l_orderkey WHERE status = 'scheduled')"""


def _plan(spark, d):
    """assignments (with the oldest order of the night beside the newest), events, plates."""
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 11 == 0, "out").when(F.col("o_orderstatus") == "F", "cook").when(F.col("o_orderstatus") == "O", "leftover").otherwise("open")
    row = F.struct(F.col("o_orderkey").alias("id"), kind.alias("kind"), (F.col("o_orderpriority") == "1-URGENT").alias("locked"), (F.col("o_orderkey") % 5).alias("revision"))
    at = F.struct("o_orderdate", "o_orderkey")
    days = o.groupBy(F.col("o_custkey").alias("household"), F.weekday("o_orderdate").alias("night")).agg(F.max_by(row, at).alias("x"), F.min_by(row, at).alias("first"))
    # seven nights at most: the cooking before each
    before = F.last(F.when(F.col("kind") == "cook", F.col("id")), ignorenulls=True).over(Window.partitionBy("household").orderBy("night").rowsBetween(Window.unboundedPreceding, -1))
    latest = days.select("household", "night", "x.*", "first").withColumn("before", before)
    assignments = written(latest.select("household", "night", "id", "kind", F.when(F.col("kind") == "cook", F.col("id")).when(F.col("kind") == "leftover", F.col("before")).alias("event"), "locked", "revision", "first"), "assignments")
    cooked = F.col("kind") == "cook"
    events = assignments.filter("kind in ('cook', 'open')").select("household", F.col("id").alias("event"), F.when(cooked, "scheduled").otherwise("deferred").alias("status"), F.when(cooked, F.col("night")).alias("cook_night"), (F.col("revision") + 1).alias("revision"))
    lines = table(spark, d, "lineitem").join(events.filter("status = 'scheduled'").select("household", "event"), F.col("l_orderkey") == F.col("event"))
    plates = lines.select("household", "event", (F.col("l_linenumber") % 2 + 1).cast("bigint").alias("member"), F.when(F.col("l_returnflag") == "R", "lunch").otherwise("dinner").alias("meal"), F.weekday("l_shipdate").alias("night")).distinct()
    return assignments, events, plates


ADMISSION_SQL = """WITH """ + PLAN_SQL + """,
members AS (SELECT c_custkey AS household, unnest(range(1, 2 + c_custkey % 2 + 1)) AS member FROM customer),
accepted AS (SELECT household, night, kind, CASE WHEN kind = 'cook' THEN id END AS event, locked, id FROM kinds WHERE oldest = 1),
content AS (SELECT a.household, a.night, a.kind, a.event, a.id = c.id AS kept FROM assignments a JOIN accepted c ON c.household = a.household AND c.night = a.night),
cookings AS (SELECT e.household, e.event, e.cook_night, (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = e.event) AS recipe, e.event % 2 = 0 AS is_new FROM events e WHERE status = 'scheduled'),
checks AS (SELECT p_partkey AS recipe, CASE WHEN p_size % 10 = 0 THEN 'violated' WHEN p_size % 10 = 1 THEN 'unknown' ELSE 'ok' END AS status FROM part),
dinners AS (SELECT n.*, c.cook_night FROM content n LEFT JOIN cookings c ON c.household = n.household AND c.event = n.event WHERE kind IN ('cook', 'leftover')),
problems AS (
  SELECT m.household, 'no_dinner' AS code, n.night, NULL::BIGINT AS subject FROM (SELECT DISTINCT household FROM members) m, range(7) n(night) WHERE NOT EXISTS (SELECT 1 FROM content c WHERE c.household = m.household AND c.night = n.night AND kind <> 'open')
  UNION ALL SELECT household, 'no_cooking', night, NULL FROM dinners WHERE cook_night IS NULL
  UNION ALL SELECT household, 'other_night', night, NULL FROM dinners WHERE kind = 'cook' AND cook_night <> night
  UNION ALL SELECT household, 'too_early', night, NULL FROM dinners WHERE kind = 'leftover' AND night <= cook_night
  UNION ALL SELECT s.household, 'no_plate', s.night, m.member FROM dinners s JOIN members m ON m.household = s.household WHERE cook_night IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM plates p WHERE p.household = s.household AND p.event = s.event AND p.night = s.night AND p.member = m.member AND meal = 'dinner')
  UNION ALL SELECT p.household, 'lunch_too_early', p.night, p.member FROM plates p JOIN cookings c ON c.household = p.household AND c.event = p.event WHERE meal = 'lunch' AND p.night <= cook_night
  UNION ALL SELECT p.household, 'not_served', p.night, p.member FROM plates p JOIN cookings c ON c.household = p.household AND c.event = p.event LEFT JOIN content n ON n.household = p.household AND n.night = p.night WHERE meal = 'dinner' AND n.event IS DISTINCT FROM p.event
  UNION ALL SELECT a.household, 'lock_broken', a.night, NULL FROM accepted a LEFT JOIN content n ON n.household = a.household AND n.night = a.night WHERE locked AND (NOT coalesce(n.kept, false) OR n.kind IS DISTINCT FROM a.kind OR n.event IS DISTINCT FROM a.event)
  UNION ALL SELECT household, status, NULL, c.recipe FROM cookings c JOIN checks k ON k.recipe = c.recipe WHERE is_new AND status <> 'ok')
SELECT DISTINCT household, code, CAST(night AS INTEGER) AS night, subject FROM problems"""


@query(ADMISSION_SQL)
def k08_admission(spark, d):
    """Why each household's week cannot be adopted: nights without dinner, cookings on other nights, members without a plate, broken locks, failed checks."""
    assignments, events, plates = _plan(spark, d)
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("household"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2) + F.col("c_custkey") % 2)).alias("member"))
    accepted = assignments.select("household", "night", "first.kind", F.when(F.col("first.kind") == "cook", F.col("first.id")).alias("event"), "first.locked")
    content = assignments.select("household", "night", "kind", "event", (F.col("id") == F.col("first.id")).alias("kept"))
    scheduled = events.filter("status = 'scheduled'")
    least = table(spark, d, "lineitem").join(scheduled.select(F.col("event").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("event")).agg(F.min("l_partkey").alias("recipe"))
    cookings = scheduled.join(least, "event", "left").select("household", "event", "recipe", "cook_night", (F.col("event") % 2 == 0).alias("is_new"))
    size = F.col("p_size") % 10
    checks = table(spark, d, "part").select(F.col("p_partkey").alias("recipe"), F.when(size == 0, "violated").when(size == 1, "unknown").otherwise("ok").alias("status"))
    # recipes are checked for everyone; admission() looks them up by household
    checks = cookings.select("household", "recipe").distinct().join(checks, "recipe")
    return proposal.admission(content, cookings, plates, accepted, members, checks)


OPS_SQL = """ops AS (SELECT c_custkey AS op, c_custkey AS household, ['replace', 'backup', 'move', 'place', 'set_kind', 'plate'][c_custkey % 6 + 1] AS type, CAST(c_custkey // 6 % 7 AS INTEGER) AS night, CAST(c_custkey // 6 * 3 % 7 AS INTEGER) AS to_night,
  (SELECT CASE WHEN c_custkey % 6 = 3 THEN min(event) FILTER (WHERE status = 'deferred') ELSE min(event) FILTER (WHERE status = 'scheduled') END FROM events e WHERE e.household = c_custkey) AS event,
  CASE WHEN c_custkey % 17 <> 0 THEN c_custkey END AS recipe, c_custkey % 4 < 3 AS friendly, CASE WHEN c_custkey % 19 = 0 THEN 'violated' WHEN c_custkey % 23 = 0 THEN 'unknown' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 8 < 2 THEN 'open' WHEN c_custkey % 8 < 4 THEN 'follow' END AS leftovers, CASE WHEN c_custkey % 5 < 3 THEN 'out' ELSE 'open' END AS new_kind, c_custkey // 6 % 2 + 1 AS member, CASE WHEN c_custkey % 9 < 3 THEN 'lunch' ELSE 'dinner' END AS meal, c_custkey % 7 < 3 AS remove FROM customer)"""

EDIT_SQL = "WITH RECURSIVE " + PLAN_SQL + ",\n" + OPS_SQL + """,
x AS (SELECT o.* EXCLUDE (event), t.id AS t_id, t.kind AS t_kind, t.event AS t_event, t.locked AS t_locked, g.id AS d_id, g.kind AS d_kind, g.locked AS d_locked, e.event AS e_id, e.status AS e_status, e.cook_night AS e_night, e.revision AS e_revision
  FROM ops o LEFT JOIN assignments t ON t.household = o.household AND t.night = o.night AND type <> 'place' LEFT JOIN assignments g ON g.household = o.household AND g.night = o.to_night
  LEFT JOIN events e ON e.household = o.household AND e.event = CASE WHEN type IN ('place', 'plate') THEN o.event ELSE t.event END),
y AS (SELECT *, coalesce(CASE type WHEN 'move' THEN t_kind = 'cook' AND d_id IS NOT NULL AND e_id IS NOT NULL WHEN 'place' THEN e_status = 'deferred' AND d_id IS NOT NULL WHEN 'set_kind' THEN t_id IS NOT NULL WHEN 'plate' THEN e_status = 'scheduled' AND e_night IS NOT NULL
    ELSE t_id IS NOT NULL AND recipe IS NOT NULL END, false) AS found, type IN ('replace', 'backup') AS swaps, type = 'replace' AND friendly AND coalesce(leftovers = 'follow', true) AS follows,
  coalesce(t_kind = 'cook' AND e_id IS NOT NULL, false) AS cooks, coalesce(t_kind = 'leftover' AND e_id IS NOT NULL, false) AS eats FROM x),
ok AS (SELECT * FROM y WHERE found),
deps AS (SELECT ok.*, a.id AS dep, a.night AS dep_night, a.locked AS dep_locked FROM ok JOIN assignments a ON a.household = ok.household AND a.event = ok.e_id AND a.kind = 'leftover' WHERE cooks AND type IN ('replace', 'backup', 'move', 'set_kind')),
reached AS (
  SELECT op, household, 'a' AS what, t_id AS id FROM ok WHERE t_id IS NOT NULL AND (type <> 'plate' OR meal = 'dinner')
  UNION SELECT op, household, 'a', d_id FROM ok WHERE type IN ('move', 'place')
  UNION SELECT op, household, 'e', e_id FROM ok WHERE e_id IS NOT NULL
  UNION SELECT r.op, r.household, 'a', p.dep FROM reached r JOIN deps p ON r.what = 'e' AND p.op = r.op AND p.e_id = r.id),
early AS (SELECT * FROM deps WHERE type = 'move' AND dep_night <= to_night),
after_nights AS (
  SELECT op, t_id AS id, 'cook' AS kind, -op AS event FROM ok WHERE swaps UNION ALL SELECT op, t_id, 'open', NULL FROM ok WHERE type = 'move' UNION ALL SELECT op, d_id, 'cook', e_id FROM ok WHERE type IN ('move', 'place')
  UNION ALL SELECT op, t_id, new_kind, NULL FROM ok WHERE type = 'set_kind' UNION ALL SELECT op, dep, 'leftover', -op FROM deps WHERE swaps AND follows UNION ALL SELECT op, dep, 'open', NULL FROM deps WHERE swaps AND NOT follows OR type = 'set_kind' UNION ALL SELECT op, dep, 'open', NULL FROM early),
after_events AS (
  SELECT op, e_id AS event, CASE WHEN type = 'backup' AND cooks THEN 'deferred' WHEN type IN ('replace', 'set_kind') AND cooks THEN 'retired' WHEN type = 'place' THEN 'scheduled' ELSE e_status END AS status,
    CASE WHEN type = 'backup' AND cooks THEN NULL WHEN type IN ('move', 'place') THEN to_night ELSE e_night END AS cook_night, e_revision + 1 AS revision FROM ok WHERE e_id IS NOT NULL AND NOT (swaps AND NOT cooks AND NOT eats)
  UNION ALL SELECT op, -op, 'scheduled', night, 1 FROM ok WHERE swaps),
held AS (SELECT ok.*, p.member AS p_member, p.meal AS p_meal, p.night AS p_night, p.night = ok.night AS own, EXISTS (SELECT 1 FROM early y WHERE y.op = ok.op AND y.dep_night = p.night) AS gone,
  type = 'move' AND p.night = ok.night AND p.meal = 'dinner' AS moved FROM ok JOIN plates p ON p.household = ok.household AND p.event = ok.e_id),
after_plates AS (
  SELECT op, CASE WHEN swaps AND cooks THEN -op ELSE e_id END AS event, p_member AS member, p_meal AS meal, CASE WHEN moved THEN to_night ELSE p_night END AS night FROM held
  WHERE NOT (swaps AND cooks AND NOT (own OR follows)) AND NOT (swaps AND eats AND own) AND NOT (type = 'set_kind' AND (cooks OR eats AND own)) AND NOT (type = 'move' AND (gone AND NOT moved OR p_meal = 'lunch' AND p_night <= to_night))
    AND NOT (type = 'plate' AND remove AND own AND p_meal = meal AND p_member = member)
  UNION SELECT op, CASE WHEN swaps THEN -op ELSE e_id END, unnest([1, 2]), 'dinner', CASE WHEN swaps THEN night ELSE to_night END FROM ok WHERE swaps AND NOT cooks OR type = 'place'
  UNION SELECT op, e_id, member, meal, night FROM ok WHERE type = 'plate' AND NOT remove),
blockers AS (
  SELECT op, 'not_found' AS code, CASE WHEN type <> 'place' THEN night END AS night FROM y WHERE NOT found
  UNION SELECT op, 'locked', night FROM ok WHERE (type IN ('replace', 'backup', 'move', 'set_kind') OR type = 'plate' AND meal = 'dinner') AND t_locked
  UNION SELECT op, 'locked', to_night FROM ok WHERE type IN ('move', 'place') AND d_locked
  UNION SELECT op, 'destination_occupied', to_night FROM ok WHERE type IN ('move', 'place') AND d_kind IN ('cook', 'leftover')
  UNION SELECT op, 'invalid', night FROM ok WHERE type = 'backup' AND NOT cooks
  UNION SELECT op, 'invalid', night FROM ok WHERE type = 'plate' AND (night < e_night OR meal = 'dinner' AND t_event IS DISTINCT FROM e_id)
  UNION SELECT op, CASE status WHEN 'violated' THEN 'constraint_violation' ELSE 'constraint_unknown' END, CASE WHEN type <> 'place' THEN night END FROM ok WHERE status <> 'ok' AND (swaps OR type = 'place' OR type = 'plate' AND NOT remove
    AND NOT EXISTS (SELECT 1 FROM plates p WHERE p.household = ok.household AND p.event = ok.e_id AND p.member = ok.member AND p.meal = ok.meal AND p.night = ok.night))
  UNION SELECT op, 'locked_dependent', dep_night FROM deps WHERE type <> 'move' AND dep_locked UNION SELECT op, 'locked_dependent', dep_night FROM early WHERE dep_locked
  UNION SELECT p.op, 'invalid', p.night FROM after_plates p JOIN after_events e ON e.op = p.op AND e.event = p.event WHERE e.status = 'scheduled' AND (p.night < e.cook_night OR p.meal = 'lunch' AND p.night <= e.cook_night))
SELECT r.op, 'touches ' || r.what AS said, r.id AS subject, CAST(coalesce(a.revision, e.revision) AS VARCHAR) AS detail FROM reached r LEFT JOIN assignments a ON r.what = 'a' AND a.id = r.id LEFT JOIN events e ON r.what = 'e' AND e.event = r.id AND e.household = r.household
UNION ALL SELECT op, 'blocked', NULL, code || coalesce(' ' || night, '') FROM blockers
UNION ALL SELECT op, 'night', id, arg_max(kind || coalesce(' ' || event, ''), (kind = 'cook')::INT) FROM after_nights GROUP BY op, id
UNION ALL SELECT op, 'cooking', event, status || coalesce(' ' || cook_night, '') || ' ' || revision FROM after_events
UNION ALL SELECT op, 'plate', event, member || ' ' || meal || ' ' || night FROM after_plates"""


@query(EDIT_SQL)
def k09_plan_edits(spark, d):
    """One edit for every household, of six kinds: what each touches, why it is blocked, and the nights, cookings and plates that it would leave."""
    assignments, events, plates = _plan(spark, d)
    first = events.groupBy("household").agg(F.min(F.when(F.col("status") == "deferred", F.col("event"))).alias("deferred"), F.min(F.when(F.col("status") == "scheduled", F.col("event"))).alias("scheduled"))
    k = F.col("c_custkey")
    sixth = F.floor(k / 6)
    ops = table(spark, d, "customer").join(first, k == F.col("household"), "left").select(
        k.alias("op"), k.alias("household"), F.element_at(F.array(*(F.lit(x) for x in ("replace", "backup", "move", "place", "set_kind", "plate"))), (k % 6 + 1).cast("int")).alias("type"), (sixth % 7).cast("int").alias("night"), (sixth * 3 % 7).cast("int").alias("to_night"),
        F.when(k % 6 == 3, F.col("deferred")).otherwise(F.col("scheduled")).alias("event"), F.when(k % 17 != 0, k).alias("recipe"), (k % 4 < 3).alias("friendly"), F.when(k % 19 == 0, "violated").when(k % 23 == 0, "unknown").otherwise("ok").alias("status"),
        F.when(k % 8 < 2, "open").when(k % 8 < 4, "follow").alias("leftovers"), F.when(k % 5 < 3, "out").otherwise("open").alias("new_kind"), (sixth % 2 + 1).cast("bigint").alias("member"), F.when(k % 9 < 3, "lunch").otherwise("dinner").alias("meal"), (k % 7 < 3).alias("remove"),
        F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("people"),
    )
    out = edits.plan_edits(ops, assignments, events, plates)
    text = lambda c: F.col(c).cast("string")
    row = lambda df, what, subject, *parts: df.select("op", what.alias("said"), subject.cast("bigint").alias("subject"), F.concat_ws(" ", *parts).alias("detail"))
    parts: list[DataFrame] = [
        row(out["closure"], F.concat(F.lit("touches "), "what"), F.col("id"), text("revision")), row(out["blockers"], F.lit("blocked"), F.lit(None), "code", text("night")), row(out["assignments"], F.lit("night"), F.col("id"), "kind", text("event")),
        row(out["events"], F.lit("cooking"), F.col("event"), "status", text("cook_night"), text("revision")), row(out["plates"], F.lit("plate"), F.col("event"), text("member"), "meal", text("night")),
    ]
    return reduce(DataFrame.unionByName, parts)
