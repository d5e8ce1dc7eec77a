"""Demand, projection, checks, nutrition, coverage and the bodies of services over the driver's tables, each with SQL that computes the answer.

Customers are households, orders weeks or cycles and their lines what is asked for; service bodies are JSON made of each part's or line's values by SQL that
both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.operators.latest import placed
from larderflow.operators.relational import query, table
from larderflow.plans import coverage, demand, projection, rules
from larderflow.sources import files
from larderflow.sources.foods import effective_facts, foods, nutrients

FRACTION = "CASE WHEN {n} % {d} = 0 THEN CAST({n} // {d} AS VARCHAR) ELSE CAST({n} // gcd(CAST({n} AS HUGEINT), CAST({d} AS HUGEINT)) AS VARCHAR) || '/' || CAST({d} // gcd(CAST({n} AS HUGEINT), CAST({d} AS HUGEINT)) AS VARCHAR) END"

MEAL_SQL = f"""WITH portions AS (SELECT l_orderkey AS event, l_returnflag AS component, sum(CAST(l_quantity AS BIGINT)) AS quarters FROM lineitem GROUP BY 1, 2),
rows AS (SELECT p_brand || '-' || l_linenumber AS ingredient, CASE l_linenumber % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE CASE WHEN p_size % 2 = 0 THEN 'ml' ELSE 'clove' END END AS unit,
  CAST(p_size AS HUGEINT) * quarters * CASE l_linenumber % 3 WHEN 0 THEN 2834952312500 WHEN 1 THEN 1478676478125 ELSE CASE WHEN p_size % 2 = 0 THEN 23658823650000 ELSE 100000000000 END END AS n, l_linenumber > 2 AS exact
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN portions ON event = l_orderkey AND component = l_returnflag),
sums AS (SELECT ingredient, unit, sum(n) AS n, CAST(1200000000000 AS HUGEINT) AS d, bool_and(exact) AS exact, bool_or(exact) AS any_exact FROM rows GROUP BY 1, 2)
SELECT ingredient, CASE WHEN count(*) = 1 THEN any_value({FRACTION.format(n="n", d="d")}) END AS meal, CASE WHEN count(*) = 1 THEN any_value(unit) END AS unit,
  CASE WHEN count(*) > 1 THEN string_agg(unit, ',' ORDER BY unit) END AS conflict, bool_and(exact) AS exact, bool_or(any_exact) AS any_exact FROM sums GROUP BY ingredient"""


def _thirds(spark, d):
    """Recipe lines (event, component, ingredient, quantity in thirds, unit, exact) of every order, and its portions."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    size = F.col("p_size")
    unit = F.when(F.col("l_linenumber") % 3 == 0, "oz").when(F.col("l_linenumber") % 3 == 1, "Tbsp.").otherwise(F.when(size % 2 == 0, "cups").otherwise("clove"))
    rows = l.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("component"), F.concat_ws("-", "p_brand", F.col("l_linenumber").cast("string")).alias("ingredient"), F.concat(size.cast("string"), F.lit("/3")).alias("quantity"), unit.alias("unit"), (F.col("l_linenumber") > 2).alias("exact"))


def _quarters(spark, d):
    """event, component, portions: quarters as exact text; summed as whole numbers before they become text."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("component")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n"))
    return n.select("event", "component", F.concat(F.col("n").cast("string"), F.lit("/4")).alias("portions"))


@query(MEAL_SQL)
def d04_meal_sums(spark, d):
    """Demand over all events, exact, one row for each ingredient; units that cannot be added are a conflict."""
    out = demand.meal_lines(demand.event_demand(_thirds(spark, d), _quarters(spark, d), reduced=False).withColumn("cycle", F.lit("all")), ["cycle"])
    return out.select("ingredient", "meal", "unit", F.array_join("conflict", ",").alias("conflict"), "exact", "any_exact").withColumn("conflict", F.nullif("conflict", F.lit("")))


@query("""WITH ri AS (SELECT DISTINCT c_nationkey AS household, o_orderkey AS recipe, p_brand AS ingredient FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderkey % 5 = 0),
ing AS (SELECT p_brand AS ingredient, list(DISTINCT p_type) AS tags, count(*) % 7 <> 0 AS known FROM part GROUP BY 1),
ex AS (SELECT c_nationkey AS household, ['economy', 'brand#7', 'Promo', 'STANDARD'][c_nationkey % 4 + 1] AS term, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey % 3 END AS member FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey % 5 > 0),
groups AS (SELECT household, g, unnest(CASE g WHEN 'one' THEN [1] ELSE [1, 2] END) AS member FROM (SELECT DISTINCT household FROM ri), (VALUES ('one'), ('both')) v(g)),
applied AS (SELECT DISTINCT e.household, g.g, e.term FROM ex e JOIN groups g ON g.household = e.household AND (e.member IS NULL OR e.member = g.member)),
hits AS (SELECT DISTINCT ri.household, recipe, a.g, ri.ingredient || ' matches excluded ' || a.term AS hit FROM ri JOIN ing USING (ingredient) JOIN applied a ON a.household = ri.household AND (lower(ri.ingredient) = lower(a.term) OR list_contains(list_transform(tags, lambda t: lower(t)), lower(a.term)))),
gaps AS (SELECT household, recipe, list_sort(list(DISTINCT ingredient) FILTER (WHERE NOT known)) AS gaps FROM ri JOIN ing USING (ingredient) GROUP BY 1, 2)
SELECT r.household, r.recipe, g.g AS eaters, CASE WHEN NOT EXISTS (SELECT 1 FROM applied a WHERE a.household = r.household AND a.g = g.g) THEN 'ok' WHEN h.hits IS NOT NULL THEN 'violated' WHEN len(coalesce(gaps, [])) > 0 THEN 'unknown' ELSE 'ok' END AS status,
  CASE WHEN NOT EXISTS (SELECT 1 FROM applied a WHERE a.household = r.household AND a.g = g.g) THEN '' WHEN h.hits IS NOT NULL THEN array_to_string(h.hits, ',') ELSE coalesce(array_to_string(gaps, ','), '') END AS reasons
FROM gaps r JOIN (SELECT DISTINCT household, g FROM groups) g ON g.household = r.household LEFT JOIN (SELECT household, recipe, g, list_sort(list(hit)) AS hits FROM hits GROUP BY ALL) h ON h.household = r.household AND h.recipe = r.recipe AND h.g = g.g""")
def k04_constraints(spark, d):
    """Which recipes (orders) the eaters of a household (nation) can have: ok, violated or unknown, and why."""
    part = table(spark, d, "part")
    homes = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("household"))
    lines = table(spark, d, "lineitem").filter("l_orderkey % 5 = 0").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("ingredient"))
    ri = table(spark, d, "orders").join(homes, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("household", F.col("o_orderkey").alias("recipe"), "ingredient").distinct()
    ing = part.groupBy(F.col("p_brand").alias("ingredient")).agg(F.collect_set("p_type").alias("tags"), (F.count("*") % 7 != 0).alias("allergens_known")).withColumn("name", F.col("ingredient"))  # a row for each brand, with the few types
    h = F.col("household")
    nations = homes.select("household").distinct()
    ex = nations.filter(h % 5 > 0).select("household", F.element_at(F.array(*(F.lit(x) for x in ("economy", "brand#7", "Promo", "STANDARD"))), (h % 4 + 1).cast("int")).alias("term"), F.when(h % 3 > 0, h % 3).alias("member"))
    eaters = nations.select("household", F.explode(F.expr("array(named_struct('group', 'one', 'member', 1), named_struct('group', 'both', 'member', 1), named_struct('group', 'both', 'member', 2))")).alias("x")).select("household", "x.*")
    out = rules.check_recipes(ri, ing, ex, eaters)
    return out.select("household", "recipe", F.col("group").alias("eaters"), "status", F.array_join("reasons", ",").alias("reasons"))


_NUTRIENTS = {"calories": "p_size * 10 + 1", "protein_g": "CASE WHEN p_size % 11 <> 0 THEN p_size END", "carbs_g": "CAST(0 AS BIGINT)", "fat_g": "p_size % 4"}
_EACH = " UNION ALL ".join(f"SELECT plate, '{n}' AS nutrient, ingredient, CAST(q AS HUGEINT) * CAST(({v}) AS HUGEINT) AS n FROM amounts JOIN part ON p_partkey = ingredient" for n, v in _NUTRIENTS.items())


@query(f"""WITH amounts AS (SELECT l_orderkey AS plate, l_partkey AS ingredient, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2),
each AS ({_EACH}), sums AS (SELECT plate, nutrient, sum(n) AS n, count(*) FILTER (WHERE n IS NULL) AS gaps, string_agg(CASE WHEN n IS NULL THEN ingredient END, ',' ORDER BY CAST(ingredient AS VARCHAR)) AS missing FROM each GROUP BY 1, 2)
SELECT plate, nutrient, CASE WHEN gaps = 0 THEN {FRACTION.format(n="n", d="100")} END AS value, coalesce({FRACTION.format(n="n", d="100")}, '0') AS known, coalesce(missing, '') AS missing FROM sums""")
def k02_plate_nutrition(spark, d):
    """Every order's nutrients: unknown if any part's is, with what is known beside it."""
    amounts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plate"), F.col("l_partkey").cast("string").alias("ingredient")).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("string").alias("q"))
    facts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ingredient"), F.lit("100").alias("basis_qty"), *(F.expr(v).cast("string").alias(n) for n, v in _NUTRIENTS.items()))
    return rules.plate_nutrition(amounts, facts).withColumn("missing", F.array_join("missing", ","))


@query("""WITH days AS (SELECT o_custkey AS week, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS night, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1, 2),
kinds AS (SELECT week, night, id, CASE WHEN id % 9 = 0 THEN 'out' WHEN id % 9 = 1 THEN 'open' WHEN o_orderstatus = 'F' THEN 'cook' ELSE 'leftover' END AS kind FROM days JOIN orders ON o_orderkey = id),
a AS (SELECT *, CASE kind WHEN 'cook' THEN id WHEN 'leftover' THEN (SELECT min(k.id) FROM kinds k WHERE k.week = kinds.week AND k.kind = 'cook') END AS event FROM kinds),
e AS (SELECT id AS event, CASE WHEN id % 13 = 0 THEN 'retired' ELSE 'scheduled' END AS status, night AS cook_night FROM kinds WHERE kind = 'cook'),
p AS (SELECT a.event, a.night, count(*) AS plates FROM a JOIN lineitem ON l_orderkey = a.id WHERE a.event IS NOT NULL AND l_returnflag <> 'A' GROUP BY 1, 2),
o AS (SELECT event, event % 4 AS remaining, CAST(event % 7 AS INTEGER) AS seen FROM e WHERE event % 2 = 0),
s AS (SELECT p.event, p.night, sum(plates) OVER (PARTITION BY p.event ORDER BY p.night) > remaining AS short FROM p JOIN e USING (event) JOIN o USING (event) WHERE p.night > cook_night AND p.night >= seen),
r AS (SELECT a.week, a.night, kind, CASE WHEN kind = 'out' THEN NULL WHEN kind = 'open' THEN 'nothing planned' WHEN status IS DISTINCT FROM 'scheduled' THEN 'not scheduled' WHEN kind = 'leftover' AND a.night <= cook_night THEN 'leftover before its cooking'
  WHEN plates IS NULL THEN 'no dinner plates' WHEN coalesce(short, false) THEN 'leftovers run short' END AS reason FROM a LEFT JOIN e ON e.event = a.event LEFT JOIN p ON p.event = a.event AND p.night = a.night LEFT JOIN s ON s.event = a.event AND s.night = a.night),
n AS (SELECT week, night, CASE kind WHEN 'out' THEN 'out' WHEN 'open' THEN 'uncovered' ELSE CASE WHEN reason IS NULL THEN 'covered' ELSE 'unresolved' END END AS state, reason FROM r)
SELECT *, bool_and(state IN ('covered', 'out')) OVER (PARTITION BY week) AND count(*) OVER (PARTITION BY week) = 7 AS complete FROM n""")
def d23_week_coverage(spark, d):
    """Which nights of every household's week have their dinner, why others don't, and whether the week is complete."""
    o = table(spark, d, "orders")
    days = o.groupBy(F.col("o_custkey").alias("week"), F.weekday("o_orderdate").alias("night")).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("o")).select("week", "night", F.col("o.o_orderkey").alias("id"), "o.o_orderstatus")
    kind = F.when(F.col("id") % 9 == 0, "out").when(F.col("id") % 9 == 1, "open").when(F.col("o_orderstatus") == "F", "cook").otherwise("leftover")
    kinds = days.withColumn("kind", kind).withColumn("first", F.min(F.when(F.col("kind") == "cook", F.col("id"))).over(Window.partitionBy("week")))  # seven nights at most
    a = kinds.withColumn("event", F.when(F.col("kind") == "cook", F.col("id")).when(F.col("kind") == "leftover", F.col("first")))
    e = kinds.filter("kind = 'cook'").select(F.col("id").alias("event"), F.when(F.col("id") % 13 == 0, "retired").otherwise("scheduled").alias("status"), F.col("night").alias("cook_night"))
    p = a.filter("event is not null").join(table(spark, d, "lineitem").filter("l_returnflag <> 'A'").select("l_orderkey"), F.col("id") == F.col("l_orderkey")).select("event", "night")
    seen = e.filter("event % 2 = 0").select("event", (F.col("event") % 4).cast("int").alias("portions_remaining"), (F.col("event") % 7).cast("int").alias("observed_night"), F.lit(1).alias("observed_at"))
    nights = coverage.coverage(a.select("week", "night", "kind", "event"), e, p, seen)
    return nights.join(coverage.weeks_complete(nights), "week").select("week", "night", "state", "reason", "complete")


_BODY = """CASE p_partkey % 6 WHEN 5 THEN '{"data": [{"productId": ' ELSE '{"data":' || CASE WHEN p_partkey % 6 = 4 THEN '' ELSE '[' END || '{"productId":"' || p_partkey || '","brand":"' || p_brand || '","description":"' || p_name || '","items":['
  || CASE WHEN p_partkey % 6 = 3 THEN '' ELSE '{"size":"' || p_size || ' lb","soldBy":" unit ","price":{"regular":' || p_size || '.50,"promo":' || (p_size % 7) || '.25}},{"soldBy":"WEIGHT","price":{"regular":' || p_size || '.999}}' END
  || ']}' || CASE WHEN p_partkey % 6 = 4 THEN '' ELSE ',{"description":"without an id","items":[{}]}]' END || '}' END"""


@query("""WITH x AS (SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS s, p_partkey % 6 AS m, p_partkey % 2 = 0 AS here FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS ref, p_name AS name, s || ' lb' AS size, 'unit' AS basis, CASE WHEN NOT here THEN NULL WHEN s % 7 * 100 + 25 < s * 100 + 50 THEN s % 7 * 100 + 25 ELSE s * 100 + 50 END AS cents, here AND s % 7 * 100 + 25 < s * 100 + 50 AS promo FROM x WHERE m NOT IN (3, 5)
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, NULL, 'weight', NULL, false FROM x WHERE m NOT IN (3, 5)
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, NULL, 'unknown', NULL, false FROM x WHERE m = 3""")
def j07_products(spark, d):
    """Items of product bodies made of every part: lists and single products, without items, without an id, broken; a price only with a location."""
    bodies = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "here").alias("location"), F.expr(_BODY).alias("body"))
    out = files.products(bodies)
    return out.select(F.col("product_ref").alias("ref"), "name", "size", F.col("sale_basis").alias("basis"), F.col("price_minor").alias("cents"), F.col("on_promotion").alias("promo"))


_FOOD = """CASE p_partkey % 8 WHEN 7 THEN 'no json' WHEN 6 THEN '{"fdcId":' || p_partkey || ',"description":" ","dataType":"Branded"}' WHEN 5 THEN '{"fdcId":0,"description":"x","dataType":"Foundation"}' WHEN 4 THEN '{"fdcId":' || (p_partkey + 1) || ',"description":"x","dataType":"Own"}'
  ELSE '{"fdcId":' || (p_partkey + 1) || ',"description":"' || p_name || CASE WHEN p_size % 3 = 0 THEN ', raw' WHEN p_size % 3 = 1 THEN ' fried' ELSE '' END || '","dataType":"' || CASE WHEN p_partkey % 8 < 2 THEN 'Foundation' ELSE 'Branded' END
  || '","servingSize":' || p_size || ',"servingSizeUnit":"' || CASE WHEN p_partkey % 8 = 3 THEN 'ml' ELSE 'GRM' END || '","foodNutrients":[{"nutrient":{"number":"957","unitName":"KCAL"},"amount":1},{"nutrient":{"number":"958","unitName":"kcal"},"amount":' || p_size || '.50}'
  || ',{"nutrientNumber":"203","unitName":"G","value":' || p_size || '},{"number":"204","unitName":"mg","amount":3}],"foodPortions":[{"id":7,"gramWeight":' || p_size || ',"modifier":"diced","measureUnit":{"name":"Cup"}}]}' END"""


def _foods(spark, d):
    return foods(table(spark, d, "part").select("p_partkey", F.expr(_FOOD).alias("body")))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 7 THEN 'the food is not a JSON object' WHEN 6 THEN CASE WHEN p_partkey > 0 THEN 'description missing' END WHEN 5 THEN 'fdcId missing or not an integer' WHEN 4 THEN 'unsupported or missing data type' END AS reason,
  CASE WHEN p_partkey % 8 < 4 THEN CASE p_size % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'cooked' END END AS form, CAST(CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS portions FROM part""")
def a25_foods(spark, d):
    """Food bodies made of every part, normalised or refused with a reason."""
    return _foods(spark, d).select("p_partkey", "reason", F.when(F.col("reason").isNull(), F.col("form")).alias("form"), F.when(F.col("reason").isNull(), F.size("portions")).otherwise(0).alias("portions"))


_GOOD = "SELECT p_partkey + 1 AS food_id, CAST(p_size AS BIGINT) AS s, p_partkey % 8 <> 3 AS known FROM part WHERE p_partkey % 8 < 4"


@query(f"""WITH x AS ({_GOOD}) SELECT food_id, 'energy' AS nutrient, CASE WHEN known THEN s || '.5' END AS amount, 'kcal' AS unit, '958' AS number, CASE WHEN known THEN 'ok' ELSE 'missing' END AS status FROM x
UNION ALL SELECT food_id, 'protein', CASE WHEN known THEN s || '' END, 'g', '203', CASE WHEN known THEN 'ok' ELSE 'missing' END FROM x
UNION ALL SELECT food_id, 'fat', NULL, 'mg', '204', CASE WHEN known THEN 'bad_unit' ELSE 'missing' END FROM x UNION ALL SELECT food_id, 'carbs', NULL, NULL, NULL, 'missing' FROM x""")
def j05_nutrients(spark, d):
    """Every food's nutrients for 100 g: the first number with an amount, in its unit, or why there is none."""
    return nutrients(_foods(spark, d)).select("food_id", "nutrient", "amount", "unit", "number", "status")


_EFFECT = """, y AS (SELECT *, CASE food_id % 3 WHEN 0 THEN 'p7' WHEN 1 THEN 'serving' ELSE 'p8' END AS portion, food_id % 8 = 3 AS branded FROM x WHERE food_id % 5 > 0 UNION ALL SELECT *, NULL, food_id % 8 = 3 FROM x WHERE food_id % 5 = 0),
z AS (SELECT *, portion IS NULL OR portion = 'p7' OR portion = 'serving' AND branded AS there FROM y)"""


@query(f"""WITH x AS ({_GOOD}){_EFFECT} SELECT food_id, 'protein' AS nutrient, CASE WHEN NOT known THEN 'basis_unknown' WHEN NOT there THEN 'portion_unknown' END AS problem, CASE WHEN portion IS NOT NULL AND there AND (portion = 'p7' OR branded) THEN '1' ELSE '100' END AS basis_qty,
CASE WHEN portion = 'p7' THEN 'cup diced' WHEN portion = 'serving' AND branded THEN 'serving' ELSE 'g' END AS basis_unit, CASE WHEN known AND there THEN CASE WHEN portion IS NULL THEN s || '' ELSE (s * s // 100) || CASE WHEN s * s % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(s * s % 100 AS VARCHAR), 2, '0'), '0') END END END AS amount FROM z""")
def j06_effective_facts(spark, d):
    """Protein of every food for the portion that was chosen, for 100 g where none was; unknown stays unknown."""
    facts = nutrients(_foods(spark, d)).filter("nutrient = 'protein'")
    k = F.col("food_id")
    chosen = facts.filter(k % 5 > 0).select("food_id", F.when(k % 3 == 0, "p7").when(k % 3 == 1, "serving").otherwise("p8").alias("portion"))
    return effective_facts(facts, chosen)


@query(f"""WITH x AS ({_GOOD}) SELECT food_id, nutrient, CASE WHEN known THEN 'portion_unknown' ELSE 'basis_unknown' END AS problem FROM x, (VALUES ('energy'), ('protein'), ('fat'), ('carbs')) v(nutrient)""")
def j06_unknown_portion(spark, d):
    """A portion that a food doesn't have is an error for each of its nutrients, not 100 g."""
    facts = nutrients(_foods(spark, d))
    return effective_facts(facts, facts.select("food_id", F.lit("p8").alias("portion")).distinct()).select("food_id", "nutrient", "problem")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY lower(w), CASE WHEN lower(w) = w THEN 0 ELSE 1 END, c_custkey) AS place FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS w FROM customer)""")
def f07_locale_order(spark, d):
    """All customers in a reader's order of their segments, not that of code points: lower before upper case."""
    written_as = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return placed(table(spark, d, "customer").select("c_custkey", written_as.alias("w")), [F.collate("w", "UNICODE"), F.col("c_custkey")]).select("c_custkey", "place")


PROJECTION_SQL = """WITH m AS (SELECT l_orderkey AS cycle, l_partkey AS ingredient, sum(CAST(l_quantity AS BIGINT) * 100) AS meal, bool_or(l_linenumber = 7) AS conflict FROM lineitem GROUP BY 1, 2),
p AS (SELECT p_partkey, p_size % 9 > 0 AS has, CASE WHEN p_size % 7 > 0 THEN (p_size % 5 + 1) * 500 END AS pack, CASE WHEN p_size % 4 > 0 THEN p_size * 10 END AS price FROM part),
q AS (SELECT l_orderkey AS cycle, l_partkey AS ingredient, coalesce(max(CASE WHEN l_linenumber % 2 = 0 THEN coalesce(n, 1) END), 0) AS usual, coalesce(sum(CASE WHEN l_linenumber % 2 = 1 THEN coalesce(n, 1) END), 0) AS extra
  FROM (SELECT *, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS n FROM lineitem WHERE l_discount >= 0.05) GROUP BY 1, 2),
h AS (SELECT l_orderkey AS cycle, l_partkey AS ingredient, sum(1) AS ordered FROM lineitem WHERE l_tax >= 0.06 GROUP BY 1, 2),
v AS (SELECT l_orderkey AS cycle, l_partkey AS ingredient, max(l_linenumber) AS l FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
x AS (SELECT m.cycle, m.ingredient, CASE WHEN NOT conflict THEN meal END AS meal, conflict, has, CASE WHEN has THEN pack END AS pack, CASE WHEN has THEN price END AS price, coalesce(usual, 0) AS usual, coalesce(extra, 0) AS extra, coalesce(ordered, 0) AS ordered, v.l AS seen,
  CASE WHEN conflict OR v.l IS NULL THEN 0 WHEN v.l % 2 = 0 THEN least(v.l * 700, meal) ELSE CASE WHEN v.l * 1000 >= meal THEN meal ELSE v.l * 1000 END END AS home FROM m JOIN p ON p_partkey = ingredient LEFT JOIN q USING (cycle, ingredient) LEFT JOIN h USING (cycle, ingredient) LEFT JOIN v USING (cycle, ingredient)),
y AS (SELECT *, CASE WHEN NOT conflict AND pack IS NOT NULL THEN (greatest(meal - home, 0) + pack - 1) // pack END AS for_meal FROM x),
z AS (SELECT *, CASE WHEN for_meal IS NOT NULL THEN greatest(for_meal, usual) + extra END AS needed FROM y),
w AS (SELECT *, CASE WHEN needed IS NULL THEN NULL WHEN pack IS NOT NULL THEN (greatest(needed * pack - ordered * pack, 0) + pack - 1) // pack ELSE greatest(needed - ordered, 0) END AS to_send FROM z)
SELECT cycle, ingredient, CAST(to_send AS BIGINT) AS to_send, CASE WHEN to_send = 0 AND ordered > 0 THEN 'ordered' WHEN to_send = 0 THEN 'nothing_needed' ELSE 'needs_review' END AS status,
  concat_ws('; ', CASE WHEN conflict THEN 'units can''t be combined' END, CASE WHEN NOT has THEN 'no product chosen' END, CASE WHEN NOT conflict AND seen % 2 = 1 AND seen * 1000 < meal THEN 'need grew' END, CASE WHEN NOT conflict AND has AND pack IS NULL THEN 'package size unknown' END, CASE WHEN ordered > 0 AND pack IS NOT NULL THEN 'earlier package size unknown' END) AS issues,
  CAST(CASE WHEN to_send = 0 THEN 0 ELSE to_send * price END AS BIGINT) AS outstanding FROM w"""


@query(PROJECTION_SQL)
def k01_projection(spark, d):
    """From every cycle's demand, what is at home, products, requests and earlier orders to packages, status, issues and cost."""
    key = [F.col("l_orderkey").alias("cycle"), F.col("l_partkey").alias("ingredient")]
    l = table(spark, d, "lineitem")
    sums = l.groupBy(*key).agg(F.sum(F.col("l_quantity").cast("bigint") * 100).alias("meal"), F.bool_or(F.col("l_linenumber") == 7).alias("conflict"))
    meals = sums.select("cycle", "ingredient", F.when(~F.col("conflict"), F.col("meal").cast("string")).alias("meal"), F.when(~F.col("conflict"), "g").alias("unit"), F.when(F.col("conflict"), F.array(F.lit("g"), F.lit("ml"))).alias("conflict"), F.lit(True).alias("exact"), F.lit(True).alias("any_exact"))
    size = F.col("p_size")
    catalog = table(spark, d, "part").filter(size % 9 > 0).select(F.col("p_partkey").alias("ingredient"), F.col("p_partkey").cast("string").alias("product"), F.when(size % 7 > 0, ((size % 5 + 1) * 500).cast("string")).alias("package_qty"), F.when(size % 7 > 0, "g").alias("package_unit"), F.when(size % 4 > 0, size * 10).alias("price_minor"))
    products = sums.select("cycle", "ingredient").join(catalog, "ingredient").select("cycle", "ingredient", "product", "package_qty", "package_unit", "price_minor")
    n = F.col("l_linenumber")
    requests = l.filter("l_discount >= 0.05").select(*key, F.when(n % 2 == 0, "usual").otherwise("extra").alias("kind"), F.when(n > 1, n - 1).alias("packages"))
    seen = l.filter("l_returnflag = 'N'").groupBy(*key).agg(F.max("l_linenumber").alias("n"))
    some = F.col("n") % 2 == 0
    available = seen.select("cycle", "ingredient", F.when(some, "some").otherwise("enough").alias("state"), F.when(some, (F.col("n") * 700).cast("string")).alias("quantity"), F.lit("g").alias("avail_unit"), F.when(~some, (F.col("n") * 1000).cast("string")).alias("reviewed_exact"), F.lit(None).cast("string").alias("reviewed_demand"), F.when(~some, "g").alias("reviewed_unit"))
    bought = l.filter("l_tax >= 0.06").select(*key, F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("line"), F.lit(1).alias("packages"), F.lit(None).cast("string").alias("package_qty"), F.lit(None).cast("string").alias("package_unit"))
    none = spark.createDataFrame([], "line string, receipt string, corrects string, state string, packages int, suitable boolean, sub_qty string, sub_unit string")
    moved = spark.createDataFrame([], "cycle long, ingredient long, batch string, status string, reconciled boolean, packages int, package_qty string, package_unit string")
    past = projection.history(bought, none, moved, products)
    out = projection.project(meals, products, available, requests, past, spark.createDataFrame([], "cycle long, ingredient long, packages long"))
    return out.select("cycle", "ingredient", "to_send", "status", F.array_join("issues", "; ").alias("issues"), F.col("outstanding_minor").cast("bigint").alias("outstanding"))
