"""Prices, photos, staples, lists, components, bookmarks and reviews as queries that call the operators of plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderflow.operators.relational import query, table
from larderflow.plans import library, proposal


@query("""SELECT p_partkey, CASE WHEN promo > 0 AND (regular IS NULL OR promo < regular) THEN promo WHEN regular > 0 THEN regular END AS minor, CASE WHEN promo > 0 AND (regular IS NULL OR promo < regular) THEN true WHEN regular > 0 THEN false END AS promotion
FROM (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN CAST(round(p_retailprice) AS BIGINT) END AS regular, CASE WHEN p_size % 3 > 0 THEN CAST(p_size - 3 AS BIGINT) * 30 END AS promo FROM part)""")
def k20_best_prices(spark, d):
    """The price that counts for every part: a promotion only below the regular price."""
    size = F.col("p_size").cast("bigint")
    price = library.best_price(F.when(size % 5 > 0, F.round("p_retailprice").cast("bigint")), F.when(size % 3 > 0, (size - 3) * 30))
    return table(spark, d, "part").select("p_partkey", price.alias("p")).select("p_partkey", "p.minor", "p.promotion")


@query("""SELECT p_partkey, CASE WHEN m THEN p_partkey WHEN s THEN -p_partkey END AS image, CASE WHEN m THEN 'member' WHEN s THEN 'source' END AS kind,
CASE WHEN m THEN CASE WHEN p_size % 2 = 0 THEN 'Photo by ' || p_name ELSE 'Our photo' END WHEN s THEN CASE WHEN p_size % 5 > 1 THEN p_brand WHEN p_size % 5 = 1 THEN p_type ELSE 'Source photo' END END AS label
FROM (SELECT *, p_size % 3 = 0 AS m, p_partkey % 2 = 0 AS s FROM part)""")
def k22_recipe_photos(spark, d):
    """The photo of every recipe: a member's, else the source's, with whom it is from."""
    size, k = F.col("p_size"), F.col("p_partkey")
    chosen = library.photo(F.when(size % 3 == 0, k), F.when(size % 2 == 0, F.col("p_name")), F.when(k % 2 == 0, -k), F.when(size % 5 > 1, F.col("p_brand")).otherwise(""), F.when(size % 5 == 1, F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", chosen.alias("c")).select("p_partkey", "c.image", "c.kind", "c.label")


@query("""WITH n AS (SELECT o_custkey AS household, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS night, dayname(o_orderdate) AS day, CASE max(o_orderkey) % 5 WHEN 0 THEN 'uncovered' WHEN 1 THEN 'unresolved' ELSE 'covered' END AS state, bool_or(o_orderkey % 13 = 0) AS violated FROM orders GROUP BY 1, 2, 3),
o AS (SELECT c_custkey AS household, c_custkey % 3 = 0 AS ready, c_custkey % 3 = 1 AS ordered FROM customer WHERE c_custkey % 7 > 0),
g AS (SELECT household, list(day ORDER BY night) FILTER (WHERE state = 'uncovered') AS u, list(day ORDER BY night) FILTER (WHERE state = 'unresolved') AS r, list(day ORDER BY night) FILTER (WHERE violated) AS v, count(*) = 7 AND bool_and(state = 'covered') AS chosen FROM n GROUP BY 1)
SELECT g.household, concat_ws(' ', CASE WHEN chosen THEN 'Every dinner is covered.' END, CASE WHEN len(u) > 0 THEN array_to_string(u, ', ') || CASE WHEN len(u) > 1 THEN ' have' ELSE ' has' END || ' no dinner yet.' END,
  CASE WHEN len(r) > 0 THEN array_to_string(r, ', ') || CASE WHEN len(r) > 1 THEN ' are' ELSE ' is' END || ' unresolved.' END, CASE WHEN len(v) > 0 THEN array_to_string(v, ', ') || ' conflicts with an exclusion.' END,
  CASE WHEN coalesce(ready, false) THEN 'Groceries are ready to send.' WHEN coalesce(ordered, false) THEN 'Order confirmed; check what is still not sent.' ELSE 'Grocery review remains.' END) AS sentence FROM g LEFT JOIN o ON o.household = g.household""")
def k21_week_sentences(spark, d):
    """What every household's week still needs, in words."""
    o = table(spark, d, "orders")
    state = F.max("o_orderkey") % 5
    nights = o.groupBy(F.col("o_custkey").alias("household"), F.weekday("o_orderdate").alias("night"), F.date_format("o_orderdate", "EEEE").alias("day")).agg(F.when(state == 0, "uncovered").when(state == 1, "unresolved").otherwise("covered").alias("state"), F.bool_or(F.col("o_orderkey") % 13 == 0).alias("violated"))
    k = F.col("c_custkey")
    return library.week_sentence(nights, table(spark, d, "customer").filter(k % 7 > 0).select(k.alias("household"), (k % 3 == 0).alias("ready"), (k % 3 == 1).alias("ordered")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN home OR left_out IS NOT NULL THEN NULL WHEN quantity IS NOT NULL THEN quantity || ' ' || CASE unit WHEN 'Tbsp.' THEN 'tablespoon' ELSE unit END ELSE packages || CASE WHEN packages = 1 THEN ' package' ELSE ' packages' END END AS line, left_out
FROM (SELECT *, CASE WHEN home THEN NULL WHEN bought THEN coalesce(note, 'already bought another way') WHEN quantity IS NOT NULL AND unit = 'fl oz' THEN 'amount in fl_oz isn''t a unit of the service' WHEN quantity IS NULL AND packages = 0 THEN 'amount unknown' END AS left_out
FROM (SELECT *, l_returnflag = 'A' AND l_linestatus = 'F' AS home, l_linenumber = 7 AS bought, CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity, ['fl oz', 'Tbsp.', 'lb'][l_partkey % 3 + 1] AS unit, l_linenumber % 4 AS packages, CASE WHEN l_partkey % 2 = 0 THEN 'on its way' END AS note FROM lineitem))""")
def k14_service_list(spark, d):
    """What of every list goes to a delivery service, in its units, and why the rest does not."""
    l = table(spark, d, "lineitem")
    unit = F.element_at(F.array(F.lit("fl oz"), F.lit("Tbsp."), F.lit("lb")), (F.col("l_partkey") % 3 + 1).cast("int"))
    state = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "have_enough").when(F.col("l_linenumber") == 7, "sent_to_cart").otherwise("to_buy")
    items = l.select("l_orderkey", "l_linenumber", "l_partkey", state.alias("state"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("bigint").cast("string")).alias("quantity"), unit.alias("unit"), (F.col("l_linenumber") % 4).alias("packages"), F.when(F.col("l_partkey") % 2 == 0, "on its way").alias("note"))
    return library.service_list(items).select("l_orderkey", "l_linenumber", "l_partkey", "line", "left_out")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN problem IS NULL THEN n END AS packages, problem FROM (SELECT *, CASE WHEN m = 0 THEN 'quantity' WHEN m = 1 THEN 'product' WHEN m = 2 THEN 'size' WHEN m = 3 THEN 'conversion' WHEN n NOT BETWEEN 1 AND 50 THEN 'too_many' END AS problem
FROM (SELECT *, (l_orderkey + l_linenumber) % 7 AS m, CASE (l_orderkey + l_linenumber) % 7 WHEN 4 THEN CAST(l_quantity AS BIGINT) * 2 WHEN 5 THEN (CAST(l_quantity AS BIGINT) * 45359237 + 50000 * 1000 - 1) // (50000 * 1000) ELSE (CAST(l_quantity AS BIGINT) * 3 + 1) // 2 END AS n FROM lineitem))""")
def k19_usual_packages(spark, d):
    """How many packages every usual amount is: pounds in packages of 500 g, half cups in tablespoons, packages as such; or why it is none."""
    m, q = (F.col("l_orderkey") + F.col("l_linenumber")) % 7, F.col("l_quantity").cast("bigint")
    amount = F.when(m == 0, "some").when(m == 4, (q * 2).cast("string")).otherwise(q.cast("string"))
    unit = F.when(m == 4, "package").when(m == 5, "Pounds").when(m == 3, "cups").otherwise("tbsp")
    size = F.when(m.isin(1, 2), None).when(m == 5, "500").when(m == 3, "400").otherwise("2")
    of = F.when(m == 1, None).when(m.isin(3, 5), "g").when(m == 6, "tsp").otherwise("tsp")
    # 1 tbsp is 3 tsp: q tbsp in packages of 2 tsp
    out = library.usual_packages(amount, unit, size, of)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", out.alias("u")).select("l_orderkey", "l_linenumber", "l_partkey", "u.packages", "u.problem")


@query("""WITH e AS (SELECT o_custkey AS op, o_orderkey AS id, o_orderkey % 5 AS revision, CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN o_orderkey % 5 + 1 ELSE o_orderkey % 5 END AS now FROM orders) SELECT op, bool_or(revision IS DISTINCT FROM now) AS stale FROM e GROUP BY op""")
def k10_stale_reviews(spark, d):
    """Whether what a household's reviewed edit rested on has been changed or is gone."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    expected = o.select(F.col("o_custkey").alias("op"), F.lit("a").alias("what"), k.alias("id"), (k % 5).alias("revision"))
    now = o.filter(k % 101 != 0).select(F.lit("a").alias("what"), k.alias("id"), F.when(k % 17 == 0, k % 5 + 1).otherwise(k % 5).alias("revision"))
    return library.stale(expected, now)


@query("""WITH x AS (SELECT *, event_id % 6 = 0 AS h, CASE event_id % 18 WHEN 0 THEN 'Sauce' WHEN 6 THEN 'Main' ELSE 'Filling' END AS name FROM events),
n AS (SELECT *, CASE WHEN h THEN row_number() OVER (PARTITION BY user_id, h, name ORDER BY event_id) + (name = 'Main')::INT END AS i FROM x),
l AS (SELECT *, CASE WHEN h THEN name || CASE WHEN i > 1 THEN ' ' || i ELSE '' END END AS label FROM n)
SELECT user_id, event_id, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'Main') AS component FROM l QUALIFY NOT h""")
def j08_numbered_components(spark, d):
    """Lines under their headings, headings of one name numbered."""
    k = F.col("event_id")
    text = F.when(k % 18 == 0, "For the sauce:").when(k % 18 == 6, "MAIN:").when(k % 6 == 0, "** Filling:").otherwise(F.col("event_type"))
    lines = table(spark, d, "events").select("user_id", "event_id", text.alias("text"), F.lit(False).alias("has_amount"))
    return library.components(lines, ["user_id"], "event_id").select("user_id", "event_id", "component")


@query("""WITH dr AS (SELECT o_custkey AS id, o_orderkey AS draft, o_orderkey % 9 AS revision FROM orders WHERE o_orderstatus = 'O'), best AS (SELECT id, arg_max(draft, (revision, -draft)) AS draft, max(revision) AS revision FROM dr GROUP BY 1),
s AS (SELECT o_custkey AS id, count(*) AS n, arg_min(o_orderpriority, (o_orderdate, o_orderpriority)) AS first_by, max(o_orderdate) AS last_at FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT c_custkey AS id, draft, revision, coalesce(n, 0) AS n_saves, first_by, CAST(last_at AS DATE) AS last_day FROM customer LEFT JOIN best ON best.id = c_custkey LEFT JOIN s ON s.id = c_custkey""")
def a18_bookmarks(spark, d):
    """Every link with its open draft, if there is one, and who saved it."""
    o = table(spark, d, "orders")
    drafts = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("draft"), (F.col("o_orderkey") % 9).alias("revision"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    saves = o.filter("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("member"), F.col("o_orderdate").alias("at"))
    out = library.bookmarks(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), drafts, saves)
    return out.select("id", "draft", "revision", "n_saves", "first_by", F.col("last_at").cast("date").alias("last_day"))


@query("""WITH r AS (SELECT p_brand AS household, p_partkey AS recipe, p_name AS title, p_size AS score, p_size % 4 = 0 AS is_new, p_size % 3 = 0 AS friendly FROM part), w AS (SELECT DISTINCT p_brand AS household, length(p_brand) - 3 AS cooks, length(p_brand) % 3 + 1 AS rests, 1 AS max_new FROM part),
a AS (SELECT r.*, cooks, rests, max_new, row_number() OVER (PARTITION BY r.household, friendly ORDER BY score DESC, title, recipe) AS f FROM r JOIN w ON w.household = r.household),
b AS (SELECT *, row_number() OVER (PARTITION BY household ORDER BY NOT (friendly AND f <= rests), score DESC, title, recipe) AS i FROM a),
c AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY household ORDER BY i) AS news FROM b), e AS (SELECT *, row_number() OVER (PARTITION BY household ORDER BY i) AS place FROM c WHERE NOT is_new OR news <= max_new)
SELECT household, recipe, CAST(place AS INTEGER) AS place FROM e WHERE place <= cooks""")
def e09_chosen_dishes(spark, d):
    """The dishes that each household (brand) cooks, in their order: the best for leftovers first, then by rank, no more new ones than it wants."""
    size = F.col("p_size")
    part = table(spark, d, "part")
    recipes = part.select(F.col("p_brand").alias("household"), F.col("p_partkey").alias("recipe"), F.col("p_name").alias("title"), size.alias("score"), (size % 4 == 0).alias("is_new"), (size % 3 == 0).alias("friendly"))
    n = F.length("p_brand")
    wanted = part.select(F.col("p_brand").alias("household"), (n - 3).alias("cooks"), (n % 3 + 1).alias("rests"), F.lit(1).alias("max_new")).distinct()
    return proposal.chosen(recipes, wanted).select("household", F.explode("dishes").alias("x")).select("household", "x.recipe", "x.place")
