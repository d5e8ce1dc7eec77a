"""Plans, rules, sinks and sources as queries: over whole tables with equivalent SQL, or over a small week whose results are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderflow.operators.relational import ORACLES, QUERIES, query, table
from larderflow.plans import coverage, demand, projection, rules
from larderflow.sources import files
from larderflow.sources.shared import shared_path


@query("""SELECT l_suppkey AS event, l_returnflag AS component, CASE WHEN s % 4 = 0 THEN CAST(s // 4 AS VARCHAR) WHEN s % 2 = 0 THEN CAST(s // 2 AS VARCHAR) || '/2' ELSE CAST(s AS VARCHAR) || '/4' END AS portions
FROM (SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2)""")
def d01_portions(spark, d):
    """Exact portions of each component of an event: quarters as text, summed as fractions."""
    plates = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("event"), F.create_map("l_returnflag", F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("/4"))).alias("component_portions"))
    return demand.portions(plates)


@query("""WITH r AS (SELECT p_brand AS household, p_partkey AS recipe, p_name AS title, p_size % 2 = 0 AS interested, p_size % 3 = 0 AS recent, p_size % 5 <> 0 AS cooked, p_size = 13 AS avoided FROM part),
p AS (SELECT p_brand AS household, l_partkey AS recipe, sum(CASE WHEN l_linenumber = 1 THEN 20 WHEN l_linenumber = 2 THEN 5 ELSE 0 END) AS liked, bool_or(l_linenumber = 7) AS refused FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
s AS (SELECT r.household, r.recipe, title, CAST((CASE WHEN interested THEN 30 ELSE 0 END) + coalesce(liked, 0) - (CASE WHEN recent THEN 40 ELSE 0 END) + (CASE WHEN NOT cooked THEN 15 ELSE 0 END) - (CASE WHEN avoided THEN 100 ELSE 0 END) AS BIGINT) AS score
FROM r LEFT JOIN p ON r.household = p.household AND r.recipe = p.recipe WHERE NOT coalesce(refused, false))
SELECT household, recipe, score, CAST(row_number() OVER (PARTITION BY household ORDER BY score DESC, title, recipe) AS INTEGER) AS rank FROM s""")
def k05_recipe_scores(spark, d):
    """Scores and ranks of every household's recipes."""
    part = table(spark, d, "part")
    recipes = part.select(F.col("p_brand").alias("household"), F.col("p_partkey").alias("recipe"), F.col("p_name").alias("title"), (F.col("p_size") % 2 == 0).alias("interested"), (F.col("p_size") % 3 == 0).alias("recent"), (F.col("p_size") % 5 != 0).alias("cooked"), (F.col("p_size") == 13).alias("avoided"))
    said = F.when(F.col("l_linenumber") == 1, "make_again").when(F.col("l_linenumber") == 2, "occasionally").when(F.col("l_linenumber") == 7, "not_for_me").otherwise("none")
    preferences = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("household"), F.col("l_partkey").alias("recipe"), said.alias("value"))
    out = rules.recipe_scores(recipes, preferences, F.lit("adventurous"))
    return out.select("household", "recipe", F.col("score").cast("long").alias("score"), "rank")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN 'already_ordered' WHEN l_linenumber = 6 THEN 'sent_to_cart' WHEN l_returnflag = 'R' AND l_linestatus = 'O' OR l_discount = 0 THEN 'unknown_amount'
WHEN l_returnflag = 'A' AND NOT l_tax = 0 THEN 'have_enough' ELSE 'to_buy' END AS state FROM lineitem""")
def k13_list_states(spark, d):
    """The state of every line of every list."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", "enough").alias("availability"), (F.col("l_tax") == 0).alias("requested"), F.lit("3").alias("meal"), F.lit("3").alias("net"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.array(F.lit("g"), F.lit("ml"))).alias("conflict"), F.when(F.col("l_discount") != 0, 1).alias("to_send"),
        F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("ordered"), F.when(F.col("l_linenumber") == 6, 1).otherwise(0).alias("sent"),
    )
    return rules.list_state(lines).select("l_orderkey", "l_linenumber", "l_partkey", "state")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN 'no product' WHEN l_suppkey % 4 = 0 THEN 'other store' WHEN l_discount = 0 THEN 'amount unknown' WHEN l_returnflag = 'R' THEN 'unresolved'
WHEN l_tax = 0 THEN 'price unknown' WHEN l_linestatus = 'F' THEN 'not approved' END AS omitted FROM lineitem""")
def k12_omissions(spark, d):
    """Why each line is left out of a partial handoff: the first reason that holds."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") != 7, "p").alias("product"), F.when(F.col("l_suppkey") % 4 == 0, "b").otherwise("a").alias("retailer"), F.when(F.col("l_discount") != 0, 1).alias("to_send"),
        F.when(F.col("l_returnflag") == "R", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"), F.when(F.col("l_tax") != 0, 1).alias("price_minor"), (F.col("l_linestatus") != "F").alias("approved"),
    )
    return rules.omission(lines, F.lit("a")).select("l_orderkey", "l_linenumber", "l_partkey", "omitted")


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS b, CASE WHEN o_custkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS c, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'X' ELSE o_orderstatus END AS d FROM orders)
SELECT k, CASE WHEN c IS NOT DISTINCT FROM b THEN d WHEN d IS NOT DISTINCT FROM b THEN c WHEN c IS NOT DISTINCT FROM d THEN d END AS value,
CASE WHEN c IS NOT DISTINCT FROM b AND d IS NOT DISTINCT FROM b THEN 'same' WHEN d IS NOT DISTINCT FROM b THEN 'theirs' WHEN c IS NOT DISTINCT FROM b THEN 'mine' WHEN c IS NOT DISTINCT FROM d THEN 'both' ELSE 'conflict' END AS outcome FROM b""")
def k15_three_way(spark, d):
    """Three versions of every row merged field by field; a conflict has no value."""
    o = table(spark, d, "orders")
    version = lambda v: o.select(F.col("o_orderkey").alias("k"), v.alias("value"))
    key, status = F.col("o_orderkey") % 4, F.col("o_orderstatus")
    return rules.three_way(version(status), version(F.when(F.col("o_custkey") % 3 == 0, "X").otherwise(status)), version(F.when(key == 0, None).when(key == 1, "X").otherwise(status)), ["k"])


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'Part ' || event_id END AS h FROM events)
SELECT user_id, event_id, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'main') AS component FROM e QUALIFY h IS NULL""")
def j08_under_headings(spark, d):
    """Lines with the heading that they stand under; headings themselves go."""
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("Part "), F.col("event_id").cast("string"), F.lit(" :"))).otherwise(F.col("event_type"))
    return rules.headed(table(spark, d, "events").select("user_id", "event_id", text.alias("text")), ["user_id"], "event_id").select("user_id", "event_id", "component")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a20_restored_export(spark, d):
    """A table exported as JSON and restored by its schema."""
    path = shared_path(spark, "export")
    files.export_tables({"nation": table(spark, d, "nation")}, path)
    return files.restore_tables(spark, {"nation": "n_nationkey int, n_name string, n_regionkey int"}, path)["nation"]


@query("SELECT r_regionkey, r_name FROM region")
def a19_export(spark, d):
    """What an export holds of a table, read as text and taken apart again."""
    path = shared_path(spark, "export")
    files.export_tables({"region": table(spark, d, "region")}, path)
    return spark.read.text(f"{path}/region").select(F.from_json("value", "r_regionkey int, r_name string").alias("r")).select("r.*")


@query("""SELECT p_partkey, '"' || CASE WHEN p_size % 2 = 0 THEN '''=' || p_name ELSE p_name END || '","' || p_size || '"' AS line FROM part""")
def a21_csv_lines(spark, d):
    """Every cell quoted, and none that a spreadsheet would run."""
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("="), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", files.csv_line(name, F.col("p_size")).alias("line"))


@query("""WITH g AS (SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 2 ELSE 3 END AS o, string_agg('- ' || p_name, chr(10) ORDER BY p_partkey) AS body FROM part GROUP BY 1, 2)
SELECT p_brand AS list_id, string_agg(CASE o WHEN 1 THEN 'To buy' WHEN 2 THEN 'Check first' ELSE 'Already have' END || chr(10) || body, chr(10) || chr(10) ORDER BY o) AS text FROM g GROUP BY 1""")
def a22_list_texts(spark, d):
    """Every list as text in its three groups."""
    group = F.when(F.col("p_size") % 3 == 0, "to_buy").when(F.col("p_size") % 3 == 1, "check").otherwise("have")
    return files.list_text(table(spark, d, "part").select(F.col("p_brand").alias("list_id"), group.alias("group"), F.col("p_partkey").alias("position"), F.col("p_name").alias("text")))
