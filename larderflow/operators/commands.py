"""Write commands as folds over a log: each row is a command, and the state after all of them is a query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.operators.relational import query, table


@query("""SELECT user_id, event_type AS staple, CAST(row_number() OVER w AS INTEGER) AS revision, value, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS current
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def w07_revisions(spark, d):
    """Revisioned rows with their history: each revision is valid until the next begins."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    until = F.lead("ts").over(w)
    return table(spark, d, "events").select("user_id", F.col("event_type").alias("staple"), F.row_number().over(w).alias("revision"), "value", F.col("ts").alias("valid_from"), until.alias("valid_to"), until.isNull().alias("current"))


@query("""SELECT user_id, k, value FROM (SELECT user_id, CAST(props->>'$.k' AS INTEGER) AS k, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1, 2) WHERE last <> 'error'""")
def w08_upserts(spark, d):
    """Upserts and soft deletes: the latest command of a key decides, and a removed key is gone. One partial aggregate, no sort."""
    e = table(spark, d, "events").select("user_id", F.from_json("props", "k int")["k"].alias("k"), "value", "event_type", "ts", "event_id")
    last = e.groupBy("user_id", "k").agg(F.max_by(F.struct("value", "event_type"), F.struct("ts", "event_id")).alias("x"))
    return last.filter("x.event_type <> 'error'").select("user_id", "k", "x.value")


@query("""SELECT user_id, count(*) AS decisions, count(*) FILTER (WHERE event_type = 'error') AS cleared, arg_max(event_id, (ts, event_id)) AS latest, arg_max(event_type, (ts, event_id)) = 'error' AS is_cleared FROM events GROUP BY user_id""")
def w13_decisions(spark, d):
    """Decisions are appended, and the latest one is in force."""
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("decisions"), F.count_if(F.col("event_type") == "error").alias("cleared"), F.max_by("event_id", at).alias("latest"), (F.max_by("event_type", at) == "error").alias("is_cleared"))


@query("""SELECT user_id, k, count(*) AS taps, min(event_id) AS first FROM (SELECT user_id, event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE event_type = 'click') GROUP BY user_id, k""")
def w04_merged_taps(spark, d):
    """A need that is said again is the same need once more: taps are counted, the first keeps its id."""
    e = table(spark, d, "events").filter("event_type = 'click'").select("user_id", "event_id", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("user_id", "k").agg(F.count("*").alias("taps"), F.min("event_id").alias("first"))


@query("""SELECT 'generation' AS rule, l_orderkey AS id, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem) WHERE l_linenumber <> coalesce(before, 0) + 1 GROUP BY l_orderkey
UNION ALL SELECT 'forward only', o_custkey, count(*) FROM (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE o_orderdate < before GROUP BY o_custkey
UNION ALL SELECT 'provenance', p_partkey, 1 FROM part WHERE p_name LIKE 'small%' AND p_type <> 'ECONOMY'""")
def s01_rule_violations(spark, d):
    """What the rules of a table would have refused: links of a chain that don't follow each other, dates that go back, fixtures that aren't marked."""
    chain = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_linenumber").over(chain).alias("before"))
    links = lines.filter("l_linenumber <> coalesce(before, 0) + 1").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n")).withColumn("rule", F.lit("generation"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before"))
    back = orders.filter("o_orderdate < before").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).withColumn("rule", F.lit("forward only"))
    fixtures = table(spark, d, "part").filter("p_name like 'small%' and p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("n"), F.lit("provenance").alias("rule"))
    return links.unionByName(back).unionByName(fixtures)
