"""Reads, filters, folds and checks of a household's tables as relational operators, each with equivalent SQL.

The driver's tables stand for the household's: nation for households, customer for members, part for ingredients, orders and lineitem for weeks and
their lines, events for the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.functions import temporal
from larderflow.operators.chains import chains
from larderflow.operators.latest import latest_by
from larderflow.operators.relational import query, table

def cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("bigint")


# scans


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000007'")
def a01_point_scan(spark, d):
    """One household by its key; the predicate reaches the scan."""
    return table(spark, d, "customer").filter("c_name = 'Customer#000000007'").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_nationkey, c_name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_name) AS INTEGER) AS place FROM customer")
def a02_members_in_order(spark, d):
    """Members of each household in their order, the order as a column."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_name"))
    return table(spark, d, "customer").select("c_nationkey", "c_name", place.alias("place"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS removed_at FROM orders) WHERE removed_at IS NULL")
def a04_not_removed(spark, d):
    """Rows that no one has removed: a soft delete is a date of removal."""
    o = table(spark, d, "orders").withColumn("removed_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return o.filter(F.col("removed_at").isNull()).select("o_orderkey", "o_custkey")


@query("SELECT p_name, count(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name")
def a05_dimension_lookup(spark, d):
    """Lines by their ingredient's name: counted by key first, so the dimension is only joined to its own number of rows."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name").agg(F.sum("n").alias("n_lines"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def a06_current_facts(spark, d):
    """The current value of each key: the one of the latest row, ties by id; one partial aggregate, no sort."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("""SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, count(*) OVER (PARTITION BY o_custkey, date_trunc('week', o_orderdate), o_orderstatus) AS n_same_week
FROM orders""")
def a08_week_lookup(spark, d):
    """The week of each row, found by household, Monday and kind."""
    o = table(spark, d, "orders").withColumn("monday", temporal.week_start(F.to_date("o_orderdate")))
    weeks = o.groupBy("o_custkey", "monday", "o_orderstatus").agg(F.count("*").alias("n_same_week"))
    return o.join(weeks, ["o_custkey", "monday", "o_orderstatus"]).select("o_orderkey", "monday", "n_same_week")


@query("""SELECT o_orderkey AS plan, 'week' AS kind, 1::BIGINT AS n FROM orders
UNION ALL SELECT l_orderkey, 'assignment', count(*) FROM lineitem WHERE l_linestatus <> 'F' GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, 'allocation', count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""")
def a09_plan_state(spark, d):
    """A plan's rows of three kinds in one frame; retired ones are left out. The lines are read and counted once."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("plan"), F.lit("week").alias("kind"), F.lit(1).cast("long").alias("n"))
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") != "F").alias("assignment"), F.count_if(F.col("l_returnflag") == "R").alias("allocation"))
    return o.unionByName(counts.unpivot(["l_orderkey"], ["assignment", "allocation"], "kind", "n").filter("n > 0").withColumnRenamed("l_orderkey", "plan"))


@query("SELECT event_id, CAST(CASE WHEN hour(ts - INTERVAL 5 HOUR) >= 21 THEN CAST(ts - INTERVAL 5 HOUR AS DATE) + 1 ELSE CAST(ts - INTERVAL 5 HOUR AS DATE) END AS DATE) AS dinner FROM events")
def a10_tagged_with_dinner(spark, d):
    """Observations with the date of the dinner that they are about, by the household's clock."""
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", temporal.next_dinner(at, F.lit("Etc/GMT+5")).alias("dinner"))


@query("""SELECT o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag, l_partkey, l_suppkey, l_quantity), '') AS list
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'O' WHERE o_orderstatus = 'O' GROUP BY o_orderkey""")
def a11_open_lists(spark, d):
    """Open lists with their active selections in order; a list without any is empty, not missing."""
    item = F.struct("l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_quantity", F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_returnflag")).alias("shown"))
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["shown"]), ",").alias("list"))
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("list", F.lit("")).alias("list"))


@query("""SELECT p_partkey, p_name, s.v AS source, d.v AS decision FROM part
LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS v FROM events WHERE event_type = 'view' GROUP BY user_id) s ON s.user_id = p_partkey
LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS v FROM events WHERE event_type = 'click' GROUP BY user_id) d ON d.user_id = p_partkey""")
def a12_source_and_decision(spark, d):
    """Each ingredient with its latest source and latest decision: both folds in one pass over the log."""
    last = lambda kind: F.max_by("event_id", F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    e = table(spark, d, "events").groupBy("user_id").agg(last("view").alias("source"), last("click").alias("decision"))
    return table(spark, d, "part").join(e, F.col("p_partkey") == F.col("user_id"), "left").select("p_partkey", "p_name", "source", "decision")


@query("SELECT CAST(props->>'$.k' AS INTEGER) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a14_stored_json(spark, d):
    """Rows stored as JSON, read with a fixed schema."""
    e = table(spark, d, "events").select(F.from_json("props", "k int")["k"].alias("k"), "user_id")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""WITH old AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), new AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT coalesce(old.k, new.k) AS k, CASE WHEN new.k IS NULL THEN 'delete' WHEN old.k IS NULL THEN 'insert' WHEN old.n <> new.n THEN 'replace' ELSE 'keep' END AS action, new.n AS n FROM old FULL JOIN new ON old.k = new.k""")
def a28_materialised_delta(spark, d):
    """What writing a derived table anew deletes, inserts, replaces and keeps: both states come from one aggregate."""
    both = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(F.col("l_linestatus") == "F").alias("old"), F.count_if(F.col("l_returnflag") != "N").alias("new"))
    action = F.when(F.col("new") == 0, "delete").when(F.col("old") == 0, "insert").when(F.col("old") != F.col("new"), "replace").otherwise("keep")
    return both.filter("old > 0 or new > 0").select("k", action.alias("action"), F.when(F.col("new") > 0, F.col("new")).alias("n"))


# predicates


def where_given(df: DataFrame, **given) -> DataFrame:
    """df filtered by the parameters that are given; a parameter of None asks for nothing and leaves no trace in the plan."""
    for column, value in given.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND (NULL IS NULL OR p_brand = NULL)")
def b05_optional_parameters(spark, d):
    return where_given(table(spark, d, "part"), p_type="ECONOMY", p_brand=None).select("p_partkey")


@query("SELECT o_orderkey, coalesce(o_orderkey = m, false) AS current FROM orders LEFT JOIN (SELECT o_custkey AS c, max(o_orderkey) AS m FROM orders GROUP BY 1) ON c = o_custkey")
def b06_computed_flag(spark, d):
    """Whether a version is its recipe's current one."""
    o = table(spark, d, "orders")
    current = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))
    return o.join(current, "o_custkey", "left").select("o_orderkey", F.coalesce(F.col("o_orderkey") == F.col("m"), F.lit(False)).alias("current"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) = lower('Small RING') OR lower(p_brand) = lower('BRAND#17')")
def b11_case_insensitive(spark, d):
    return table(spark, d, "part").filter("lower(p_name) = lower('Small RING') or lower(p_brand) = lower('BRAND#17')").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'economy')")
def b13_catalog_search(spark, d):
    """Every term of the search stands somewhere in title, cuisine or site."""
    from larderflow.functions.text import matching

    return matching(table(spark, d, "part"), " Economy  RING ", "p_name", "p_brand", "p_type").select("p_partkey")


@query("SELECT p_partkey, p_size <= 30 AS quick, p_type = 'PROMO' AS favourite, coalesce(n >= 30, false) AS sounds_good FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size <= 30 OR p_type = 'PROMO'")
def b14_saved_filters(spark, d):
    """Quick ones or favourites, with what else speaks for them."""
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, d, "part").filter("p_size <= 30 or p_type = 'PROMO'")
    return p.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", (F.col("p_size") <= 30).alias("quick"), (F.col("p_type") == "PROMO").alias("favourite"), F.coalesce(F.col("n") >= 30, F.lit(False)).alias("sounds_good"))


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 0 AND l_linestatus = 'O' AND l_returnflag <> 'R') AS sendable, count(*) FILTER (WHERE l_returnflag = 'R') AS approvable,
count(*) FILTER (WHERE l_discount = 0) AS unpriced FROM lineitem GROUP BY l_orderkey""")
def b15_work_lists(spark, d):
    """How many lines of each cycle can be sent, can be approved, and have no price."""
    sendable = (F.col("l_quantity") > 0) & (F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "R")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(sendable).alias("sendable"), F.count_if(F.col("l_returnflag") == "R").alias("approvable"), F.count_if(F.col("l_discount") == 0).alias("unpriced"))


# joins


@query("""SELECT a.l_orderkey, a.l_linenumber, CAST(count(*) AS BIGINT) AS twins FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_orderkey, a.l_linenumber""")
def c03_composite_key(spark, d):
    """How many lines have a line's ingredient and store: joined by both keys to counts, never row by row."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return lines.join(pairs, ["l_partkey", "l_suppkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("twins"))


@query("SELECT p_partkey, coalesce(m, CAST(round(p_retailprice * 100) AS BIGINT)) AS price FROM part LEFT JOIN (SELECT l_partkey, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_partkey = p_partkey")
def c15_update_from(spark, d):
    """An update from a join is a new column: the found value, else the old one."""
    found = table(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max(cents("l_extendedprice")).alias("m"))
    return table(spark, d, "part").join(found, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("m", cents("p_retailprice")).alias("price"))


@query("SELECT o_orderkey, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'")
def c17_event_of_assignment(spark, d):
    """The event of each assignment: what was a search in a list is an equi-join."""
    return table(spark, d, "orders").filter("o_orderstatus <> 'F'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_mktsegment")


@query("""WITH RECURSIVE links AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders),
walk AS (SELECT id, id AS root, 1::BIGINT AS generation FROM links WHERE previous IS NULL UNION ALL SELECT l.id, w.root, w.generation + 1 FROM walk w JOIN links l ON l.previous = w.id)
SELECT id, root, generation FROM walk""")
def c14_chain_walk(spark, d):
    """Root and generation of every record of a chain of corrections, walked over its links."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return chains(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), before.alias("previous")))


@query("""WITH RECURSIVE links AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders),
walk AS (SELECT id, id AS root, 1::BIGINT AS generation FROM links WHERE previous IS NULL UNION ALL SELECT l.id, w.root, w.generation + 1 FROM walk w JOIN links l ON l.previous = w.id)
SELECT root, max(generation) AS length, arg_max(id, generation) AS last FROM walk GROUP BY root""")
def g02_last_of_chain(spark, d):
    """Length and last record of every chain."""
    return c14_chain_walk(spark, d).groupBy("root").agg(F.max("generation").alias("length"), F.max_by("id", "generation").alias("last"))


# folds


@query("""SELECT l_orderkey, CAST(coalesce(sum(CASE WHEN l_discount > 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END), 0) AS BIGINT) AS known, count(*) FILTER (WHERE l_discount = 0) AS n_missing,
coalesce(string_agg(DISTINCT CASE WHEN l_discount = 0 THEN CAST(l_partkey AS VARCHAR) END, ',' ORDER BY CASE WHEN l_discount = 0 THEN CAST(l_partkey AS VARCHAR) END), '') AS missing FROM lineitem GROUP BY l_orderkey""")
def d12_serving_cost(spark, d):
    """What the priced parts cost, and the list of those without a price."""
    none = F.col("l_discount") == 0
    missing = F.array_join(F.array_sort(F.collect_set(F.when(none, F.col("l_partkey").cast("string")))), ",")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.sum(F.when(~none, cents("l_extendedprice"))), F.lit(0).cast("long")).alias("known"), F.count_if(none).alias("n_missing"), missing.alias("missing"))


@query("SELECT l_orderkey, l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * l_linenumber) AS DECIMAL(38,2)) AS amount FROM lineitem GROUP BY l_orderkey, l_partkey")
def d13_cook_amounts(spark, d):
    """Portions times quantity by recipe and ingredient, in decimals."""
    amount = F.sum(F.col("l_quantity").cast("decimal(18,2)") * F.col("l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(amount.cast("decimal(38,2)").alias("amount"))


@query("""WITH v AS (SELECT l_partkey, l_linenumber, count(*) AS n, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, lag(n) OVER (PARTITION BY l_partkey ORDER BY l_linenumber) AS before FROM v)
SELECT l_partkey, l_linenumber, kinds = 1 AND (before IS NULL OR n <= before) AS unambiguous FROM w""")
def d22_unambiguous(spark, d):
    """Whether one value alone explains a row of a version, which has no more rows than the version before."""
    v = table(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("kinds"))
    before = F.lag("n").over(Window.partitionBy("l_partkey").orderBy("l_linenumber"))
    return v.withColumn("before", before).select("l_partkey", "l_linenumber", ((F.col("kinds") == 1) & (F.col("before").isNull() | (F.col("n") <= F.col("before")))).alias("unambiguous"))


@query("SELECT p_brand AS seasoning, p_name AS recipe, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS INTEGER) AS place FROM (SELECT DISTINCT p_brand, p_name FROM part)")
def d24_seasonings(spark, d):
    """Distinct seasonings, each with the recipes that ask for it, a row for each and its place: a seasoning may have any number of them."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("seasoning"), F.col("p_name").alias("recipe")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("seasoning").orderBy("recipe")))


@query("""WITH r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS i FROM part)
SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY i > 2, p_size % 7 DESC, p_partkey) AS INTEGER) AS place FROM r""")
def e09_first_then_ranked(spark, d):
    """The two best for leftovers come first, the others by their score."""
    best = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("i") > 2, F.desc(F.col("p_size") % 7), "p_partkey"))
    return table(spark, d, "part").withColumn("i", best).select("p_partkey", "p_brand", place.alias("place"))


# orders of rows


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(coalesce(nullif(c_mktsegment, 'MACHINERY'), c_name)), c_custkey) AS INTEGER) AS place FROM customer")
def f02_by_expression(spark, d):
    key = F.lower(F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), "c_name"))
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(key, "c_custkey")).alias("place"))


@query("SELECT p_type, p_name, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS INTEGER) AS place FROM (SELECT DISTINCT p_type, p_name FROM part)")
def f08_code_point_order(spark, d):
    """Names of each type in the order of their code points."""
    return table(spark, d, "part").select("p_type", "p_name").distinct().withColumn("place", F.row_number().over(Window.partitionBy("p_type").orderBy("p_name")))


@query("SELECT p_partkey, substr(p_name, 1, 6) AS short FROM part")
def f09_truncations(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring("p_name", 1, 6).alias("short"))


# sets and checks


@query("""WITH s AS (SELECT l_orderkey, list(l_partkey) AS asked, list_distinct(list(l_partkey)) AS a, list_distinct(list(l_partkey) FILTER (WHERE l_returnflag <> 'R')) AS allowed FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(asked) > len(a) AS repeats, len(list_filter(a, lambda x: NOT list_contains(coalesce(allowed, []), x))) = 0 AS subset, list_sort(a) = list_sort(coalesce(allowed, [])) AS same FROM s""")
def g05_set_checks(spark, d):
    """Whether what is asked has repeats, is part of what is allowed, and is the same set."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.collect_set("l_partkey").alias("a"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("allowed"))
    return s.select("l_orderkey", (F.col("n") > F.size("a")).alias("repeats"), (F.size(F.array_except("a", "allowed")) == 0).alias("subset"), (F.array_sort("a") == F.array_sort("allowed")).alias("same"))


@query("SELECT event_id, coalesce(m, -1) <> value OR m IS NULL AS stale FROM events LEFT JOIN (SELECT user_id AS u, max(value) AS m FROM events WHERE event_type = 'view' GROUP BY 1) ON u = user_id")
def k10_stale_closure(spark, d):
    """A plan edit is stale if a row that it rests on has another revision now, or is gone."""
    e = table(spark, d, "events")
    now = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("m"))
    return e.join(now, "user_id", "left").select("event_id", (F.col("m").isNull() | (F.col("m") != F.col("value"))).alias("stale"))


@query("""WITH a AS (SELECT c_nationkey AS night, min(c_name) AS x FROM customer WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY 1), b AS (SELECT c_nationkey AS night, min(c_name) AS x FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT coalesce(a.night, b.night) AS night, CASE WHEN a.night IS NULL THEN 'added ' || b.x WHEN b.night IS NULL THEN 'removed ' || a.x ELSE a.x || ' -> ' || b.x END AS change FROM a FULL JOIN b ON a.night = b.night WHERE a.x IS DISTINCT FROM b.x""")
def k06_explained_change(spark, d):
    """Two proposals side by side, night by night: what was added, removed or changed."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("night")).agg(F.min(F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.col("c_name"))).alias("a"), F.min(F.when(F.col("c_acctbal") > 0, F.col("c_name"))).alias("b"))
    text = F.when(F.col("a").isNull(), F.concat(F.lit("added "), "b")).when(F.col("b").isNull(), F.concat(F.lit("removed "), "a")).otherwise(F.concat("a", F.lit(" -> "), "b"))
    return c.filter(~F.col("a").eqNullSafe(F.col("b"))).select("night", text.alias("change"))


@query("""SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS before, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS after,
sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) > 20000000 AS over_budget FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0""")
def k11_previewed_consequence(spark, d):
    """What an edit would change in a cycle's cost: both scenarios in one pass, cycles that it touches only."""
    gone = F.col("l_returnflag") == "R"
    after = F.sum(F.when(gone, 0).otherwise(cents("l_extendedprice")))
    out = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("before"), after.alias("after"), F.count_if(gone).alias("n"))
    return out.filter("n > 0").select("l_orderkey", "before", "after", (F.col("after") > 20_000_000).alias("over_budget"))


@query("SELECT p_partkey, CASE WHEN p_size * 30 > 0 AND p_size * 30 < CAST(round(p_retailprice) AS BIGINT) THEN p_size * 30 ELSE CAST(round(p_retailprice) AS BIGINT) END AS price FROM part")
def k20_price_choice(spark, d):
    """A promotion counts only below the regular price."""
    promo, regular = F.col("p_size").cast("bigint") * 30, F.round("p_retailprice").cast("bigint")
    return table(spark, d, "part").select("p_partkey", F.when((promo > 0) & (promo < regular), promo).otherwise(regular).alias("price"))


@query("""SELECT l_orderkey, concat_ws(', ', CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') > 0 THEN CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS VARCHAR) || ' to buy' END,
CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS VARCHAR) || ' to approve' END) AS sentence FROM lineitem GROUP BY l_orderkey""")
def k21_status_sentence(spark, d):
    """What is left to do, in words; nothing left is an empty sentence."""
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(", ", part(F.count_if(F.col("l_linestatus") == "O"), " to buy"), part(F.count_if(F.col("l_returnflag") == "R"), " to approve")).alias("sentence"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'member:' || p_name WHEN p_size % 2 = 0 THEN 'source:' || p_brand END AS photo FROM part")
def k22_photo_precedence(spark, d):
    """A member's photo, else the source's, else none."""
    member = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("member:"), "p_name"))
    source = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("source:"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(member, source).alias("photo"))


# logs


@query("SELECT event_id, user_id, event_id < coalesce(max(event_id) OVER (PARTITION BY user_id ORDER BY value, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), event_id) AS ignored FROM events")
def l07_out_of_order(spark, d):
    """Rows in the order of arrival: one with a sequence number below the greatest seen is ignored."""
    w = Window.partitionBy("user_id").orderBy("value", "ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") < F.coalesce(F.max("event_id").over(w), "event_id")).alias("ignored"))


@query("""WITH touched AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01')
SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM touched) GROUP BY l_orderkey""")
def l08_affected_only(spark, d):
    """Derived rows of the cycles that a change touches, and no others: one aggregate tells which they are and what they hold."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("total"), F.max("l_shipdate").alias("changed"))
    return lines.filter(F.col("changed") >= F.lit("2000-06-01").cast("timestamp_ntz")).select("l_orderkey", "total")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey""")
def e07_latest_observation(spark, d):
    """The latest observation of each event by time, ties by id."""
    return latest_by(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("latest"), F.col("o_orderstatus").alias("status"))
