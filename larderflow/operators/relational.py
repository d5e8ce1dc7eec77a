"""Relational operators over the driver's tables, each with equivalent SQL. Money is whole cents; every order that decides a result is total."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.functions import exact, temporal, text, units
from larderflow.operators.latest import changed, latest_by, multiset_difference, top_by

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str) -> F.Column:
    return F.col(column).cast("bigint")


@query("""SELECT c_custkey, c_name, coalesce(n_name, 'none') AS nation, c_acctbal IS NULL OR c_acctbal >= 0 AS solvent
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'HOUSEHOLD'""")
def a03_scan_with_default(spark, d):
    """Tenant scan with a default where the setting is absent; the filter reaches the scan."""
    c = table(spark, d, "customer").filter("c_mktsegment = 'HOUSEHOLD'")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_name", F.coalesce("n_name", F.lit("none")).alias("nation"), (F.col("c_acctbal").isNull() | (F.col("c_acctbal") >= 0)).alias("solvent"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_lines,
  coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT)), '') AS lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def a07_nested_assembly(spark, d):
    """Nested rows in a stated order: the sort key stands first in the struct."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", whole("l_quantity").alias("q")))).alias("lines"))
    out = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    shown = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x.l_linenumber.cast("string"), x.l_partkey.cast("string"), x.q.cast("string"))), ",")
    return out.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(shown, F.lit("")).alias("lines"))


@query("""SELECT CAST(sum(CAST(('0x' || left(md5(r), 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS checksum, count(*) AS n FROM
  (SELECT l_orderkey || ',' || l_partkey || ',' || l_suppkey || ',' || l_linenumber || ',' || CAST(l_quantity AS BIGINT) || ',' || l_returnflag || ',' || l_linestatus AS r FROM lineitem)""")
def a30_table_checksum(spark, d):
    """Digest of a table's rows whatever their order: the sum of 60 bits of each row's own digest, so partial sums are all that is shuffled; repeated rows count."""
    row = F.concat_ws(",", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), whole("l_quantity").cast("string"), "l_returnflag", "l_linestatus")
    bits = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(20,0)")
    return table(spark, d, "lineitem").agg(F.sum(bits).cast("string").alias("checksum"), F.count("*").alias("n"))


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def b04_in_list(spark, d):
    """A large IN list is a semi-join."""
    wanted = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(wanted, "p_partkey", "left_semi")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer""")
def b07_exists_flag(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left").select("c_custkey", F.col("hit").isNotNull().alias("urgent"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-15' - INTERVAL 14 DAY AND o_orderdate < TIMESTAMP '1997-06-15'""")
def b08_date_window(spark, d):
    """The fortnight before a day, half open."""
    day = F.lit("1997-06-15").cast("timestamp_ntz")
    return table(spark, d, "orders").filter((F.col("o_orderdate") >= day - F.expr("INTERVAL '14' DAY")) & (F.col("o_orderdate") < day)).select("o_orderkey", "o_custkey")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90""")
def b09_json_path(spark, d):
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).filter("k >= 90").select("event_id", "k")


@query("""SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'O'""")
def b10_null_safe_inequality(spark, d):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, d, "orders").filter(~status.eqNullSafe(F.lit("O"))).select("o_orderkey")


@query("""SELECT doc_id FROM documents WHERE contains(lower(text || ' ' || source), 'with') AND contains(lower(text || ' ' || source), 'src1')""")
def b12_term_search(spark, d):
    """Every term of the query, cut at white space, is in the haystack."""
    return text.matching(table(spark, d, "documents"), "WITH  src1", "text", "source").select("doc_id")


@query("""SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate + INTERVAL 90 DAY END) IS NULL
  OR (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate + INTERVAL 90 DAY END) > TIMESTAMP '2000-01-01'""")
def b16_expiry(spark, d):
    """No expiry counts as not expired."""
    expires = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate") + F.expr("INTERVAL '90' DAY"))
    return table(spark, d, "orders").withColumn("expires", expires).filter(F.col("expires").isNull() | (F.col("expires") > F.lit("2000-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_quantity <= 0 THEN 'quantity' WHEN l_discount > 0.09 THEN 'discount'
  WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'status' END AS problem FROM lineitem
WHERE l_quantity <= 0 OR l_discount > 0.09 OR (l_returnflag = 'N' AND l_linestatus = 'F')""")
def b18_row_rules(spark, d):
    """Row constraints as a table of rejects with their first broken rule."""
    problem = F.when(F.col("l_quantity") <= 0, "quantity").when(F.col("l_discount") > 0.09, "discount").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "status")
    return table(spark, d, "lineitem").withColumn("problem", problem).filter("problem is not null").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "problem")


@query("""SELECT p_partkey FROM part WHERE p_name LIKE '%blue%' AND p_type NOT ILIKE 'sm_ll' AND regexp_matches(p_brand, '^Brand#[0-9]$')""")
def b19_patterns(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").like("%blue%") & ~F.col("p_type").ilike("sm_ll") & F.col("p_brand").rlike("^Brand#[0-9]$")).select("p_partkey")


@query("""SELECT r_name, n_name, s_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM region JOIN nation ON r_regionkey = n_regionkey
  JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""")
def c01_inner_chain(spark, d):
    """The large table is summed per supplier before it meets the dimensions."""
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(whole("l_quantity")).alias("quantity"))
    dims = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(dims, F.col("l_suppkey") == F.col("s_suppkey")).select("r_name", "n_name", "s_suppkey", "quantity")


@query("""SELECT c_custkey, count(o_orderkey) AS n_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey""")
def c04_filter_in_on(spark, d):
    """The condition belongs to the join, so customers without an open order stay."""
    open_ = table(spark, d, "orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_open"))


@query("""SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def c05_latest_per_key(spark, d):
    return latest_by(table(spark, d, "events"), ["user_id"], F.desc_nulls_last("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "ts")


@query("""SELECT c_custkey, x.o_orderkey FROM customer LEFT JOIN LATERAL
  (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x ON true""")
def c06_lateral_top1(spark, d):
    """max_by aggregates map-side, where a lateral join would rank every order."""
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return table(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""SELECT o_custkey, count(*) AS n_orders, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(returned) AS BIGINT) AS returned FROM (
  SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines,
    (SELECT coalesce(sum(CAST(l_quantity AS BIGINT)), 0) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders) GROUP BY o_custkey""")
def c09_nested_correlated(spark, d):
    """Correlated aggregates, bottom up: lines per order, then orders per customer."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", whole("l_quantity")).otherwise(0)).alias("r"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum(F.coalesce("n", F.lit(0))).alias("n_lines"), F.sum(F.coalesce("r", F.lit(0))).alias("returned"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def c12_effective_anti(spark, d):
    """Orders without a correction."""
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(returned, "o_orderkey", "left_anti")


@query("""WITH RECURSIVE s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS generation FROM orders),
  chain AS (SELECT o_custkey, o_orderkey, generation, o_orderkey AS root FROM s WHERE generation = 1
    UNION ALL SELECT s.o_custkey, s.o_orderkey, s.generation, chain.root FROM chain JOIN s ON s.o_custkey = chain.o_custkey AND s.generation = chain.generation + 1)
SELECT o_custkey, o_orderkey, generation, root FROM chain""")
def c14_chain_recursive(spark, d):
    """A linear chain has its root by a window, in one shuffle; sources.chains walks general links."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("generation"), F.first("o_orderkey").over(w).alias("root"))


def in_blocks(df: DataFrame, by: list[str], key: str, size: int = 256) -> DataFrame:
    """by, deal, block, key: the keys of each group in arrays of this size and a shorter one for each 16 of them, as structs, since a null key counts too."""
    deals = df.groupBy(*by).agg(F.ceil(F.count("*") / (16 * size)).alias("deals"))
    dealt = df.join(F.broadcast(deals), by).groupBy(*by, F.pmod(F.xxhash64(key), "deals").alias("deal")).agg(F.collect_list(F.struct(key)).alias("keys"))
    return dealt.select(*by, "deal", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("keys"), F.lit(size)), lambda i: F.slice("keys", i, size))).alias("block", key))


def term_members(suppliers: DataFrame, parts: DataFrame, parts_of_task: int = 4_096) -> DataFrame:
    """s_suppkey, p_partkey of each part with the supplier's folded term, for the supplier's member or, if that is null, for everyone.

    Pairs are as many as suppliers times parts, so they are made once each, without a shuffle: both sides are made distinct and put in blocks of one tag and one
    set of members or eaters before they meet, and blocks of parts are dealt out to tasks that each hold all suppliers' blocks. A task has few parts and repeats
    a block of them for each supplier; files keep such columns in far fewer bytes than each part with all its suppliers. The sort parts the join from the
    rows made of it, so a task holds those of one pair of blocks at a time."""
    term = F.when(F.col("s_suppkey") % 3 == 0, "RED").when(F.col("s_suppkey") % 3 == 1, "widget ").otherwise("economy")
    said = suppliers.select("s_suppkey", F.lower(F.trim(term)).alias("tag"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("member"))
    terms = said.groupBy("s_suppkey", "tag").agg(F.bool_or(F.col("member").isNull()).alias("everyone"), F.array_sort(F.collect_set("member")).alias("members"))
    tags = parts.select("p_partkey", (F.col("p_size") % 25).alias("eater"), F.explode(F.array_distinct(F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"))))).alias("tag"))
    tags = tags.join(F.broadcast(terms.select("tag").distinct()), "tag", "left_semi").groupBy("p_partkey", "tag").agg(F.array_sort(F.collect_set("eater")).alias("eaters"))
    order = ["tag", "eaters", "deal", "block"]
    tasks = max(parts.sparkSession.sparkContext.defaultParallelism, -(-parts.count() // parts_of_task))
    dealt = in_blocks(tags, ["tag", "eaters"], "p_partkey").repartitionByRange(tasks, *order)
    of_all = dealt.join(F.broadcast(in_blocks(terms.filter("everyone"), ["tag"], "s_suppkey").select("tag", "s_suppkey")), "tag")
    theirs = dealt.join(F.broadcast(in_blocks(terms.filter("not everyone"), ["tag", "members"], "s_suppkey").select("tag", "members", "s_suppkey")), "tag").filter(F.arrays_overlap("members", "eaters"))
    of_all, theirs = (x.sortWithinPartitions(*order).select("p_partkey", F.inline("s_suppkey")).select("s_suppkey", F.inline("p_partkey")) for x in (of_all, theirs))
    return of_all.unionByName(theirs)


@query("""WITH terms AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'RED' WHEN 1 THEN 'widget ' ELSE 'economy' END AS term, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS member FROM supplier),
  tags AS (SELECT p_partkey, p_size % 25 AS eater, unnest(string_split(lower(p_name), ' ')) AS tag FROM part UNION SELECT p_partkey, p_size % 25, lower(p_type) FROM part)
SELECT DISTINCT s_suppkey, p_partkey FROM terms JOIN tags ON lower(trim(term)) = tag AND (member IS NULL OR member = eater)""")
def c19_term_membership(spark, d):
    """Set membership as an equi-join of folded terms; a null member means everyone."""
    return term_members(table(spark, d, "supplier"), table(spark, d, "part"))


@query("""SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  AND l_shipdate >= o_orderdate + INTERVAL 10 DAY AND l_shipdate < o_orderdate + INTERVAL 400 DAY GROUP BY o_orderpriority""")
def c20_range_join(spark, d):
    """An interval condition beside the key of the join."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    near = (F.col("l_shipdate") >= F.col("o_orderdate") + F.expr("INTERVAL '10' DAY")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL '400' DAY"))
    return o.join(l, (o.o_orderkey == l.l_orderkey) & near).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(whole("l_quantity")).alias("quantity"))


@query("""WITH a AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders WHERE o_orderdate >= '1997-05-01' AND o_orderdate < '1997-06-01' GROUP BY 1),
  b AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders WHERE o_orderdate >= '1997-06-01' AND o_orderdate < '1997-07-01' GROUP BY 1)
SELECT o_custkey, a.v AS before, b.v AS after FROM a FULL JOIN b USING (o_custkey) WHERE a.v IS DISTINCT FROM b.v""")
def c23_full_outer_delta(spark, d):
    def month(start, end):
        rows = table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz")))
        return rows.groupBy("o_custkey").agg(F.sum(exact.cents(F.col("o_totalprice"))).alias("v"))

    return changed(month("1997-05-01", "1997-06-01"), month("1997-06-01", "1997-07-01"), ["o_custkey"], "v")


@query("""WITH demand AS (SELECT p_type, p_brand, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  scenario AS (SELECT 'baseline' AS s, NULL AS grows UNION ALL SELECT 'more ' || t, t FROM (SELECT DISTINCT p_type AS t FROM part))
SELECT s AS scenario, p_brand, CAST(sum(CASE WHEN p_type = grows THEN 2 * q ELSE q END) AS BIGINT) AS quantity FROM scenario, demand GROUP BY ALL""")
def c24_scenarios(spark, d):
    """What-if as a dimension: only the changed groups are computed again, the baseline is added to them."""
    demand = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(whole("l_quantity")).alias("q")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.sum("q").alias("q"))
    base = demand.groupBy("p_brand").agg(F.sum("q").alias("quantity"), F.map_from_entries(F.collect_list(F.struct("p_type", "q"))).alias("by_type"))
    types = table(spark, d, "part").select("p_type").distinct().agg(F.collect_set("p_type").alias("types"))  # the scenarios
    out = base.join(F.broadcast(types)).select("p_brand", "quantity", "by_type", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("types"))).alias("grows"))
    return out.select(F.coalesce(F.concat(F.lit("more "), F.col("grows")), F.lit("baseline")).alias("scenario"), "p_brand", (F.col("quantity") + F.coalesce(F.try_element_at("by_type", F.coalesce("grows", F.lit(""))), F.lit(0))).alias("quantity"))


_UNIT = "CASE p_size % 6 WHEN 0 THEN 'Ounces' WHEN 1 THEN 'lb.' WHEN 2 THEN 'cup' WHEN 3 THEN ' TBSP ' WHEN 4 THEN 'each' ELSE 'bunch' END"
_PARTS = "CASE p_size % 6 WHEN 0 THEN 2834952312500 WHEN 1 THEN 45359237000000 WHEN 2 THEN 23658823650000 WHEN 3 THEN 1478676478125 ELSE 100000000000 END"
_BASE = "CASE p_size % 6 WHEN 0 THEN 'g' WHEN 1 THEN 'g' WHEN 2 THEN 'ml' WHEN 3 THEN 'ml' WHEN 4 THEN 'each' ELSE 'bunch' END"


def recipe_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a unit each, as a plan would have them: event (order), ingredient (brand), quantity, unit."""
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("event"), F.col("p_brand").alias("ingredient"), whole("l_quantity").alias("quantity"), F.expr(_UNIT).alias("unit"))


@query(f"""SELECT p_brand AS ingredient, {_BASE} AS unit, CAST(sum(CAST(CAST(l_quantity AS BIGINT) AS HUGEINT) * {_PARTS}) AS VARCHAR) AS parts, count(DISTINCT l_orderkey) AS n_events
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def d02_exact_demand(spark, d):
    """Demand per ingredient and base unit in whole parts of 10^-11 of the base unit: exact sums in the JVM. Units are read once for each ingredient,
    before the join, not once for each line."""
    from larderflow.plans.demand import demand_parts, with_factors

    part = with_factors(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ingredient"), F.expr(_UNIT).alias("unit")))
    lines = table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("event"), whole("l_quantity").alias("quantity"))
    out = demand_parts(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), ["ingredient"])
    return out.select("ingredient", "unit", F.col("parts").cast("string").alias("parts"), "n_events")


@query(f"""SELECT p_brand AS ingredient, count(DISTINCT {_BASE}) AS n_units, string_agg(DISTINCT {_BASE}, ',' ORDER BY {_BASE}) AS units,
  CASE WHEN count(DISTINCT {_BASE}) = 1 THEN 'ok' ELSE 'conflict' END AS state FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def d05_unit_conflict(spark, d):
    used = table(spark, d, "lineitem").select("l_partkey").distinct()
    rows = table(spark, d, "part").join(used, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_brand", units.base_unit(F.expr(_UNIT)).alias("unit"))
    out = rows.groupBy(F.col("p_brand").alias("ingredient")).agg(F.array_sort(F.collect_set("unit")).alias("u"))
    return out.select("ingredient", F.size("u").cast("bigint").alias("n_units"), F.array_join("u", ",").alias("units"), F.when(F.size("u") == 1, "ok").otherwise("conflict").alias("state"))


@query("""SELECT p_partkey, q AS demand, CASE WHEN q <= 0 THEN 0 ELSE q // p_size + CASE WHEN q % p_size > 0 THEN 1 ELSE 0 END END AS packages
FROM (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey""")
def h04_package_count(spark, d):
    """Exact ceiling of demand over package size."""
    demand = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(whole("l_quantity")).alias("demand"))
    return demand.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "demand", exact.whole_packages(F.col("demand"), F.col("p_size")).alias("packages"))


@query("""SELECT l_orderkey, CAST(coalesce(max(coalesce(p, 1)) FILTER (WHERE kind = 'usual'), 0) + coalesce(sum(coalesce(p, 1)) FILTER (WHERE kind = 'extra'), 0) AS BIGINT) AS packages
FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'usual' ELSE 'extra' END AS kind, CASE WHEN l_quantity > 40 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS p FROM lineitem) GROUP BY 1""")
def d06_max_plus_sum(spark, d):
    """Usual requests: the largest; extras: their sum; without a number: one package."""
    r = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2 == 0).alias("usual"), F.coalesce(F.when(F.col("l_quantity") <= 40, whole("l_quantity")), F.lit(1)).alias("p"))
    return r.groupBy("l_orderkey").agg((F.coalesce(F.max(F.when(F.col("usual"), F.col("p"))), F.lit(0)) + F.coalesce(F.sum(F.when(~F.col("usual"), F.col("p"))), F.lit(0))).alias("packages"))


@query("""SELECT l_partkey, CAST(coalesce(sum(q) FILTER (WHERE f = 'A'), 0) AS BIGINT) AS received, CAST(coalesce(sum(q) FILTER (WHERE f = 'R'), 0) AS BIGINT) AS missing,
  CAST(coalesce(sum(q) FILTER (WHERE f = 'N'), 0) AS BIGINT) AS open, CAST(sum(q) AS BIGINT) AS ordered FROM (SELECT l_partkey, l_returnflag AS f, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1""")
def d07_conditional_sums(spark, d):
    by = lambda f: F.sum(F.when(F.col("l_returnflag") == f, whole("l_quantity")).otherwise(0))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(by("A").alias("received"), by("R").alias("missing"), by("N").alias("open"), F.sum(whole("l_quantity")).alias("ordered"))


_PRICE = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(round(p_retailprice * 100) AS BIGINT) END"


@query(f"""SELECT l_orderkey, CAST(coalesce(sum(q * price), 0) AS BIGINT) AS known, count(*) FILTER (WHERE price IS NULL) AS unknown, count(*) FILTER (WHERE price IS NULL) = 0 AS complete,
  CAST(coalesce(sum(q * price) FILTER (WHERE f <> 'A'), 0) AS BIGINT) AS outstanding, count(*) FILTER (WHERE price IS NULL AND f <> 'A') AS outstanding_unknown
FROM (SELECT l_orderkey, l_returnflag AS f, CAST(l_quantity AS BIGINT) AS q, {_PRICE} AS price FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def d09_known_unknown_cost(spark, d):
    """Unknown is never zero: the known part and the number of unknowns, for two scopes in one pass."""
    p = table(spark, d, "part").select("p_partkey", F.expr(_PRICE).alias("price"))
    cost = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("cost", whole("l_quantity") * F.col("price"))
    open_ = F.col("l_returnflag") != "A"
    out = cost.groupBy("l_orderkey").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("known"), F.count_if(F.col("cost").isNull()).alias("unknown"), F.coalesce(F.sum(F.when(open_, F.col("cost"))), F.lit(0)).alias("outstanding"), F.count_if(open_ & F.col("cost").isNull()).alias("outstanding_unknown"))
    return out.withColumn("complete", F.col("unknown") == 0)


@query("""SELECT l_suppkey, CASE WHEN count(*) FILTER (WHERE v IS NULL) > 0 THEN NULL ELSE CAST(sum(v) AS BIGINT) END AS value, CAST(coalesce(sum(v), 0) AS BIGINT) AS known,
  coalesce(string_agg(DISTINCT CAST(CASE WHEN v IS NULL THEN p_size END AS VARCHAR), ',' ORDER BY CAST(CASE WHEN v IS NULL THEN p_size END AS VARCHAR)), '') AS missing
FROM (SELECT l_suppkey, p_size, CASE WHEN p_size % 49 = 1 AND l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS v FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def d11_null_poisoned(spark, d):
    """A total is unknown if a part is; the known part and the missing keys stand beside it."""
    v = F.when(~((F.col("p_size") % 49 == 1) & (F.col("l_linenumber") == 1)), whole("l_quantity"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_size", v.alias("v"))
    gone = F.collect_set(F.when(F.col("v").isNull(), F.col("p_size").cast("string")))
    return rows.groupBy("l_suppkey").agg(F.when(F.count_if(F.col("v").isNull()) == 0, F.sum("v")).alias("value"), F.coalesce(F.sum("v"), F.lit(0)).alias("known"), F.array_join(F.array_sort(gone), ",").alias("missing"))


@query("""SELECT n_regionkey AS region, count(*) AS n, max(n_nationkey) AS newest, greatest(coalesce(max(CASE WHEN n_nationkey > 20 THEN n_nationkey END), 0), 1) AS floored FROM nation GROUP BY 1""")
def d17_scalars(spark, d):
    high = F.max(F.when(F.col("n_nationkey") > 20, F.col("n_nationkey")))
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.max("n_nationkey").alias("newest"), F.greatest(F.coalesce(high, F.lit(0)), F.lit(1)).alias("floored"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def d20_audit_summary(spark, d):
    s = lambda x: F.count_if(F.col("o_orderstatus") == x)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(s("F").alias("f"), s("O").alias("o"), s("P").alias("p"), F.countDistinct("o_custkey").alias("customers"))


@query("""WITH l AS (SELECT l_partkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), r AS (SELECT l_partkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT l_partkey, l_linenumber, greatest(coalesce(l.n, 0) - coalesce(r.n, 0), 0) AS removed, greatest(coalesce(r.n, 0) - coalesce(l.n, 0), 0) AS added
FROM l FULL JOIN r USING (l_partkey, l_linenumber) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""")
def d21_multiset_diff(spark, d):
    rows = table(spark, d, "lineitem")
    return multiset_difference(rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'"), ["l_partkey", "l_linenumber"])


@query("""SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM orders""")
def e01_first_value(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("""WITH n AS (SELECT user_id, CAST(ts AS DATE) AS night, count(*) AS plates FROM events GROUP BY ALL)
SELECT user_id, night, plates, CAST(sum(plates) OVER (PARTITION BY user_id ORDER BY night) AS BIGINT) AS used, sum(plates) OVER (PARTITION BY user_id ORDER BY night) > 20 AS short FROM n""")
def e06_running_shortage(spark, d):
    """Plates per night drawn from 20 portions; short from the first night that asks for more than is left."""
    from larderflow.plans.coverage import running_shortage

    nights = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("night")).agg(F.count("*").alias("plates"))
    return running_shortage(nights, ["user_id"], "night", "plates", F.lit(20))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, o_orderkey, before FROM v WHERE before IS NOT NULL AND before <> o_orderstatus""")
def e08_changed_from_previous(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").withColumn("before", F.lag("o_orderstatus").over(w)).filter("before <> o_orderstatus").select("o_custkey", "o_orderkey", "before")


@query("""SELECT n_regionkey, s_suppkey, rank FROM (SELECT n_regionkey, s_suppkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS rank
  FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE rank <= 3""")
def f03_top_k_per_group(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return top_by(s, ["n_regionkey"], 3, F.desc_nulls_last("s_acctbal"), F.asc("s_suppkey")).select("n_regionkey", "s_suppkey", "rank")


@query("""SELECT p_partkey, score FROM (SELECT p_partkey, p_name, (CASE WHEN p_name LIKE 'red%' THEN 30 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 20 WHEN p_type = 'SMALL' THEN 5 ELSE 0 END
  - CASE WHEN p_size > 40 THEN 40 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 15 ELSE -15 END) AS score FROM part) ORDER BY score DESC, p_name, p_partkey LIMIT 25""")
def f05_scored_ranking(spark, d):
    """Integer scores in tenths, ties by title and id; the ranking keeps 25."""
    score = F.when(F.col("p_name").startswith("red"), 30).otherwise(0) + F.when(F.col("p_type") == "PROMO", 20).when(F.col("p_type") == "SMALL", 5).otherwise(0) - F.when(F.col("p_size") > 40, 40).otherwise(0) + F.when(F.col("p_partkey") % 2 == 0, 15).otherwise(-15)
    return table(spark, d, "part").withColumn("score", score).orderBy(F.desc("score"), "p_name", "p_partkey").limit(25).select("p_partkey", "score")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS minutes FROM part ORDER BY minutes ASC NULLS LAST, p_name, p_partkey LIMIT 40""")
def f06_unknown_last(spark, d):
    return table(spark, d, "part").withColumn("minutes", F.when(F.col("p_size") % 5 != 0, F.col("p_size"))).orderBy(F.asc_nulls_last("minutes"), "p_name", "p_partkey").limit(40).select("p_partkey", "minutes")


@query("""WITH u AS (SELECT o_custkey AS who, 'order' AS kind, o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders UNION ALL SELECT user_id, 'event', event_id, CAST(ts AS TIMESTAMP) FROM events)
SELECT who, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY t DESC, kind, id DESC) AS rn FROM u) WHERE rn = 1""")
def g01_union_latest(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    e = table(spark, d, "events").select(F.col("user_id").alias("who"), F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return latest_by(o.unionByName(e), ["who"], F.desc_nulls_last("at"), F.asc("kind"), F.desc("id")).select("who", "kind", "id")


@query("""SELECT k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 UNION SELECT p_partkey FROM part WHERE p_size = 1)""")
def g03_key_union(spark, d):
    l = table(spark, d, "lineitem")
    keys = l.filter("l_quantity > 45 or (l_returnflag = 'R' and l_discount > 0.08)").select(F.col("l_partkey").alias("k"))
    return keys.unionByName(table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("k"))).distinct()


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= '2000-01-01')""")
def g04_left_out(spark, d):
    sold = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(sold, "p_partkey", "left_anti")


@query("""SELECT user_id, CAST(date_trunc('week', d) AS DATE) AS week_start, count(*) AS n, CAST(min((isodow(d) - 1)) AS INTEGER) AS first_weekday FROM
  (SELECT user_id, CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) AS d FROM events) GROUP BY ALL""")
def h14_week_buckets(spark, d):
    """Weeks from Monday by the household's own calendar."""
    day = temporal.local_date(F.col("ts").cast("timestamp"), F.lit("America/New_York"))
    e = table(spark, d, "events").withColumn("d", day)
    return e.groupBy("user_id", temporal.week_start(F.col("d")).alias("week_start")).agg(F.count("*").alias("n"), F.min(F.weekday("d")).alias("first_weekday"))


@query("""SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS fingerprint FROM orders""")
def h17_fingerprint(spark, d):
    """Digest of canonical JSON: keys sorted, nulls kept."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", text.fingerprint({"priority": (F.col("o_orderpriority"), "string"), "custkey": (F.col("o_custkey"), "number"), "status": (status, "string")}).alias("fingerprint"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS domain FROM pages""")
def h29_domain(spark, d):
    return table(spark, d, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 'missing' WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'ordered'
  WHEN l_returnflag = 'A' THEN 'received' WHEN l_discount = 0 THEN 'nothing_needed' ELSE 'needs_review' END AS status FROM lineitem""")
def k03_status_ladder(spark, d):
    """The first rule that holds decides."""
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25), "missing").when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "ordered").when(F.col("l_returnflag") == "A", "received").when(F.col("l_discount") == 0, "nothing_needed").otherwise("needs_review")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", status.alias("status"))


@query("""SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def l01_stream_equals_batch(spark, d):
    """The latest status of each key, drained through a stream."""
    from larderflow.streaming import logs

    schema = table(spark, d, "events").schema
    return logs.drained(logs.latest_status(logs.feed(spark, f"{d}/event[s].parquet", schema), "user_id", "ts", "event_id", "event_type"), "latest", "complete")


@query("""WITH c AS (SELECT event_id AS seq, user_id || '-' || json_extract_string(props, '$.k') AS operation, event_type AS request FROM events)
SELECT seq, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN request = first_value(request) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM c WINDOW w AS (PARTITION BY operation ORDER BY seq)""")
def l03_dedup_conflict(spark, d):
    from larderflow.streaming import logs

    e = table(spark, d, "events")
    return logs.commands_batch(e.select(F.col("event_id").alias("seq"), F.concat_ws("-", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("operation"), F.col("event_type").alias("request")))


@query("""SELECT batch, started FROM (SELECT user_id AS batch, ts AS started, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
WHERE rn = 1 AND event_type = 'click' AND started < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 150 SECOND""")
def l05_timeout(spark, d):
    from larderflow.streaming import logs

    status = F.when(F.col("event_type") == "click", "dispatch_started").otherwise(F.col("event_type"))
    log = table(spark, d, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("at"))
    return logs.overdue(log, F.lit("2024-01-30 23:00:00").cast("timestamp_ntz")).withColumnRenamed("at", "started")
