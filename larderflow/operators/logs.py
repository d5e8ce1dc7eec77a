"""Histories, audits, commands and incremental projections as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.operators.relational import query, table
from larderflow.plans import histories
from larderflow.sources.shared import shared_path
from larderflow.streaming import commands, incremental
from larderflow.streaming.logs import drained, feed


@query("""WITH spans AS (SELECT o_orderkey, l_suppkey AS supplier, CAST(o_orderdate AS DATE) AS today, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INTEGER) AS pickup FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1),
nights AS (SELECT DISTINCT l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS night FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, count(*) AS n_early, min(night) AS first_night, max(night) AS last_night FROM spans JOIN nights ON nights.supplier = spans.supplier AND night >= today AND night < pickup GROUP BY o_orderkey""")
def c21_nights_before_pickup(spark, d):
    """Nights that need what an order brings before it is picked up: a join of dates with ranges, by bins."""
    first = table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("supplier"))
    today = F.col("o_orderdate").cast("date")
    spans = table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "supplier", today.alias("today"), F.date_add(today, (F.col("o_orderkey") % 20).cast("int")).alias("pickup"))
    nights = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("date").alias("night")).distinct()
    early = histories.within(nights, spans, ["supplier"], "night", "today", "pickup")
    return early.groupBy("o_orderkey").agg(F.count("*").alias("n_early"), F.min("night").alias("first_night"), F.max("night").alias("last_night"))


LINEAGE = """rows AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 37 = 0 THEN -o_orderkey ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS source, o_orderstatus AS quantity,
  CASE WHEN o_orderkey % 11 = 0 THEN 'exact' WHEN o_orderkey % 5 = 0 THEN 'legacy' END AS stated FROM orders)"""


@query(f"""WITH RECURSIVE {LINEAGE},
links AS (SELECT r.id, CASE WHEN r.stated IS NULL AND s.quantity = r.quantity THEN r.source END AS previous, coalesce(r.stated, 'exact') AS stated FROM rows r LEFT JOIN rows s ON s.id = r.source WHERE r.source IS NULL OR s.id IS NOT NULL),
walk AS (SELECT id, id AS origin, stated AS basis FROM links WHERE previous IS NULL UNION ALL SELECT l.id, w.origin, w.basis FROM walk w JOIN links l ON l.previous = w.id)
SELECT r.id, coalesce(w.basis, 'invalid') AS basis, w.origin FROM rows r LEFT JOIN walk w ON w.id = r.id""")
def k18_quantity_basis(spark, d):
    """The basis of every row along its lineage, each order of a customer made of the one before: it holds until the quantity changes."""
    k = F.col("o_orderkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, d, "orders").select(k.alias("id"), F.when(k % 37 == 0, -k).otherwise(before).alias("source"), F.col("o_orderstatus").alias("quantity"), F.when(k % 11 == 0, "exact").when(k % 5 == 0, "legacy").alias("stated"))
    return histories.basis(rows)


#: A stored decimal: q / k' in one of the known roundings, or moved by one unit of its last place, so that nothing explains it.
_ROUNDED = "CASE f WHEN 0 THEN (q * 20000 + k) // (2 * k) WHEN 1 THEN q * 1000000000000 // k WHEN 2 THEN (q * 2000000000000 + k) // (2 * k) WHEN 3 THEN q * 1000 // k ELSE q * 1000000000000 // k + 7 END"
_TEXT = "(v // s) || CASE WHEN v % s = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(v % s AS VARCHAR), CASE f WHEN 0 THEN 4 WHEN 3 THEN 3 ELSE 12 END, '0'), '0') END"
AUDIT = f"""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 5 + 2 AS k, (l_orderkey + l_linenumber) % 5 AS f, l_partkey % 3 AS ingredient FROM lineitem),
y AS (SELECT *, {_ROUNDED} AS v, CASE f WHEN 0 THEN 10000 WHEN 3 THEN 1000 ELSE 1000000000000 END AS s FROM x),
rows AS (SELECT *, {_TEXT} AS stored FROM y),
p AS (SELECT *, CASE WHEN contains(stored, '.') THEN length(split_part(stored, '.', 2)) ELSE 0 END AS places, CAST(replace(stored, '.', '') AS HUGEINT) AS digits FROM rows),
t AS (SELECT *, CAST(CAST(10 AS HUGEINT) ** places AS HUGEINT) AS ten FROM p),
simple AS (SELECT *, CASE WHEN places > 3 THEN list_filter(list_transform(range(2, 49), lambda d: {{'d': d, 'n': (digits * d * 2 + ten) // (2 * ten)}}), lambda x: x.n > 0 AND abs(x.n * ten - digits * x.d) * 2 < x.d)[1] END AS x FROM t),
drafts AS (SELECT l_orderkey, ingredient, q AS whole, k, unnest([(q * 20000 + k) // (2 * k), q * 1000000000000 // k, (q * 2000000000000 + k) // (2 * k)]) AS v, unnest([10000, 1000000000000, 1000000000000]) AS s, unnest(['4dp_half_up', CASE WHEN q * 1000000000000 % k = 0 THEN 'exact' ELSE '12dp_down' END, '12dp_half_up']) AS how FROM x WHERE l_linenumber % 2 = 1),
forms AS (SELECT *, CAST(v AS HUGEINT) * (1000000000000 // s) AS scaled FROM drafts),
e AS (SELECT l_orderkey, ingredient, scaled, count(DISTINCT whole) AS amounts, CAST(min(whole) AS VARCHAR) AS amount, min(list_position(['exact', '4dp_half_up', '12dp_half_up', '12dp_down'], how)) AS i FROM forms GROUP BY 1, 2, 3)
SELECT r.l_orderkey, r.l_linenumber, r.stored, CASE WHEN places <= 3 THEN 'short_decimal' WHEN places = 4 THEN 'rounded_4dp' WHEN places = 12 THEN 'rounded_12dp' ELSE 'long_decimal' END AS risk, r.x.n || '/' || r.x.d AS pattern,
  CASE WHEN amounts = 1 THEN 'import_draft' WHEN EXISTS (SELECT 1 FROM x WHERE x.l_orderkey = r.l_orderkey AND x.ingredient = r.ingredient AND x.l_linenumber % 2 = 1) THEN 'conflicting' ELSE 'missing' END AS evidence,
  CASE WHEN amounts = 1 THEN amount END AS amount, CASE WHEN amounts = 1 THEN ['exact', '4dp_half_up', '12dp_half_up', '12dp_down'][i] END AS matches
FROM simple r LEFT JOIN e ON e.l_orderkey = r.l_orderkey AND e.ingredient = r.ingredient AND e.scaled = CAST(r.v AS HUGEINT) * (1000000000000 // r.s)"""


@query(AUDIT)
def k16_legacy_audit(spark, d):
    """Every line's stored decimal: its risk, the simplest fraction that it may stand for, and which line of its draft explains it."""
    n = F.col("l_linenumber")
    x = table(spark, d, "lineitem").select("l_orderkey", n, F.col("l_quantity").cast("bigint").alias("q"), (n % 5 + 2).cast("bigint").alias("k"), ((F.col("l_orderkey") + n) % 5).alias("f"), (F.col("l_partkey") % 3).alias("ingredient"))
    spark_sql = lambda sql: F.expr(sql.replace("//", "div").replace("VARCHAR", "STRING"))
    rows = x.withColumns({"v": spark_sql(_ROUNDED), "s": F.expr("CASE f WHEN 0 THEN 10000L WHEN 3 THEN 1000L ELSE 1000000000000L END")}).withColumn("stored", spark_sql(_TEXT.replace("rtrim(lpad(CAST(v % s AS VARCHAR), CASE f WHEN 0 THEN 4 WHEN 3 THEN 3 ELSE 12 END, '0'), '0')", "rtrim('0', lpad(CAST(v % s AS VARCHAR), CASE f WHEN 0 THEN 4 WHEN 3 THEN 3 ELSE 12 END, '0'))")))
    rows = rows.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("draft"), "ingredient", F.lit("g").alias("unit"), "stored")
    drafts = x.filter(n % 2 == 1).select(F.col("l_orderkey").alias("draft"), "ingredient", F.lit("g").alias("unit"), F.col("q").alias("n"), F.lit(1).cast("bigint").alias("d"), F.col("k").alias("servings"))
    out = histories.draft_evidence(rows, drafts)
    return out.select("l_orderkey", "l_linenumber", "stored", histories.risk(F.col("stored")).alias("risk"), histories.simplest_fraction(F.col("stored")).alias("pattern"), "evidence", "amount", "matches")


@query("""WITH cuts AS (SELECT user_id, max(event_id) AS cut FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1),
seen AS (SELECT e.* FROM events e JOIN cuts USING (user_id) WHERE event_id <= cut), latest AS (SELECT user_id, event_type, max(event_id) AS seq, arg_max(value, event_id) AS value FROM seen GROUP BY 1, 2),
n AS (SELECT user_id, count(*) AS n_events FROM seen GROUP BY 1)
SELECT c.user_id, cut, n_events, string_agg(event_type || ':' || seq, ',' ORDER BY event_type) AS state, count(*) FILTER (WHERE seq > cut - 200) = count(*) AS coherent FROM cuts c JOIN n USING (user_id) JOIN latest USING (user_id) GROUP BY ALL""")
def a15_snapshot(spark, d):
    """Every household's state as of one sequence number, the last event of its first kind: what later events have changed isn't seen. Coherent: no part of it is
    more than 200 numbers older than the cut."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    kind = e.agg(F.min("event_type").alias("kind"))  # one row
    cuts = e.join(F.broadcast(kind), F.col("event_type") == F.col("kind")).groupBy("user_id").agg(F.max("event_id").alias("cut"))
    state = histories.as_of(e, ["user_id"], ["event_type"], "event_id", cuts)
    counts = e.join(cuts, "user_id").filter("event_id <= cut").groupBy("user_id").agg(F.count("*").alias("n_events"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "event_id"))), lambda x: F.concat_ws(":", x["event_type"], x["event_id"].cast("string"))), ",")  # a few kinds
    rows = state.join(cuts, "user_id").groupBy("user_id", "cut").agg(shown.alias("state"), F.bool_and(F.col("event_id") > F.col("cut") - 200).alias("coherent"))
    return rows.join(counts, "user_id").select("user_id", "cut", "n_events", "state", "coherent")


COMMANDS = """SELECT user_id AS household, event_id AS seq, CAST(event_id % 40 AS VARCHAR) AS operation, CAST(event_id % 2 AS VARCHAR) AS actor, event_type AS request, event_type AS entity, CAST(floor(value) AS INTEGER) % 3 AS expected FROM events"""
DECIDED = f"""WITH RECURSIVE c AS ({COMMANDS}),
m AS (SELECT *, CASE WHEN row_number() OVER w > 1 THEN CASE WHEN actor = first_value(actor) OVER w AND request = first_value(request) OVER w THEN 'replayed' ELSE 'operation_id_reused' END END AS again FROM c WINDOW w AS (PARTITION BY household, operation ORDER BY seq)),
o AS (SELECT *, row_number() OVER (PARTITION BY household, entity ORDER BY seq) AS i FROM m),
r AS (SELECT household, entity, i, seq, again, expected, CASE WHEN again IS NULL AND expected = 0 THEN 1 ELSE 0 END AS revision, 0 AS before FROM o WHERE i = 1
  UNION ALL SELECT o.household, o.entity, o.i, o.seq, o.again, o.expected, CASE WHEN o.again IS NULL AND o.expected = r.revision THEN r.revision + 1 ELSE r.revision END, r.revision FROM r JOIN o ON o.household = r.household AND o.entity = r.entity AND o.i = r.i + 1)
SELECT household, seq, entity, CASE WHEN again = 'replayed' THEN 'replayed' WHEN again IS NULL AND revision > before THEN 'accepted' ELSE 'rejected' END AS outcome, CASE WHEN again = 'replayed' OR again IS NULL AND revision > before THEN NULL ELSE coalesce(again, 'stale_revision') END AS code, CAST(revision AS INTEGER) AS revision FROM r"""


def _commands(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("household"), F.col("event_id").alias("seq"), (F.col("event_id") % 40).cast("string").alias("operation"), (F.col("event_id") % 2).cast("string").alias("actor"), F.col("event_type").alias("request"), F.col("event_type").alias("entity"), (F.floor("value").cast("int") % 3).alias("expected"))


@query(DECIDED)
def w01_commands_decided(spark, d):
    """Every command accepted, replayed or rejected with a code: operation ids are asked once, and each entity has a revision that a command must know."""
    return commands.decided(_commands(spark, d))


@query(DECIDED)
def w02_commands_streamed(spark, d):
    """The same by a stream with state: batches come as the log was written."""
    log = shared_path(spark, "commands")
    rows = _commands(spark, d)
    rows.repartitionByRange(2, "seq").sortWithinPartitions("seq").write.parquet(log)
    return drained(commands.decided_stream(feed(spark, log, rows.schema, files_per_trigger=10_000)), "decided", stateful=True).select("household", "seq", "entity", "outcome", "code", "revision")


@query("SELECT user_id % 8 AS bucket, user_id, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL")
def l08_incremental_projection(spark, d):
    """A projection of events kept up to date by a stream of their log in two parts; the second touches three of eight partitions and leaves the others alone."""
    log = shared_path(spark, "changes")
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("bucket"), "user_id", "event_type", "event_id")
    late = (F.col("bucket") < 3) & (F.col("event_id") % 5 == 0)
    project = lambda rows: rows.groupBy("bucket", "user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    out = shared_path(spark, "projection")
    for part in (e.filter(~late), e.filter(late)):
        part.write.mode("append").parquet(log)
        incremental.kept_up(feed(spark, log, e.schema, files_per_trigger=10_000), lambda: spark.read.schema(e.schema).parquet(log), project, "bucket", out)
    return spark.read.schema("user_id long, event_type string, n long, last long, bucket long").parquet(out).select("bucket", "user_id", "event_type", "n", "last")
