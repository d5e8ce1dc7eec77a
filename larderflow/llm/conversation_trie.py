"""The trie of all conversations' beginnings, with counts rolled up from its leaves.

The fingerprint of a conversation's first d turns is a polynomial in two primes of some 31 bits, H(d) = H(d-1) * base + turn. Numpy scans find those of
every conversation as it stands; a rebuilt one begins with another's first turns, and H of a joined sequence follows from H of its two parts, so nothing
is scanned again. Rows with one depth and fingerprint are candidates for one node. Each turn of each member is compared with that of the group's
representative (as the least and greatest of the turns' SHA-256 values, by groups that are summed before they are shuffled: equal ones are all the
representative's); a group that two sequences share is compared turn by turn and split.

What a node sums over its subtree is summed over its members instead: each node counts for its representative, its least member, once. So one grouping
gives what a walk up from the leaves would take as many rounds as there are turns for.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm.common import materialised, without_words

#: Two primes below 2 ** 31, each with the base of its polynomials.
PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 69_069_069))
#: A conversation gets at most HEAD - 1 of the first turns of the conversation that its block of BLOCK begins with.
HEAD, BLOCK = 6, 100
#: Ids that one step of a digest takes as one string.
CHUNK = 65_536
NODE = ["depth", "fp", "split"]
KEYS = ["k1", "k2", "k3", "k4"]


@dataclass(frozen=True)
class Scan:
    """x(i) = base * x(i-1) + value(i), from x(0) = 0: plain sums with base 1 and modulus 0. power: the scan of base ** i - 1, which others of this base need."""

    name: str
    base: int = 1
    modulus: int = 0
    power: str | None = None


def local_scan(values: np.ndarray, rank: np.ndarray, scan: Scan) -> np.ndarray:
    """The scan over runs that follow each other; rank: 1, 2, .. in each run."""
    if scan.modulus == 0:
        total = np.cumsum(values)
        before = np.where(rank == 1, total - values, 0)
        at = np.maximum.accumulate(np.where(rank == 1, np.arange(len(rank)), 0))
        return total - before[at]
    x, step, factor = values % scan.modulus, 1, scan.base % scan.modulus
    while step < (rank.max() if len(rank) else 0):
        far = np.flatnonzero(rank > step)
        x[far] = (x[far] + factor * x[far - step]) % scan.modulus
        step, factor = 2 * step, factor * factor % scan.modulus
    return x


def joined(x: int | np.ndarray, carry: int | np.ndarray, power: int | np.ndarray, scan: Scan) -> int | np.ndarray:
    """The scan's value where a run with `carry` stands before it; power: base ** i - 1 at that place."""
    return x + carry if scan.modulus == 0 else (x + (power + 1) % scan.modulus * carry) % scan.modulus


def scanned(rows: DataFrame, key: str, order: list, scans: list[Scan], name: str) -> DataFrame:
    """rows (a column of values for each scan, replaced by the scan along `order` within equal `key`, a long that isn't null).

    Rows are dealt out by ranges of (key, order), so that a key with many rows is many tasks' work. Each task scans what it has; the first run of each then
    gets what the tasks before it have left of the same key: one row of totals for each task goes by the driver. Scans come after their powers."""
    spark, names = rows.sparkSession, [s.name for s in scans]

    def run(batches):
        without_words()
        part, open_key, seen, held, first_key = TaskContext.get().partitionId(), None, 0, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(key).to_numpy()
            begins = np.flatnonzero(np.diff(k, prepend=k[:1] - 1))
            rank = np.arange(len(k)) - np.repeat(begins, np.diff(np.append(begins, len(k)))) + 1
            first_key = k[0] if first_key is None else first_key
            again = k == open_key if open_key is not None else np.zeros(len(k), bool)
            again &= np.cumsum(np.diff(k, prepend=k[:1]) != 0) == 0
            out, powers = {}, {}
            for s in scans:
                x = local_scan(batch.column(s.name).to_numpy().copy(), rank, s)
                powers[s.name] = x.copy()
                if again.any():
                    x[again] = joined(x[again], held[s.name], powers[s.power][again] if s.power else 0, s)
                out[s.name] = x
            rank[again] += seen
            open_key, seen, held = k[-1], int(rank[-1]), {n: int(x[-1]) for n, x in out.items()}
            rest = [c for c in batch.schema.names if c not in names]
            yield pa.record_batch([*(batch.column(c) for c in rest), *(pa.array(out[n]) for n in names), pa.array(np.full(len(k), part, "i4")), pa.array(k == first_key), pa.array(rank)], [*rest, *names, "_part", "_first", "_rank"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in rows.columns if c not in names]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), *(f"{x} long" for x in names)]) + ", _part int, _first boolean, _rank long"
    dealt = rows.select(*kept, *(F.col(x).cast("long") for x in names)).repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    found = materialised(dealt.mapInArrow(run, schema), name)
    # the last row of a task is the last of its last key; whether it is of its first key too, it says itself
    last = {r["_part"]: r["last"] for r in found.groupBy("_part").agg(F.max_by(F.struct(key, "_first", *names), F.struct(key, "_rank")).alias("last")).collect()}
    first = {r["_part"]: r["k"] for r in found.groupBy("_part").agg(F.min(key).alias("k")).collect()}
    carries, carry = [], None
    for part in sorted(last):
        here = carry if carry is not None and carry[key] == first[part] else None
        if here is not None:
            carries.append((part, *(here[x] for x in names)))
        end = {key: last[part][key], **{x: last[part][x] for x in names}}
        if here is not None and last[part]["_first"]:
            end |= {s.name: int(joined(last[part][s.name], here[s.name], last[part][s.power] if s.power else 0, s)) for s in scans}
        carry = end
    if not carries:
        return found.drop("_part", "_first", "_rank")
    table = spark.createDataFrame(carries, "_at int, " + ", ".join(f"_c_{x} long" for x in names))  # at most a row for each task
    whole = found.join(F.broadcast(table), F.col("_first") & (F.col("_part") == F.col("_at")), "left")

    def value(s: Scan) -> Column:
        c, x = F.coalesce(f"_c_{s.name}", F.lit(0)), F.col(s.name)
        return (x + c if s.modulus == 0 else (x + (F.col(s.power) + 1) % s.modulus * c) % s.modulus).alias(s.name)

    return whole.select(*kept, *(value(s) for s in scans))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, k1 to k4 (the SHA-256 of role and text), points (code points of the text); null role and text are empty, rows without conv_id go."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), sha.alias("sha"), F.length(text).cast("long").alias("points"))
    return rows.select("conv_id", "turn", "points", *(F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(k) for i, k in enumerate(KEYS)))


def numbers(key: Column, primes: tuple) -> list[Column]:
    """A turn's values in the polynomials, from 1 on."""
    return [F.pmod(key, F.lit(p - 1)) + 1 for p, _ in primes]


def placed(rows: DataFrame, primes: tuple) -> DataFrame:
    """Adds pos (from 1, by turn, null first; equal turns by their values, equal rows in any order), f1, f2 (fingerprints up to here), p1, p2 (base ** pos - 1)."""
    (m1, b1), (m2, b2) = primes
    one, two = numbers(F.col("k1"), primes)
    scans = [Scan("pos"), Scan("p1", b1, m1, "p1"), Scan("p2", b2, m2, "p2"), Scan("f1", b1, m1, "p1"), Scan("f2", b2, m2, "p2")]
    rows = rows.withColumns({"pos": F.lit(1), "p1": F.lit(b1 - 1), "p2": F.lit(b2 - 1), "f1": one, "f2": two, "salt": F.xxhash64(F.monotonically_increasing_id())})
    return scanned(rows, "conv_id", [F.col("turn").asc_nulls_first(), *KEYS, "salt"], scans, "turns").drop("salt", "turn")


def as_fingerprint(one: Column, two: Column) -> Column:
    return one * (1 << 31) + two


def rebuilt(conversations: DataFrame, primes: tuple = PRIMES) -> DataFrame:
    """conv_id, depth, fp, prev (the fingerprint a turn before), k1 to k4, points, ends (1 on the last row): every rebuilt conversation, a row for each
    beginning of it, from depth 0 on."""
    rows = materialised(placed(turns(conversations), primes), "placed")
    head = F.col("pos") < HEAD
    own = rows.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(head, F.struct("pos", "f1", "f2", "points", *KEYS)))).alias("heads"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    own = own.withColumns({"h": h, "base_id": F.col("conv_id") - F.col("conv_id") % BLOCK})
    bases = own.filter(F.col("conv_id") == F.col("base_id")).select(F.col("conv_id").alias("base_id"), F.col("heads").alias("base_heads"))
    info = own.join(bases, "base_id", "left").withColumn("given", F.least("h", F.coalesce(F.size("base_heads"), F.lit(0)).cast("long")))

    def up_to(heads: str, n: str, f: str) -> Column:
        return F.coalesce(F.when(F.col(n) > 0, F.try_element_at(heads, F.least(F.col(n), F.size(heads)).cast("int")).getField(f)), F.lit(0))

    info = info.select("conv_id", "h", "given", "base_heads", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"), *(F.pmod(up_to("base_heads", "given", f) - up_to("heads", "h", f), F.lit(m)).alias(f"shift_{f}") for f, (m, _) in zip(("f1", "f2"), primes, strict=True)))
    info = materialised(info, "conversations")

    # own turns: what stands before them is exchanged in the fingerprint, times base ** (turns since)
    after = rows.join(info.drop("base_heads"), "conv_id").filter(F.col("pos") > F.col("h"))
    for f, p, (m, b) in zip(("f1", "f2"), ("p1", "p2"), primes, strict=True):
        back = F.element_at(F.array(*(F.lit(pow(b, -i, m)) for i in range(HEAD))), (F.col("h") + 1).cast("int"))
        since = (F.col(p) + 1) % m * back % m
        after = after.withColumn(f, (F.col(f) + F.col(f"shift_{f}") * since) % m)
    after = after.select("conv_id", (F.col("given") + F.col("pos") - F.col("h")).alias("depth"), "f1", "f2", "points", *KEYS, "total")
    given = info.filter("given > 0").select("conv_id", "total", F.explode(F.slice("base_heads", F.lit(1), F.col("given").cast("int"))).alias("t")).select("conv_id", F.col("t.pos").alias("depth"), *(f"t.{c}" for c in ("f1", "f2", "points", *KEYS)), "total")
    one, two = numbers(F.col("k1"), primes)
    (m1, b1), (m2, b2) = primes
    before = as_fingerprint(*(F.pmod(F.col(f) - t, F.lit(m)) * pow(b, -1, m) % m for f, t, m, b in (("f1", one, m1, b1), ("f2", two, m2, b2))))
    shared = given.unionByName(after).select("conv_id", "depth", as_fingerprint(F.col("f1"), F.col("f2")).alias("fp"), before.alias("prev"), *KEYS, "points", (F.col("depth") == F.col("total")).cast("long").alias("ends"))
    zero = F.lit(0).cast("long")
    roots = info.select("conv_id", zero.alias("depth"), zero.alias("fp"), zero.alias("prev"), *(zero.alias(k) for k in KEYS), zero.alias("points"), (F.col("total") == 0).cast("long").alias("ends"))
    return materialised(roots.unionByName(shared).withColumns({"split": zero, "prev_split": zero}), "beginnings")


def grouped(rows: DataFrame) -> DataFrame:
    """The groups of rebuilt() rows, with the least and greatest of what all members must share."""
    alike = ["prev", "prev_split", *KEYS]
    return rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("points").alias("points"), F.sum("ends").alias("n_ends"), *(F.min(c).alias(c) for c in alike), *(F.max(c).alias(f"top_{c}") for c in alike))


def mixed() -> Column:
    return reduce(lambda a, b: a | b, (F.col(c) != F.col(f"top_{c}") for c in ("prev", *KEYS)))


def split(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """rows with the groups that different sequences share, `bad`, split, and all groups below them.

    Each round compares what is left of a group, turn by turn, with its least member, and takes out the equal ones: as many rounds as a fingerprint has sequences.
    A split node has the fingerprint -1 and, as `split`, its least member."""
    first = rows.join(bad.select("depth", "fp"), ["depth", "fp"]).groupBy("conv_id").agg(F.min("depth").alias("first"))
    doubtful = materialised(rows.join(first, "conv_id"), "doubtful")
    sequence = doubtful.filter("depth > 0").select("conv_id", "depth", *KEYS)
    left = doubtful.filter("depth >= first").select("conv_id", "depth", "fp")
    decided = []
    while True:
        least = left.groupBy("depth", "fp").agg(F.min("conv_id").alias("leader"))
        pairs = left.join(least, ["depth", "fp"])
        spans = pairs.groupBy("conv_id", "leader").agg(F.max("depth").alias("upto"))
        theirs = sequence.select(F.col("conv_id").alias("leader"), F.col("depth").alias("turn_no"), *(F.col(k).alias(f"its_{k}") for k in KEYS))
        ours = spans.join(sequence.withColumnRenamed("depth", "turn_no"), "conv_id").filter("turn_no <= upto").join(theirs, ["leader", "turn_no"])
        wrong = ours.filter(" or ".join(f"{k} <> its_{k}" for k in KEYS)).groupBy("conv_id", "leader").agg(F.min("turn_no").alias("wrong"))
        told = materialised(pairs.join(wrong, ["conv_id", "leader"], "left").select("conv_id", "depth", "fp", "leader", F.coalesce(F.col("wrong") > F.col("depth"), F.lit(True)).alias("equal")), "told")
        decided.append(told.filter("equal").select("conv_id", "depth", "leader"))
        left = told.filter("not equal").select("conv_id", "depth", "fp")
        if not left.limit(1).count():
            break
    leaders = materialised(reduce(DataFrame.unionByName, decided), "leaders")
    above = leaders.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("leader").alias("above"))
    out = rows.join(leaders, ["conv_id", "depth"], "left").join(above, ["conv_id", "depth"], "left")
    new = {"fp": F.when(F.col("leader").isNull(), F.col("fp")).otherwise(-1), "split": F.coalesce("leader", "split"), "prev": F.when(F.col("above").isNull(), F.col("prev")).otherwise(-1), "prev_split": F.coalesce("above", "prev_split")}
    return materialised(out.withColumns(new).drop("leader", "above"), "beginnings")


def end_digests(rows: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of nodes at which a conversation ends: the SHA-256 of their ids, ascending.

    A digest takes its ids one after another, so a node's digest is one task's work; but the ids come to it as CHUNK of them in a string, sorted and written by many tasks."""

    def chunks(batches):
        held, now = [], None
        for batch in batches:
            d, f, s, c = (batch.column(x).to_numpy() for x in (*NODE, "conv_id"))
            cuts = [0, *(np.flatnonzero((np.diff(d) != 0) | (np.diff(f) != 0) | (np.diff(s) != 0)) + 1).tolist(), len(d)]
            keys, firsts, lists = [], [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                node = (int(d[a]), int(f[a]), int(s[a]))
                if now is not None and (node != now or len(held) >= CHUNK):
                    keys.append(now)
                    firsts.append(held[0])
                    lists.append(",".join(map(str, held)))
                    held = []
                now = node
                held += c[a:b].tolist()
            if keys:
                yield chunk_batch(keys, firsts, lists)
        if now is not None:
            yield chunk_batch([now], [held[0]], [",".join(map(str, held))])

    def chunk_batch(keys, firsts, lists):
        return pa.record_batch([*(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array(firsts, pa.int64()), pa.array(lists, pa.string())], [*NODE, "first", "ids"])

    def digests(batches):
        now, state, keys, out = None, None, [], []
        for batch in batches:
            for d, f, s, ids in zip(*(batch.column(x).to_pylist() for x in (*NODE, "ids")), strict=True):
                if (d, f, s) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        out.append(state.hexdigest())
                    now, state = (d, f, s), hashlib.sha256()
                state.update(ids.encode())
            if keys:
                yield digest_batch(keys, out)
                keys, out = [], []
        if now is not None:
            yield digest_batch([now], [state.hexdigest()])

    def digest_batch(keys, out):
        return pa.record_batch([*(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array(out, pa.string())], [*NODE, "ends_sha256"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.filter("ends = 1").select(*NODE, "conv_id").repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    lists = ends.mapInArrow(chunks, "depth long, fp long, split long, first long, ids string")
    return lists.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, fp long, split long, ends_sha256 string")


def trie(conversations: DataFrame, primes: tuple = PRIMES) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations (conv_id, turn, role, text; other columns are ignored).

    conv_id is the least member, parent_conv_id that of the beginning a turn shorter (null for the root); n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 as op12_conversation_trie says. Rows whose conv_id is null are left out; a conversation's equal turns go by their values, and repeated rows
    count each. conv_id % 100 has the sign of conv_id. An empty table has no root."""
    rows = rebuilt(conversations, primes)
    groups = materialised(grouped(rows), "groups")
    bad = groups.filter(mixed())
    if bad.limit(1).count():
        rows = split(rows, bad)
        groups = materialised(grouped(rows), "groups")
    saved = (F.col("n_convs") - 1) * F.col("points")
    childless = (F.col("n_ends") == F.col("n_convs")).cast("long")
    leaders = groups.groupBy("conv_id").agg(F.sum(saved).alias("saved"), F.max(childless).alias("leaf"))
    # a node's sums over its subtree: those of its members, less what its representative has saved above it
    member_sums = rows.select("conv_id", *NODE).join(leaders, "conv_id")
    above = scanned(groups.filter("n_convs > 1").select("conv_id", *NODE, saved.alias("up_to"), saved.alias("here")), "conv_id", ["depth"], [Scan("up_to")], "saved")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    parts = [
        groups.select(*NODE, *(F.col(c).alias(f"_{c}") for c in ("conv_id", "prev", "prev_split", "n_convs", "n_ends")), zero.alias("children"), zero.alias("leaves"), zero.alias("saved")),
        groups.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp"), F.col("prev_split").alias("split"), *(none.alias(f"_{c}") for c in ("conv_id", "prev", "prev_split", "n_convs", "n_ends")), F.lit(1).cast("long").alias("children"), zero.alias("leaves"), zero.alias("saved")),
        member_sums.select(*NODE, *(none.alias(f"_{c}") for c in ("conv_id", "prev", "prev_split", "n_convs", "n_ends")), zero.alias("children"), F.col("leaf").alias("leaves"), "saved"),
        above.select(*NODE, *(none.alias(f"_{c}") for c in ("conv_id", "prev", "prev_split", "n_convs", "n_ends")), zero.alias("children"), zero.alias("leaves"), (F.col("here") - F.col("up_to")).alias("saved")),
    ]
    sums = reduce(DataFrame.unionByName, parts).groupBy(*NODE).agg(*(F.max(f"_{c}").alias(c) for c in ("conv_id", "prev", "prev_split", "n_convs", "n_ends")), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    nodes = materialised(sums, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev"), F.col("split").alias("prev_split"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["depth", "prev", "prev_split"], "left").join(end_digests(rows), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.when(F.col("n_convs") == 1, F.lit(0)).otherwise(F.col("saved")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trie() of `conversations`, each rebuilt: the first h turns of the conversation whose id is conv_id - conv_id % 100, then its own turns after its first h;
    h is crc32 of the id as text, mod 6. Null roles and texts are empty; extra columns are left out; an empty table gives an empty one."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 of an id's decimal text, bit by bit; every beginning is the joined SHA-256 values of its turns; a node's subtree are the nodes that begin with it.
ORACLE = """
with o as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
    coalesce(text, '') as text, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 100 as base_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda b: ascii(b)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)), 4294967295::bigint) % 6 as h
  from (select distinct conv_id from o)),
r as (
  select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, text, k from (
    select c.conv_id, 0 as own, o.pos, o.text, o.k from c join o on o.conv_id = c.base_id and o.pos <= c.h
    union all select c.conv_id, 1, o.pos, o.text, o.k from c join o on o.conv_id = c.conv_id and o.pos > c.h)),
b as (
  select conv_id, depth, string_agg(k, '') over (partition by conv_id order by depth) as path, length(text) as points, depth = max(depth) over (partition by conv_id) as ends from r
  union all select conv_id, 0, '', 0, conv_id not in (select conv_id from r) from c),
n as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, max(points) as points, count(*) filter (where ends) as n_ends, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from b group by path, depth),
t as (
  select left(path, 64 * d) as path, sum((n_ends = n_convs)::bigint) as n_leaves, sum((n_convs - 1) * points) as saved_tokens from (select n.*, unnest(range(0, depth + 1)) as d from n) group by 1)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, (select count(*) from n m where m.depth = n.depth + 1 and left(m.path, 64 * n.depth) = n.path) as n_children,
  t.n_leaves::bigint as n_leaves, t.saved_tokens::bigint as saved_tokens, n.ends_sha256
from n join t on t.path = n.path left join n p on n.depth > 0 and p.path = left(n.path, 64 * (n.depth - 1)) and p.depth = n.depth - 1
"""
