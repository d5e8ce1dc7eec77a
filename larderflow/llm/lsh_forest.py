"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Copies (equal shingle sets) become one class first, whatever their number.
2. The signatures of class representatives stand in prefix tries. The prefix that two of them must share is shortened from the full depth until the
   expected recall at the threshold reaches the target; where a node of that depth is crowded, its subtree is descended again, node by node, to the
   shortest prefixes that are not. What remains crowded at the full depth is compared block by block.
3. Members of a leaf whose signatures agree enough are candidates. Only a spanning forest of them leaves a task, so no leaf emits its pairs, and
   unlike texts that share a prefix by chance chain nothing together. A group that several tries have is looked at once.
4. Connected candidates form clusters; within a cluster all pairs are verified from the shingle sets, large clusters block by block. Links are
   counted, not listed: what leaves a task is one row per representative, with its number of links and its local component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.llm.common import documents, materialised, opened, repeated_ids, runs, sealed, sieved, steps, text_map
from larderflow.llm.substring import window_hashes, words_of
from larderflow.llm.words import mix

WORDS = 5
THRESHOLD = 0.8
#: Tries, and values of a full signature in each. At the full depth a pair at the threshold still meets with a probability of 0.97.
TRIES, DEPTH = 20, 8
RECALL = 0.9999
#: How far below the threshold the share of equal signature values may be: over four standard deviations at 160 values.
MARGIN = 0.15
#: Members of a node beyond which it is crowded.
CROWDED = 256
#: Parts that the edges of every node are joined in, when components are found.
HUB_PARTS = 16
#: Representatives and shingles of a block of a large cluster, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 250_000


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words; of all words together, if fewer; none without a word."""
    words = words_of(text)
    return np.unique(window_hashes(words, min(n, len(words)))) if words else np.zeros(0, "u8")


def signature(s: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (32 bits) of a shingle set under `size` linear maps modulo 2^64."""
    k = np.arange(1, size + 1, dtype="u8")
    a, b = mix(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(k * np.uint64(0xC2B2AE3D27D4EB4F))
    best = np.full(size, 2**64 - 1, "u8")
    for i in range(0, len(s), 2048):
        best = np.minimum(best, (s[i : i + 2048, None] * a + b).min(0))
    return (best >> np.uint64(32)).astype("u4")


def depth_for(threshold: float, tries: int = TRIES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The full depth, shortened until a pair at the threshold meets in at least one trie with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** tries < recall:
        depth -= 1
    return depth


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its connected component) of edges (u, v), by alternating large and small stars; edges are only ever joined and
    aggregated, so a node with very many neighbours is no group."""
    now = materialised(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = None
    while True:
        # the least neighbour is told to each part of a node's edges: a hub's edges are in several tasks
        both = now.union(now.select("v", "u")).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS)).cast("int"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))).alias("part"))
        large = both.filter("v > u").join(low, ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = materialised(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = state


def signatures(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, size and two hashes of the shingle set, and the signature, for every row of docs (doc_id, text)."""

    def step(batches):
        for batch in steps(batches, "text"):
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            h1 = np.array([int(mix(s).sum(dtype="u8")) for s in sets], "u8").view("i8")
            h2 = np.array([int(mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype="u8")) for s in sets], "u8").view("i8")
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), pa.array([signature(s, TRIES * DEPTH).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "size", "h1", "h2", "sig"])

    return text_map(docs.select("doc_id", "text"), step, "doc_id long, size long, h1 long, h2 long, sig binary")


def leaves(reps: DataFrame, shortest: int, crowded: int) -> DataFrame:
    """(node, leaf, c): for every representative (node, sig) and trie the node of the trie that it is compared in, and its number of members, 2 or more.

    That is the node at the shortest prefix, or below it the first on the way down with at most `crowded` members, or the one at the full depth."""

    def keys(rows: DataFrame, depth: int) -> DataFrame:
        return rows.withColumn("leaf", F.xxhash64("trie", F.lit(depth), F.expr(f"substring(sig, trie * {4 * DEPTH} + 1, {4 * depth})")))

    at = keys(reps.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))).alias("trie")), shortest).select("node", "trie", "leaf")
    closed = None
    for depth in range(shortest, DEPTH + 1):
        met = at.groupBy("leaf").agg(F.count("*").alias("c")).filter("c > 1")
        level = materialised(at.join(met, "leaf"), f"trie-{depth}")
        full = F.lit(depth == DEPTH)
        here = level.filter((F.col("c") <= crowded) | full).select("node", "leaf", "c")
        closed = here if closed is None else closed.unionByName(here)
        deeper = level.filter((F.col("c") > crowded) & ~full)
        if depth == DEPTH or not deeper.limit(1).count():
            break
        at = keys(deeper.select("node", "trie").join(reps.select("node", "sig"), "node"), depth + 1).select("node", "trie", "leaf")
    return closed


def alike(sigs: np.ndarray, ids: np.ndarray, block: np.ndarray, least: float, crossed: bool) -> np.ndarray:
    """The local root of each member, over pairs (of one block, or of two if `crossed`) with at least this share of equal signature values."""
    linked = np.zeros((len(ids), len(ids)), bool)
    for a in range(0, len(ids), 64):
        linked[a : a + 64] = (sigs[a : a + 64, None] == sigs).mean(2) >= least
    if crossed:
        linked &= block[:, None] != block
    return least_root(ids, linked)


def least_root(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The least id that links lead to."""
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(linked, root, np.iinfo("i8").max).min(1))
        if (low == root).all():
            return root
        root = low


def candidates(reps: DataFrame, threshold: float, crowded: int) -> DataFrame:
    """Edges (u, v) between representatives (node, sig) that meet in the forest with signatures alike enough: of each leaf a spanning forest."""
    met = materialised(leaves(reps, depth_for(threshold), crowded), "forest")
    # a group that several tries have is looked at once
    groups = met.groupBy("leaf").agg(F.max("c").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = groups.groupBy("c", "x", "y").agg(F.min("leaf").alias("leaf")).select("leaf", F.ceil(F.col("c") / crowded).cast("int").alias("blocks"))
    # one byte of each value: the first of its four
    short = reps.select("node", F.expr(f"unhex(array_join(transform(sequence(0, {TRIES * DEPTH - 1}), i -> hex(substring(sig, 4 * i + 1, 1))), ''))").alias("sig"))
    placed = met.select("node", "leaf").join(once, "leaf").join(short, "node").withColumn("block", F.pmod(F.xxhash64("node", "leaf"), "blocks").cast("int"))
    work = worked(placed.withColumnRenamed("leaf", "cluster")).select("work", "node", "block", "crossed", "sig")

    def match(batches):
        for _, rows in runs(batches, "work"):
            ids, block, crossed = rows.column("node").to_numpy(), rows.column("block").to_numpy(), rows.column("crossed")[0].as_py()
            sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "u1").reshape(len(ids), -1)
            root = alike(sigs, ids, block, threshold - MARGIN, crossed)
            kept = np.flatnonzero(root != ids)
            if len(kept):
                yield pa.record_batch([pa.array(ids[kept]), pa.array(root[kept])], ["u", "v"])

    return work.repartition("work").sortWithinPartitions("work").mapInArrow(match, "u long, v long").distinct()


def worked(placed: DataFrame) -> DataFrame:
    """Rows (cluster, block, blocks, ...) dealt to the pieces of work that they take part in: a pair of blocks (i, j), i <= j, of a cluster is one; a
    cluster of one block is the piece (0, 0). Whether a piece is crossed is told by its blocks' numbers, not by the members present: a block may be empty."""
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.withColumns({"work": F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")), "crossed": F.col("block") != F.col("other")})


def verified(ids: np.ndarray, block: np.ndarray, sets: list[np.ndarray], threshold: float, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of links, local root) of each member, of pairs within a block or, if `crossed`, between two."""
    n, sizes = len(ids), np.fromiter(map(len, sets), "i8", len(sets))
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((n, n), "f4")
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x = np.zeros((n, min(width, int(column[-1]) + 1 - a)), "f4")
        x[row[lo:hi], column[lo:hi] - a] = 1
        inter += x @ x.T
    union = sizes[:, None] + sizes - inter
    linked = inter >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if crossed:
        linked &= block[:, None] != block
    return linked.sum(1), least_root(ids, linked)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, class_id (the least doc_id that links of Jaccard similarity >= threshold lead to), copy_id (the
    least doc_id with the same shingle set), n_links (how many different shingle sets it is linked to) and n_copies (rows with its set).

    Null and empty texts have no shingles: each is its own class without links. Rows with a null doc_id have the class of their text, if another row
    has it, else null. Repeated rows are copies. Other columns are ignored."""
    sig = materialised(signatures(docs, n), "signatures")
    reps = materialised(sig.filter("size > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("sig").alias("sig")), "representatives")
    # the same doc_id may stand for several sets if rows repeat it: nodes are sets
    node = F.col("rep")
    many = bool(reps.groupBy("rep").count().filter("count > 1").limit(1).count())
    reps = reps.withColumn("node", F.xxhash64("h1", "h2") if many else node)
    clusters = components(candidates(reps, threshold, CROWDED))
    members = materialised(reps.join(clusters.withColumnRenamed("root", "cluster"), "node").select("node", "rep", "h1", "size", "cluster"), "members")
    shape = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(shape, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # texts of the members only
    touched = sieved(docs.select("doc_id", "text"), members.select(F.col("rep").alias("doc_id")), ["doc_id"]).filter("_touched").select("doc_id", "text")
    texts = touched.join(placed.withColumnRenamed("rep", "doc_id"), "doc_id")

    def sets_of(batches):
        for batch in steps(batches, "text"):
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            h1 = np.array([int(mix(s).sum(dtype="u8")) for s in sets], "u8").view("i8")
            same = np.flatnonzero(h1 == batch.column("h1").to_numpy())
            at = pa.array(same)
            yield pa.record_batch([*(batch.column(c).take(at) for c in ("node", "cluster", "block", "blocks")), pa.array([sets[i].tobytes() for i in same.tolist()], pa.binary())], ["node", "cluster", "block", "blocks", "set"])

    sets = text_map(texts.select("node", "h1", "cluster", "block", "blocks", "text"), sets_of, "node long, cluster long, block int, blocks int, set binary")
    pairs = worked(sets).select("work", "node", "block", "crossed", "set")

    def verify(batches):
        for _, rows in runs(batches, "work"):
            ids, first = np.unique(rows.column("node").to_numpy(), return_index=True)
            if len(ids) > 1:
                held = rows.take(pa.array(first))
                block, crossed = held.column("block").to_numpy(), held.column("crossed")[0].as_py()
                if crossed and block.min() == block.max():
                    continue  # the other block is empty
                links, root = verified(ids, block, [np.frombuffer(x, "u8") for x in held.column("set").to_pylist()], threshold, crossed)
                yield pa.record_batch([pa.array(ids), pa.array(root), pa.array(links.astype("i8"))], ["u", "v", "links"])

    linked = materialised(pairs.repartition("work").sortWithinPartitions("work").mapInArrow(verify, "u long, v long, links long"), "links")
    if shape.filter("blocks > 1").limit(1).count():
        roots = components(linked.select("u", "v"))
    else:
        roots = linked.select(F.col("u").alias("node"), F.col("v").alias("root"))
    counts = linked.groupBy("u").agg(F.sum("links").alias("n_links")).withColumnRenamed("u", "node")
    named = reps.join(roots, "node", "left").join(counts, "node", "left").select("h1", "h2", F.col("rep").alias("copy_id"), F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    if many:
        least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
        named = named.join(least, "root")
    else:
        named = named.withColumn("class_id", F.col("root"))
    out = sig.select("doc_id", "h1", "h2", "size").join(named.drop("root"), ["h1", "h2"], "left")
    alone = F.col("size") == 0
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """docs without the rows whose class has a row with a smaller doc_id. Of rows that repeat the kept doc_id one stays; rows with a null doc_id stay;
    texts without words, null ones among them, are no one's duplicates. Other columns are handed on unchanged, whatever their names."""
    columns, docs = docs.columns, sealed(docs)
    classes = near_duplicates(docs, threshold, n)
    if repeated_ids(docs):
        kept = materialised(classes.filter("doc_id = class_id").select("doc_id").distinct(), "kept")
        marked = docs.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
        out = marked.filter("doc_id is null").drop("n").unionByName(marked.filter("n = 1").drop("n").join(kept, "doc_id", "left_semi"))
    else:
        gone = materialised(classes.filter("doc_id <> class_id").select("doc_id").distinct(), "gone")
        marked = sieved(docs, gone, ["doc_id"])
        out = marked.filter("not _touched").drop("_touched").unionByName(marked.filter("_touched").drop("_touched").join(gone, "doc_id", "left_anti"))
    return out.select(*opened(columns))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of `documents`: a row for each row. Null and empty texts are classes of their own, repeated rows are copies, a null doc_id has
    the class of its text, other columns are left out."""
    return near_duplicates(documents(spark, sf_dir))
