"""Removal of passages that an earlier document has: suffix automata of reference shards, against which documents are streamed for matching statistics.

A whole corpus is far larger than any automaton, so the work is cut down first, exactly:
1. Every document sends the hashes of its windows (`width` consecutive words), 5 bytes each beside their part, to parts by hash. A part finds the
   windows of more than one document and their owner, the document with the smallest id. Parts answer with flags, not with text.
2. Of the documents that got an answer, owners give the runs of words that others repeat (the reference, in shards of bounded size), later documents
   the runs that they have from an owner.
3. Each shard's suffix automaton is built where its runs are asked for; a shard that many documents ask is sent to several tasks. Streaming a run
   gives its longest match at every word; `width` words or more are removed, as maximal spans.
4. Two windows may share a hash. Such a window finds no match in step 3; these few are grouped by their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from larderflow.llm.common import cached_words, documents, materialised, opened, ragged, repeated_ids, sealed, sieved, steps, text_map, without_words
from larderflow.llm.words import mix

WIDTH = 13
#: Reference words of a shard, and words that one task streams against it, on average.
SHARD_WORDS = 65_536
#: Windows of one part, on average: what a task holds at a time.
PART_WINDOWS = 1_000_000
ASKED_WORDS = 524_288
REM = 5


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white space characters."""
    return text.encode().split() if text else []


class _Hashes(dict):
    """64-bit hash of a word; begun anew beyond 150,000 words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A hash of each window of a document's words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, "u8")
    h = np.fromiter(map(cached_words(("word hashes",), _Hashes).__getitem__, words), "u8", len(words))
    out = np.zeros(n, "u8")
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


class SuffixAutomaton:
    """Of several sequences of words, kept apart by marks that no document has."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self.last, self.marks = 0, 0

    def add(self, words: list[bytes]) -> None:
        for w in words:
            self._extend(w)
        self.marks += 1
        self._extend(self.marks)

    def _extend(self, w) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def matches(self, words: list[bytes]) -> list[int]:
        """Matching statistics: the length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.len
        v = k = 0
        out = []
        for w in words:
            while w not in nxt[v]:
                v = link[v]
                if v < 0:
                    v = k = 0
                    break
                k = length[v]
            else:
                v = nxt[v][w]
                k += 1
            out.append(k)
        return out


def spans(ends: list[int], width: int) -> list[tuple[int, int]]:
    """The union of the windows that end at these (ascending) words, as maximal half-open spans."""
    out: list[tuple[int, int]] = []
    for e in ends:
        a, b = e - width + 1, e + 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _runs(at: np.ndarray, *by: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] indices into `at` of runs of consecutive places with equal `by`."""
    if not len(at):
        return []
    cut = np.diff(at) != 1
    for b in by:
        cut |= b[1:] != b[:-1]
    heads = np.flatnonzero(np.r_[True, cut])
    return list(zip(heads.tolist(), np.r_[heads[1:] - 1, len(at) - 1].tolist(), strict=True))


def _tagged(docs: DataFrame) -> DataFrame:
    """Adds tag: 0, but for rows that repeat a doc_id with another text."""
    if not repeated_ids(docs):
        return docs.withColumn("tag", F.lit(0))
    return docs.withColumn("tag", F.when(F.col("doc_id").isNull(), 0).otherwise(F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")) - 1).cast("int"))


def window_rows(docs: DataFrame, parts: int, width: int) -> DataFrame:
    """Windows by part: for each batch of documents and part one row with the documents' ids, their numbers of windows, and 5 bytes of each hash."""

    def emit(batches):
        for batch in steps(batches, "text"):
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            all_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            hashes = [window_hashes(words_of(t), width) for t in batch.column("text").to_pylist()]
            for tag in np.unique(tags).tolist():
                mine = np.flatnonzero(tags == tag)
                counts = np.fromiter((len(hashes[i]) for i in mine), "i8", len(mine))
                if not counts.sum():
                    continue
                h = np.concatenate([hashes[i] for i in mine])
                part = (h % np.uint64(parts)).astype("i4")
                order = np.argsort(part.astype("u2") if parts <= 65536 else part, kind="stable")
                rem = np.ascontiguousarray((h >> np.uint64(24))[order]).view("u1").reshape(-1, 8)[:, :REM]
                part, doc = part[order], np.repeat(np.arange(len(mine)), counts)[order]
                heads = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])])
                sizes = np.diff(np.r_[heads, len(part)])
                ids = all_ids[mine][doc[heads]].astype("i8")
                base = int(ids.min())
                delta = ids - base
                delta = delta.astype("u4") if int(delta.max()) < 2**32 else delta
                sizes_out = sizes.astype("u1" if sizes.max() < 256 else "u2" if sizes.max() < 65536 else "u4")
                cuts = np.flatnonzero(np.r_[True, part[heads][1:] != part[heads][:-1]])
                edges = np.r_[cuts, len(heads)]
                ends = np.r_[heads, len(part)]
                rows = [(int(part[heads[a]]), delta[a:b].tobytes(), sizes_out[a:b].tobytes(), rem[ends[a] : ends[b]].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.record_batch(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([tag] * len(rows), pa.int32()), pa.array([base] * len(rows), pa.int64()), pa.array([b - a for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
                    ["part", "tag", "base", "n", "ids", "sizes", "rem"],
                )

    return text_map(docs.filter("doc_id is not null and text is not null").select("doc_id", "tag", "text"), emit, "part int, tag int, base long, n int, ids binary, sizes binary, rem binary")


def answers(rows: DataFrame, parts: int) -> DataFrame:
    """For each document with a shared window one row: its parts, their numbers of windows, a flag per window (in the order of the part: 1, an earlier
    document has it; 2, it is owned here and a later one has it) and the owners of the former. Parts send what they found in one row for each of
    `parts` buckets of documents, and a bucket puts its documents' flags together, so the rows are as many as the documents."""

    def solve(batches):
        without_words()
        ids, tags, sizes, rems, part = [], [], [], [], None
        for batch in batches:
            for p, tag, base, n, d, s, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = p
                ids.append(np.frombuffer(d, "u4" if len(d) == 4 * n else "i8").astype("i8") + base)
                sizes.append(np.frombuffer(s, f"u{len(s) // n}").astype("i8"))
                tags.append(np.full(n, tag, "i4"))
                rems.append(np.frombuffer(r, "u1").reshape(-1, REM))
        if part is None:
            return
        ids, tags, sizes = np.concatenate(ids), np.concatenate(tags), np.concatenate(sizes)
        rem = np.zeros((int(sizes.sum()), 8), "u1")
        rem[:, :REM] = np.concatenate(rems)
        del rems
        h, entry = rem.view("u8").ravel(), np.repeat(np.arange(len(ids), dtype="i4"), sizes)
        order = np.argsort(h, kind="stable")
        h = h[order]
        heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        del h, rem
        order, n = order.astype("i4"), np.diff(np.r_[heads, len(order)])
        # most windows stand alone: only the others go on
        order, n = order[np.repeat(n > 1, n)], n[n > 1]
        flag, owner = np.zeros(len(entry), "u1"), np.zeros(len(entry), "i8")
        if len(order):
            doc, heads = ids[entry[order]], np.cumsum(n) - n
            lows, highs = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
            low = np.repeat(lows, n)
            flag[order], owner[order] = np.where(doc > low, 1, np.where(np.repeat(highs > lows, n), 2, 0)), low
            del doc, low
        del order
        hit = np.unique(entry[flag > 0])
        bucket = (mix(ids[hit].view("u8") + tags[hit].astype("u8")) % np.uint64(parts)).astype("i8")
        hit = hit[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket)
        firsts = np.cumsum(sizes) - sizes
        for b in np.unique(bucket).tolist():
            mine = hit[slice(*np.searchsorted(bucket, [b, b + 1]))]
            at = ragged(firsts[mine], sizes[mine])
            flags = flag[at]
            yield pa.record_batch([pa.array([x], t) for x, t in zip((b, part, ids[mine].tobytes(), tags[mine].tobytes(), sizes[mine].astype("u4").tobytes(), flags.tobytes(), owner[at][flags == 1].tobytes()), (pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], ["bucket", "part", "ids", "tags", "sizes", "flags", "owners"])

    def gather(batches):
        without_words()
        held: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for batch in batches:
            for part, *raw in zip(*(batch.column(c).to_pylist() for c in ("part", "ids", "tags", "sizes", "flags", "owners")), strict=True):
                for x, y in zip(held, [np.frombuffer(r, t) for r, t in zip(raw, ("i8", "i4", "u4", "u1", "i8"), strict=True)] + [np.full(len(raw[0]) // 8, part, "i4")], strict=True):
                    x.append(y)
        if not held[0]:
            return
        ids, tags, sizes, flags, owners, of_part = map(np.concatenate, held)
        sizes = sizes.astype("i8")
        late = np.r_[0, np.cumsum(flags == 1)]
        ends = np.cumsum(sizes)
        n_late = late[ends] - late[ends - sizes]
        order = np.lexsort((of_part, tags, ids))
        flags = flags[ragged((ends - sizes)[order], sizes[order])]
        owners = owners[ragged(late[ends - sizes][order], n_late[order])]
        ids, tags, sizes, n_late, of_part = ids[order], tags[order], sizes[order], n_late[order], of_part[order]
        heads = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
        cuts = np.r_[heads, len(ids)]
        w, o = np.r_[0, np.cumsum(sizes)][cuts], np.r_[0, np.cumsum(n_late)][cuts]
        for a in range(0, len(heads), 2_000):
            z = range(a, min(a + 2_000, len(heads)))
            yield pa.record_batch(
                [pa.array(ids[heads[a : a + 2_000]]), pa.array(tags[heads[a : a + 2_000]]), pa.array([of_part[cuts[i] : cuts[i + 1]].tobytes() for i in z], pa.binary()), pa.array([sizes[cuts[i] : cuts[i + 1]].astype("u4").tobytes() for i in z], pa.binary()), pa.array([flags[w[i] : w[i + 1]].tobytes() for i in z], pa.binary()), pa.array([owners[o[i] : o[i + 1]].tobytes() for i in z], pa.binary())],
                ["doc_id", "tag", "parts", "sizes", "flags", "owners"],
            )

    solved = rows.repartitionById(parts, F.col("part")).mapInArrow(solve, "bucket int, part int, ids binary, tags binary, sizes binary, flags binary, owners binary")
    return solved.repartitionById(parts, F.col("bucket")).mapInArrow(gather, "doc_id long, tag int, parts binary, sizes binary, flags binary, owners binary")


def removals(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plain, touched, lost): docs with a tag, split into those that lose nothing and those that may; lost has doc_id, tag and the spans of words, an
    array<struct<a, b>>, that go."""
    spark = docs.sparkSession
    # by the text's size, a word being some seven bytes: a part's memory is the same at every size of the table
    parts = max(1, -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (7 * PART_WINDOWS)))
    docs = _tagged(docs)
    found = materialised(answers(window_rows(docs, parts, width), parts), "substring-answers")
    marked = sieved(docs, found, ["doc_id", "tag"])
    plain = marked.filter("not _touched").drop("_touched")
    touched = materialised(marked.filter("_touched").drop("_touched"), "substring-touched")

    asked = touched.filter("doc_id is not null").select("doc_id", "tag", "text").join(found, ["doc_id", "tag"])

    def cut(batches):
        for batch in steps(batches, "text"):
            out = []
            for doc_id, tag, text, *raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "parts", "sizes", "flags", "owners")), strict=True):
                words = words_of(text)
                h = window_hashes(words, width)
                part = (h % np.uint64(parts)).astype("i8")
                order = np.argsort(part, kind="stable")
                of_part, sizes, flags, owners = (np.frombuffer(r, t) for r, t in zip(raw, ("i4", "u4", "u1", "i8"), strict=True))
                edges = np.searchsorted(part[order], [of_part, of_part + 1]).T
                flag, owner, f, o = np.zeros(len(h), "u1"), np.zeros(len(h), "i8"), 0, 0
                for (a, b), n in zip(edges.tolist(), sizes.tolist(), strict=True):  # a repeated row has its parts twice, with equal flags
                    at, mine = order[a:b], flags[f : f + n]
                    k = int((mine == 1).sum())
                    flag[at] = mine
                    owner[at[mine == 1]] = owners[o : o + k]
                    f, o = f + n, o + k
                later, first = flag == 1, flag == 2
                at = np.flatnonzero(later)
                for a, b in _runs(at, owner[at]):
                    out.append((1, int(owner[at[a]]), doc_id, tag, int(at[a]), b"\n".join(words[at[a] : at[b] + width])))
                at = np.flatnonzero(first)
                for a, b in _runs(at):
                    out.append((0, doc_id, doc_id, tag, int(at[a]), b"\n".join(words[at[a] : at[b] + width])))
            for a in range(0, len(out), 5_000):
                rows = out[a : a + 5_000]
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["asks", "owner", "doc_id", "tag", "start", "words"])

    pieces = materialised(text_map(asked, cut, "asks int, owner long, doc_id long, tag int, start int, words binary"), "substring-runs")
    total = pieces.agg(F.sum(F.when(F.col("asks") == 0, F.length("words")))).first()[0] or 0
    shards = max(1, int(total // (6 * SHARD_WORDS)) + 1)
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int"))
    # how many tasks stream against a shard: one row per shard that more than one does
    salts = sharded.filter("asks = 1").groupBy("shard").agg(F.ceil(F.sum(F.length("words")) / (6 * ASKED_WORDS)).cast("int").alias("salts"))
    sharded = sharded.join(salts, "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salted = sharded.withColumn("salt", F.when(F.col("asks") == 1, F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = salted.select("shard", F.explode("salt").alias("salt"), "asks", "doc_id", "tag", "start", "words")

    def stream(batches):
        without_words()
        tree, now, fed = None, None, None
        for batch in batches:
            out = []
            for shard, salt, asks, doc_id, tag, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (shard, salt):
                    tree, now, fed = SuffixAutomaton(), (shard, salt), None
                words = raw.split(b"\n")
                if not asks:
                    if raw != fed:  # sorted: repeated runs follow each other
                        tree.add(words)
                        fed = raw
                    continue
                k = tree.matches(words)
                found = [j for j in range(width - 1, len(words)) if k[j] >= width]
                for a, b in spans(found, width):
                    out.append((doc_id, tag, start + a, start + b, None))
                if len(found) < len(words) - width + 1:
                    for j in set(range(width - 1, len(words))) - set(found):
                        out.append((doc_id, tag, start + j - width + 1, start + j + 1, b"\n".join(words[j - width + 1 : j + 1])))
            for a in range(0, len(out), 20_000):
                rows = out[a : a + 20_000]
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "tag", "a", "b", "unmatched"])

    dealt = salted.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "asks", "words")
    lost = materialised(dealt.mapInArrow(stream, "doc_id long, tag int, a int, b int, unmatched binary"), "substring-spans")
    kept = lost.filter("unmatched is null").select("doc_id", "tag", "a", "b")
    open_ = lost.filter("unmatched is not null")
    if open_.limit(1).count():
        least = open_.groupBy("unmatched").agg(F.min("doc_id").alias("least"))
        kept = kept.unionByName(open_.join(least, "unmatched").filter("doc_id > least").select("doc_id", "tag", "a", "b"))
    return plain, touched, kept.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def _finish(df: DataFrame, step, schema: str | T.StructType) -> DataFrame:
    def run(batches):
        for batch in steps(batches, "text"):
            yield step(batch)

    return text_map(df, run, schema)


def kept_words(text: str | None, lost: list[dict] | None) -> tuple[list[bytes], int]:
    """(kept words, number removed)."""
    words = words_of(text)
    if not lost:
        return words, 0
    gone = np.zeros(len(words) + 1, "i8")
    for s in lost:
        gone[s["a"]] += 1
        gone[s["b"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the words removed from text that stand in a window of `width` words which an earlier document (smaller doc_id) has.

    A text that loses words becomes its kept words joined by one space; any other stays as it is. Null and empty texts and those of fewer words stay;
    a null doc_id is neither earlier nor later than another; rows that repeat a doc_id are not earlier than each other. Other columns are handed on
    unchanged, whatever their names; an empty table gives an empty one."""
    columns, docs = docs.columns, sealed(docs)
    plain, touched, lost = removals(docs, width)
    schema = T.StructType(docs.schema.fields)

    def step(batch):
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            texts.append(b" ".join(kept_words(text, gone)[0]).decode() if gone else text)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in schema.names], schema.names)

    changed = _finish(touched.join(lost, ["doc_id", "tag"], "left").select(*schema.names, "spans"), step, schema)
    return plain.select(schema.names).unionByName(changed).select(*opened(columns))


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """What deduplicated() keeps, as doc_id, n_words, n_removed and a digest of the kept words joined by one space, one row per row of docs."""
    plain, touched, lost = removals(docs.select("doc_id", "text"), width)

    def step(batch):
        out = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            kept, n = kept_words(text, gone)
            out.append((len(kept) + n, n, hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pa.record_batch([batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    spans_type = lost.schema["spans"].dataType.simpleString()
    both = plain.select("doc_id", "text", F.lit(None).cast(spans_type).alias("spans")), touched.join(lost, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return _finish(both[0], step, schema).unionByName(_finish(both[1], step, schema))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests() of `documents`: a row for each row. A null or empty text has no words; of repeated rows each has its own, and none is earlier than the
    others; a null doc_id loses and takes nothing; other columns are left out."""
    return digests(documents(spark, sf_dir))
