"""Alignment of two tokenizers' tokens by the bytes they cover, and a corpus-wide table of how often two tokens end together.

A pair of ids is one packed 64-bit key, (B id << 32 | A id), so that the pairs of a B id are neighbours. Each task sums its keys with np.unique
and hands on partial counts; a range-partitioned sort brings equal keys together, their runs are summed, and each range is written as one sorted
count shard: raw little-endian 64-bit keys, then as many counts. Later tasks memory-map the shards and look keys up by binary search.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm.common import cached_words, documents, ragged, shared_dir, steps, text_map
from larderflow.llm.piece_bpe import BYTE, SPACE, library, model_pieces
from larderflow.llm.token_shards import filesystem, put
from larderflow.llm.words import PieceCache, library_pieces

#: Partial sums that a task holds before it hands them on and begins anew.
HELD_KEYS = 1_000_000
#: Partial sums of one count shard on average.
SHARD_KEYS = 2_000_000
LEAST_SHARDS = 4


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others, in order, for those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenBytes:
    """The bytes of each id, and its decimal name before each of two separators."""

    def __init__(self, tokens: list[bytes], inner: str, last: str):
        self.length = np.fromiter(map(len, tokens), "i8", len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), "u1")
        self.names = [f"{i}{mark}" for i in range(len(tokens)) for mark in (inner, last)]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.start[ids], self.length[ids])]


def library_sentence_pieces(path: str) -> PieceCache:
    """Words encoded by the sentencepiece library, which puts a space before each; model_pieces() refuses models for which a text's ids aren't those of its words."""
    model_pieces(path)
    encoder = library(path)

    def encode_many(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = encoder.encode([w[1:] for w in words], num_threads=1)
        counts = np.fromiter(map(len, lists), "i8", len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), "u4", int(counts.sum())), counts

    return PieceCache(encode_many, " ", " ", re.compile(SPACE))


class Pair:
    """Two tokenizers: A a byte-level file of the tokenizers library, which gets a space before each text; B a SentencePiece model, which adds one."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        self.a = library_pieces(a_path, " ", " ")
        self.b = library_sentence_pieces(b_path)
        tokenizer, letter = Tokenizer.from_file(a_path), byte_letters()
        entries = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = TokenBytes([bytes(letter[c] for c in e) if all(c in letter for c in e) else e.encode() for e in entries], ",", "|")
        self.b_bytes = TokenBytes([bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in model_pieces(b_path)], ",", ";")


def equal_rows(x: np.ndarray, x_ends: np.ndarray, y: np.ndarray, y_ends: np.ndarray) -> np.ndarray:
    """Whether each row's slice of x is its slice of y; rows follow each other without gaps."""
    n, m = np.diff(x_ends, prepend=0), np.diff(y_ends, prepend=0)
    out = n == m
    if out.all():
        wrong = np.flatnonzero(x != y)
        out[np.searchsorted(x_ends, wrong, side="right")] = False
        return out
    for i in np.flatnonzero(out).tolist():
        out[i] = np.array_equal(x[x_ends[i] - n[i] : x_ends[i]], y[y_ends[i] - m[i] : y_ends[i]])
    return out


def kept_ids(ids: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(keep, counts)], np.where(keep, counts, 0)


def aligned(texts: pa.Array, pair: Pair) -> dict:
    """Of texts (null: empty): n_a, n_b, n_groups per text, the packed keys of all links in order, their number per text, the groups' digests."""
    texts = texts.fill_null("")
    full = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    a, n_a = pair.a.encode(texts)
    b, n_b = pair.b.encode(texts)
    (a, n_a), (b, n_b) = kept_ids(a, n_a, full), kept_ids(b, n_b, full)
    # the bytes of a space and the text, against what the tokens make of them
    spaced = pa.compute.if_else(pa.array(full), pa.compute.binary_join_element_wise("", texts, " "), "")
    want = pa.compute.binary_length(spaced).to_numpy(zero_copy_only=False).astype("i8")
    whole = np.frombuffer(b"".join(spaced.cast(pa.binary()).to_pylist()), "u1")
    same = np.ones(len(texts), bool)
    for ids, counts, of in ((a, n_a, pair.a_bytes), (b, n_b, pair.b_bytes)):
        sizes = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=of.length[ids], minlength=len(texts)).astype("i8")
        same &= equal_rows(of.joined(ids), np.cumsum(sizes), whole, np.cumsum(want))
    if not same.all():
        (a, n_a), (b, n_b) = kept_ids(a, n_a, same), kept_ids(b, n_b, same)
    # now both cover the same bytes, text by text: an end of both is a cut
    a_end, b_end = np.cumsum(pair.a_bytes.length[a]), np.cumsum(pair.b_bytes.length[b])
    mark = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, bool)
    mark[a_end] = True
    b_last = mark[b_end] if len(b) else np.zeros(0, bool)
    mark[a_end] = False
    mark[b_end] = True
    a_last = mark[a_end] if len(a) else np.zeros(0, bool)
    keys = b[b_last].astype("i8") << 32 | a[a_last].astype("i8")
    rows = np.arange(len(texts))
    n_groups = np.bincount(np.repeat(rows, n_a)[a_last], minlength=len(texts))
    # each token's place in the list of groups: a group's A ids, then its B ids
    a_in, b_in = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1  # tokens up to the end of each group
    a_size, b_size = np.diff(a_in, prepend=0), np.diff(b_in, prepend=0)
    order = np.empty(len(a) + len(b), "i8")
    order[np.arange(len(a)) + np.repeat(b_in - b_size, a_size)] = 2 * a.astype("i8") + a_last
    order[np.arange(len(b)) + np.repeat(a_in, b_size)] = ~(2 * b.astype("i8") + b_last)
    a_names, b_names = pair.a_bytes.names, pair.b_bytes.names
    digests, at, codes = [], 0, order.tolist()
    for n in (n_a + n_b).tolist():
        listed = "".join([a_names[c] if c >= 0 else b_names[~c] for c in codes[at : at + n]])
        digests.append(hashlib.sha256(listed[:-1].encode()).hexdigest() if n else "")
        at += n
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "keys": keys, "digests": digests}


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrays of 64-bit values as binary values, one per row."""
    ends = np.concatenate([[0], np.cumsum(counts) * 8]).astype("i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.astype("<i8").tobytes())])


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links (packed keys in order, little-endian), a row for each row of docs (doc_id, text).

    A text that is null or empty, or whose A or B tokens don't give the bytes of a space and the text, has no tokens. Other columns are ignored."""

    def run(batches):
        for batch in steps(batches, "text"):
            got = aligned(batch.column("text"), cached_words(("pair", a_path, b_path), lambda: Pair(a_path, b_path)))
            links = packed(got["keys"], got["n_groups"]).cast(pa.binary())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(got[c].astype("i8")) for c in ("n_a", "n_b", "n_groups")), pa.array(got["digests"], pa.string()), links], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return text_map(docs.select("doc_id", "text"), run, ALIGNED)


def values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all packed values, number per row) of a binary column."""
    counts = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype("i8") // 8
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v), "<i8"), counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, "i8")
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def partial_counts(links: DataFrame) -> DataFrame:
    """key, n: sums of each task's links. A task holds HELD_KEYS distinct keys at most and then hands them on, so a key may come several times."""

    def run(batches):
        keys, counts = np.zeros(0, "i8"), np.zeros(0, "i8")
        for batch in batches:
            new, n = np.unique(values(batch.column("links"))[0], return_counts=True)
            keys, counts = summed(np.concatenate([keys, new]), np.concatenate([counts, n]))
            if len(keys) > HELD_KEYS:
                yield pa.record_batch([pa.array(keys), pa.array(counts)], ["key", "n"])
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield pa.record_batch([pa.array(keys), pa.array(counts)], ["key", "n"])

    return links.select("links").mapInArrow(run, "key long, n long")


def write_counts(partial: DataFrame, out: str, shards: int) -> DataFrame:
    """Writes the count shards and returns first_key, n_keys and name of each: ranges of keys, each sorted, equal keys summed.

    Equal keys come to one task, at most one from each hand-over of partial_counts. Shards are written under a name of their own and renamed, so a repeated task leaves a second whole file that nobody lists."""

    def run(batches):
        keys, counts, name = [], [], f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        open_key, open_n = None, 0
        for batch in batches:
            k, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            if not len(k):
                continue
            k, n = summed(k, n)  # sorted already: its runs are summed
            if open_key is not None:
                if k[0] == open_key:
                    n = np.concatenate([[n[0] + open_n], n[1:]])
                else:
                    k, n = np.concatenate([[open_key], k]), np.concatenate([[open_n], n])
            open_key, open_n = k[-1], n[-1]
            keys.append(k[:-1])
            counts.append(n[:-1])
        if open_key is not None:
            k, n = np.concatenate([*keys, [open_key]]).astype("<i8"), np.concatenate([*counts, [open_n]]).astype("<i8")

            def body(stream):
                stream.write(k.tobytes())
                stream.write(n.tobytes())

            put(f"{out}/{name}.counts", body)
            yield pa.record_batch([pa.array(k[:1]), pa.array([len(k)], pa.int64()), pa.array([name])], ["first_key", "n_keys", "name"])

    return partial.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, "first_key long, n_keys long, name string")


class CountTable:
    """The count shards in order of their keys, each memory-mapped when it is first asked."""

    def __init__(self, out: str, shards: list[tuple[int, int, str]]):
        self.out, self.shards = out, sorted(shards)
        self.first = np.array([s[0] for s in self.shards], "i8")
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.held:
            _, n, name = self.shards[i]
            files, path = filesystem(f"{self.out}/{name}.counts")
            if files.type_name == "local":
                raw = np.memmap(path, "<i8", "r", shape=(2 * n,))
            else:  # a store that cannot be mapped: the shard's bytes
                with files.open_input_file(path) as f:
                    raw = np.frombuffer(f.read(), "<i8")
            self.held[i] = raw[:n], raw[n:]
        return self.held[i]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted distinct keys; 0 for those that no shard holds."""
        out = np.zeros(len(keys), "i8")
        where = np.searchsorted(self.first, keys, side="right") - 1
        for i in np.unique(where[where >= 0]).tolist():
            a, b = np.searchsorted(where, [i, i + 1])
            k, n = self.shard(i)
            at = np.minimum(np.searchsorted(k, keys[a:b]), len(k) - 1)
            out[a:b] = np.where(k[at] == keys[a:b], n[at], 0)
        return out


def highest(spark: SparkSession, out: str, shards: list[tuple[int, int, str]]) -> DataFrame:
    """b, highest: the highest count of each B id, from the shards."""

    def run(batches):
        for batch in batches:
            for name, n in zip(batch.column("name").to_pylist(), batch.column("n_keys").to_pylist(), strict=True):
                k, c = CountTable(out, [(0, n, name)]).shard(0)
                b = k >> 32
                first = np.flatnonzero(np.diff(b, prepend=b[:1] - 1))
                yield pa.record_batch([pa.array(np.asarray(b[first])), pa.array(np.maximum.reduceat(np.asarray(c), first))], ["b", "highest"])

    rows = spark.createDataFrame(shards, "first_key long, n_keys long, name string").repartition(max(1, min(len(shards), 200)))
    return rows.mapInArrow(run, "b long, highest long").groupBy("b").agg(F.max("highest").alias("highest"))


def rated(links: DataFrame, out: str, shards: list[tuple[int, int, str]], best: np.ndarray) -> DataFrame:
    """Adds n_links, n_best and count_sum to rows of align(). best: the highest count by B id, an entry for each id of B's vocabulary."""
    held = links.sparkSession.sparkContext.broadcast(best)

    def run(batches):
        table = CountTable(out, shards)
        for batch in steps(batches, "links"):
            keys, sizes = values(batch.column("links"))
            alike, at = np.unique(keys, return_inverse=True)
            n = table.counts(alike)
            top = n == held.value[alike >> 32]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.concatenate([[0], np.cumsum(n[at])])[ends]  # int64 sums
            tops = np.concatenate([[0], np.cumsum(top[at])])[ends]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), pa.array(sizes), pa.array(np.diff(tops).astype("i8")), pa.array(np.diff(sums)), batch.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return text_map(links, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs; counts are over all rows, repeated ones included."""
    spark = docs.sparkSession
    out = shared_dir(spark, "alignment")
    align(docs, a_path, b_path).write.option("compression", "zstd").parquet(f"{out}/links")
    links = spark.read.schema(ALIGNED).parquet(f"{out}/links")
    partial_counts(links).write.parquet(f"{out}/partial")
    partial = spark.read.schema("key long, n long").parquet(f"{out}/partial")
    n_shards = max(LEAST_SHARDS, -(-partial.count() // SHARD_KEYS))
    shards = [(r["first_key"], r["n_keys"], r["name"]) for r in write_counts(partial, f"{out}/counts", n_shards).collect()]  # a row for each shard
    best = np.zeros(len(model_pieces(b_path)), "i8")  # bounded by the vocabulary
    if shards:
        top = highest(spark, f"{out}/counts", shards).toPandas()
        best[top["b"].to_numpy("i8")] = top["highest"].to_numpy("i8")
    return rated(links, f"{out}/counts", shards, best)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """align_documents() of `documents`: a row for each row, those with a null doc_id and repeated ones too; null and empty texts and those whose
    bytes the tokens don't give have zeros and an empty groups_sha256; other columns are left out; an empty table gives an empty one."""
    import public_tokenizers

    return align_documents(documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
