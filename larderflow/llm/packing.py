"""Best-fit packing with certificates: partitions are packed best-fit decreasing, dual-feasible functions bound their bin counts from below, and
partitions with a gap exchange the pieces of their unfilled sequences and pack again."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm.common import documents, mapped, materialised, text_or_empty, without_words
from larderflow.llm.words import word_pair_ids

CAPACITY = 2048
#: Pieces that one partition packs on average.
GROUP_PIECES = 4096
ROUNDS = 4
#: A sequence with at most this part of it free stays as it is.
FILLED = 1 / 128

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document (doc_id, text): its ids and an end id, cut at every `capacity` ids. Null texts count as empty, other columns
    are ignored; every document has at least the piece of its end id."""

    def step(batch):
        ids, counts = word_pair_ids(batch.column("text"), tokenizer_path, added=True)
        ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
        counts = counts + 1
        firsts = np.cumsum(counts) - counts
        n = -(-counts // capacity)
        row = np.repeat(np.arange(len(counts)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(capacity, counts[row] - start)
        at = firsts[row] + start
        crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        return pa.record_batch([batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype("i4")), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select("doc_id", text_or_empty()), step, "text", PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of three families of dual-feasible functions: no packing of these sizes has fewer bins."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype("i8")
    value = np.arange(capacity + 1, dtype="i8")
    best = -(-int((count * value).sum()) // capacity)
    # above capacity - e: a whole bin; below e: nothing; between: itself
    below_n, below_sum = np.cumsum(count), np.cumsum(count * value)
    e = np.arange(1, capacity // 2 + 1)
    whole = below_n[-1] - below_n[capacity - e]
    middle = below_sum[capacity - e] - below_sum[e - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    # rounding to multiples of 1 / k
    for k in range(1, 33):
        scaled = (k + 1) * value
        f = np.where(scaled % capacity == 0, value * k, (scaled // capacity) * capacity)  # k * f, in integers
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    # a piece over half counts one bin less the halves that can join it
    for half in range(1, 17):
        part = capacity // (half + 1) + 1
        g = np.where(2 * value > capacity, 2 * (capacity // part - (capacity - value) // part), np.where(value >= part, np.where(2 * value == capacity, capacity // part, 2 * (value // part)), 0))
        top = 2 * (capacity // part)
        if top:
            best = max(best, -(-int((count * g).sum()) // top))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: larger first, each into the fullest bin that has room. Bins by free room in one bit set."""
    bins = np.empty(len(sizes), "i8")
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            b, room, made = made, capacity, made + 1
        bins[i] = b
        left = room - size
        if left:
            open_[left].append(b)
            mask |= 1 << left
    return bins


def solver(turn: int, last: bool, capacity: int, ids: tuple[str, str], size: str):
    """Packs one partition of a round; all its sequences are done if its bin count equals the bound."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        without_words()
        pdf = pdf.sort_values(list(ids), kind="stable").drop(columns="group").reset_index(drop=True)
        sizes = pdf[size].to_numpy("i8")
        bins, bound = best_fit_decreasing(sizes, capacity), lower_bound(sizes, capacity)
        n_bins = int(bins.max()) + 1
        order = np.argsort(bins, kind="stable")
        ordered, grouped = sizes[order], bins[order]
        before = np.cumsum(ordered) - ordered
        heads = np.flatnonzero(np.r_[True, grouped[1:] != grouped[:-1]])
        offset = np.empty(len(sizes), "i8")
        offset[order] = before - np.repeat(before[heads], np.diff(np.r_[heads, len(grouped)]))
        free = capacity - np.bincount(bins, weights=sizes, minlength=n_bins)
        keep = np.full(n_bins, last or n_bins == bound) | (free <= capacity * FILLED)
        return pdf.assign(sequence_id=(turn << 58) + (int(key[0]) << 28) + bins, offset=offset, bins=n_bins, bound=bound, done=keep[bins])

    return solve


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id, offset (gapless from 0 in each sequence), and bins and bound of the partition that made the sequence to pieces.

    pieces: doc_id, piece, length (1 to capacity) and any other columns, which are kept; those with the names of the added ones are replaced. Repeated
    rows, equal and null ids are packed each for itself, dealt out evenly; an empty table gives an empty one. A partition whose bin count equals its
    lower bound is certified and done; of the others, the sequences with more than FILLED of their room free are taken apart, dealt anew among all
    such partitions, and packed again, for at most `rounds` rounds: what the last round makes stays, certified or not (bins > bound tells)."""
    added = {"sequence_id": "long", "offset": "long", "bins": "int", "bound": "int"}
    names = {c: f"in_{i}" for i, c in enumerate(pieces.columns)}  # the solver's own names never clash with the table's
    held = pieces.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields)
    made = schema + ", " + ", ".join(f"{k} {v}" for k, v in added.items()) + ", done boolean"
    ids, size = (names["doc_id"], names["piece"]), names["length"]
    open_, done = held, None
    for turn in range(rounds):
        n = open_.count()
        if not n and done is not None:
            break
        groups = max(1, -(-n // group_pieces))
        # the row's number parts equal rows; pieces come from written files, so a task that runs again numbers them alike
        dealt = open_.withColumn("group", F.pmod(F.xxhash64(F.lit(turn), *ids, F.monotonically_increasing_id()), F.lit(groups)))
        packed = materialised(dealt.groupBy("group").applyInPandas(solver(turn, turn == rounds - 1, capacity, ids, size), made), f"packed-{turn}")
        new = packed.filter("done").drop("done")
        done = new if done is None else done.unionByName(new)
        open_ = packed.filter("not done").select(*names.values())
    return done.select(*[F.col(n).alias(c) for c, n in names.items() if c not in added], *added)


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces of docs (doc_id, text), packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound. A null text counts as
    empty and an empty one is the piece of its end id; rows that repeat an id, and rows with a null id, have their own pieces each; other columns are
    left out; an empty table gives an empty one."""
    import public_tokenizers

    return pack(materialised(token_pieces(docs, str(public_tokenizers.path("word_bpe_49k.json")), end_id=0), "pieces"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packed_documents() of the whole table `documents`, nulls, repeated rows, long texts and all."""
    return packed_documents(documents(spark, sf_dir))
