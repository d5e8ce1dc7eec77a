"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

A row's score is the logistic of  bias + sum of w[i] x[i] + half the sum over factors f of ((sum of v[i, f] x[i]) ^ 2 - sum of (v[i, f] x[i]) ^ 2):
all pairwise interactions, in time linear in the row's features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderflow.llm.common import REST, documents, mapped, opened, sealed
from larderflow.llm.words import mix, term_hashes

#: log2 of the number of word features.
BITS = 18
#: Factors of each feature.
RANK = 8
#: At most so many labelled rows are learned from (those with the least hash of their doc_id, all sizes alike), by one task.
MAX_TRAIN_ROWS = 8_192
#: Word features of fewer learned rows than this have no weights.
LEAST_ROWS = 4
EPOCHS, BATCH, RATE, L2 = 12, 128, 0.1, 1e-4

#: Upper ends of the classes of shares (of 1) and of counts.
SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9])
COUNTS = 2.0 ** np.arange(0, 21)
CLASSES = 24
STATISTICS = ("upper", "digits", "symbols", "marks", "blanks", "not_ascii", "repeated_bytes", "symbol_ends", "alike_terms", "alike_lines", "chars", "terms", "lines", "term_chars", "line_terms", "declared", "declared_off")

# byte classes
UPPER, LOWER, DIGIT, MARK, SYMBOL, BLANK, LINE, LEAD, INNER = range(9)
KIND = np.full(256, SYMBOL, "u1")
KIND[ord("A") : ord("Z") + 1], KIND[ord("a") : ord("z") + 1], KIND[ord("0") : ord("9") + 1] = UPPER, LOWER, DIGIT
KIND[[ord(c) for c in ".,;:?!'\"()-"]] = MARK
KIND[[9, 11, 12, 13, 32]], KIND[10] = BLANK, LINE
KIND[0x80:0xC0], KIND[0xC0:] = INNER, LEAD


@dataclass
class Machine:
    """Weights and factors of the features that have any, `index` ascending: at most 2 ** BITS words and the classes of the statistics."""

    bias: float
    index: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The score before the logistic, by the sum-of-squares identity. Features without weights add nothing."""
        total = np.full(rows, self.bias)
        if not len(self.index) or not len(index):
            return total
        at = np.minimum(np.searchsorted(self.index, index), len(self.index) - 1)
        hit = self.index[at] == index
        at, x, row = at[hit], value[hit], row[hit]
        total += np.bincount(row, weights=self.weight[at] * x, minlength=rows)
        for f in range(self.factors.shape[1]):
            vx = self.factors[at, f] * x
            total += 0.5 * (np.bincount(row, weights=vx, minlength=rows) ** 2 - np.bincount(row, weights=vx * vx, minlength=rows))
        return total


def share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.searchsorted(SHARES, part / np.maximum(of, 1), side="left")


def size(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(COUNTS, n, side="right")


def structure(texts: pa.Array, hashes: np.ndarray, terms: np.ndarray, declared: np.ndarray) -> np.ndarray:
    """A class below CLASSES for each text and each of STATISTICS. texts: no nulls; hashes and terms: of their terms; declared: n_chars (nan: null)."""
    rows = len(texts)
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), "u1")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8")
    row = np.repeat(np.arange(rows, dtype="i4"), sizes)
    kind = KIND[raw]
    n = np.bincount(row * np.int32(9) + kind if rows < 2**27 else row.astype("i8") * 9 + kind, minlength=9 * rows).reshape(rows, 9)
    chars = sizes - n[:, INNER]
    letters = n[:, UPPER] + n[:, LOWER]
    inside = row[1:] == row[:-1]
    again = np.bincount(row[1:][inside & (raw[1:] == raw[:-1])], minlength=rows)
    gap = (kind == BLANK) | (kind == LINE)
    ends = np.bincount(row[:-1][(kind[:-1] == SYMBOL) & (gap[1:] | ~inside)], minlength=rows)
    lines = n[:, LINE] + 1
    split = pc.split_pattern(texts, "\n")
    line = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("i8")
    line_row = np.repeat(np.arange(rows, dtype="i8"), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    other_lines = np.bincount(np.unique(line_row << 32 | line) >> 32, minlength=rows)
    term_row = np.repeat(np.arange(rows, dtype="u8"), terms)
    other_terms = np.bincount((np.unique(term_row << np.uint64(40) | hashes >> np.uint64(24)) >> np.uint64(40)).astype("i8"), minlength=rows)
    known = ~np.isnan(declared)
    off = np.where(known, 1 + np.sign(np.where(known, declared, 0) - chars), 3).astype("i8")
    out = [
        share(n[:, UPPER], letters), share(n[:, DIGIT], chars), share(n[:, SYMBOL], chars), share(n[:, MARK], chars), share(n[:, BLANK] + n[:, LINE], chars), share(n[:, LEAD], chars), share(again, chars), share(ends, terms),
        share(terms - other_terms, terms), share(lines - other_lines, lines), size(chars), size(terms), size(lines), size(2 * (letters + n[:, LEAD]) / np.maximum(terms, 1)), size(terms / lines), np.where(known, size(np.where(known, declared, 0)), CLASSES - 1), off,
    ]
    return np.minimum(np.stack(out, 1), CLASSES - 1)


def features(texts: pa.Array, declared: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, row) of texts without nulls: each distinct word has the root of its share of the text's words, so that a text's words have length 1;
    each statistic's class has 1. With `known` (a mask of the word features) other words are left out before they are counted."""
    hashes, terms = term_hashes(texts)
    classes = structure(texts, hashes, terms, declared)
    index = (mix(hashes) >> np.uint64(64 - BITS)).astype("i8")
    row = np.repeat(np.arange(len(texts), dtype="i8"), terms)
    if known is not None:
        hit = known[index]
        index, row = index[hit], row[hit]
    code, times = np.unique(row << BITS | index, return_counts=True)
    row, index = code >> BITS, code & ((1 << BITS) - 1)
    value = np.sqrt(times / terms[row])
    fixed = (1 << BITS) + np.arange(len(STATISTICS)) * CLASSES + classes
    return np.concatenate([index, fixed.ravel()]), np.concatenate([value, np.full(fixed.size, 1 / np.sqrt(len(STATISTICS)))]), np.concatenate([row, np.repeat(np.arange(len(texts)), len(STATISTICS))])


def fit(index: np.ndarray, value: np.ndarray, row: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Adaptive gradient descent on the logistic loss in batches of BATCH rows, in an order that is the same on every run."""
    rows = len(labels)
    mean = float(np.clip(labels.mean(), 0.001, 0.999)) if rows else 0.5
    bias = float(np.log(mean / (1 - mean)))
    kept, place = np.unique(index, return_inverse=True)
    enough = (np.bincount(place) >= LEAST_ROWS) | (kept >= 1 << BITS)
    use = enough[place]
    kept, place = np.unique(index[use], return_inverse=True)
    order = np.argsort(row[use], kind="stable")
    at, x, row = place[order], value[use][order], row[use][order]
    starts = np.searchsorted(row, np.arange(rows + 1))
    rng = np.random.default_rng(11)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), RANK))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), RANK), 1e-6), 1e-6
    for _ in range(epochs):
        shuffled = rng.permutation(rows)
        for a in range(0, rows, BATCH):
            pick = shuffled[a : a + BATCH]
            sizes = starts[pick + 1] - starts[pick]
            here = np.repeat(starts[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            f, xs, r = at[here], x[here], np.repeat(np.arange(len(pick)), sizes)
            used, local = np.unique(f, return_inverse=True)
            vx = v[f] * xs[:, None]
            s = np.stack([np.bincount(r, weights=vx[:, k], minlength=len(pick)) for k in range(RANK)], 1)
            q = np.stack([np.bincount(r, weights=vx[:, k] ** 2, minlength=len(pick)) for k in range(RANK)], 1)
            margin = bias + np.bincount(r, weights=w[f] * xs, minlength=len(pick)) + 0.5 * (s * s - q).sum(1)
            g = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[pick]) / len(pick)
            gx = g[r] * xs
            dw = np.bincount(local, weights=gx, minlength=len(used)) + L2 * w[used]
            dv = np.stack([np.bincount(local, weights=gx * (s[r, k] - vx[:, k]), minlength=len(used)) for k in range(RANK)], 1) + L2 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
            bias -= RATE * g.sum() / np.sqrt(gb)
    return Machine(bias, kept, w, v)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of the id as text, mod 4, is 2 (or the id is null)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def declared_chars(docs: DataFrame) -> F.Column:
    """The table's n_chars where it has that column: the one piece of metadata that is used."""
    return (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("declared")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """Learns `quality` of labels (doc_id, quality) from docs (doc_id, text and, if there, n_chars), never from held-out rows.

    A doc_id with several labels has the least of them, and one with several texts teaches with the least; null labels and texts teach nothing. Without labels every score is 0.5."""
    picked = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows ids at most, a row for each
    rows = docs.select("doc_id", F.struct("text", declared_chars(docs)).alias("d")).filter("d.text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("d").alias("d"), F.min("quality").alias("quality")).select("doc_id", "quality", "d.text", "d.declared")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id"])
        parts, at = [], 0
        for block in np.array_split(np.arange(len(pdf)), -(-len(pdf) // 256)):
            index, value, row = features(pa.array(pdf["text"].iloc[block].tolist(), pa.string()), pdf["declared"].to_numpy("f8")[block])
            parts.append((index, value, row + at))
            at += len(block)
        m = fit(*(np.concatenate(p) for p in zip(*parts, strict=True)), pdf["quality"].to_numpy("f8"))
        return pd.DataFrame({"index": np.append(m.index, -1), "weight": np.append(m.weight, m.bias), "factors": [*m.factors.tolist(), []]})

    # the rows' number is bounded by max_rows: one group
    got = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "index long, weight double, factors array<double>").toPandas()
    if not len(got):
        return Machine(0.0, np.zeros(0, "i8"), np.zeros(0), np.zeros((0, RANK)))
    got = got.sort_values("index")
    return Machine(float(got["weight"].iloc[0]), got["index"].to_numpy("i8")[1:], got["weight"].to_numpy("f8")[1:], np.array(got["factors"].tolist()[1:], "f8").reshape(-1, RANK))


def score(docs: DataFrame, model: Machine, least: float = 0.7) -> DataFrame:
    """docs' columns and score (0 to 1) and predicted (1 if score >= least). A null text counts as empty, and an empty one has the statistics of an empty text;
    repeated rows have one score. Columns named score or predicted are replaced, others handed on unchanged."""
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    declared = F.col(f"{REST}.n_chars") if "n_chars" in docs.columns else F.lit(None)
    inner = sealed(docs, ("text",)).select("text", REST, declared.cast("double").alias("declared"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        m = held.value
        known = np.zeros(1 << BITS, bool)
        known[m.index[m.index < 1 << BITS]] = True
        texts = batch.column("text").fill_null("")
        index, value, row = features(texts, batch.column("declared").to_numpy(zero_copy_only=False).astype("f8"), known)
        p = 1 / (1 + np.exp(-np.clip(m.margin(index, value, row, len(texts)), -35, 35)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= least).astype("i4"))], [*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return mapped(inner, step, "text", schema).select(*opened(columns, ("text",)), "score", "predicted")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of `documents`, learned from `labels`: a row for each row; null texts count as empty, repeated rows have the same score, a null doc_id counts
    as held out; of the other columns n_chars is an input, none is returned."""
    docs = documents(spark, sf_dir)
    docs = docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
