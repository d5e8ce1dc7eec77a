"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm.common import documents, mapped, opened, sealed
from larderflow.llm.words import mix, term_hashes

#: log2 of the number of weights.
BITS = 20
#: At most so many labelled rows are learned from (those with the least hash of their doc_id, all sizes alike).
MAX_TRAIN_ROWS = 16_384
#: Labelled rows of one learner on average; the learners' weights are averaged.
LEARNER_ROWS = 8_192
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0


@dataclass
class Model:
    """Sparse weights: at most 2 ** BITS, so safe to send to every executor."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, "f4")
        out[self.index] = self.weight
        return out


def features(texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature index, row) of all words, word pairs and pairs that skip one word; repeats included."""
    h, counts = term_hashes(texts)
    row = np.repeat(np.arange(len(texts)), counts)
    shift = np.uint64(64 - BITS)
    out, rows = [mix(h) >> shift], [row]
    for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            out.append((mix(h[:-gap] * np.uint64(odd) + h[gap:]) >> shift)[same])
            rows.append(row[:-gap][same])
    return np.concatenate(out).astype("i8"), np.concatenate(rows)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over rows of distinct feature indices with values 1: per-coordinate rates, L1 for sparsity; the bias has no penalty."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)).tolist():
            x = rows[r]
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            wb = -zb / ((BETA + math.sqrt(nb)) / ALPHA)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + wb)))) - float(labels[r])
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / ALPHA * wb
            nb += g * g
    return weights(z, n), -zb / ((BETA + math.sqrt(nb)) / ALPHA)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of the id as text, mod 5, is 0 (or the id is null)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learns `toxic` of labels (doc_id, toxic) from docs (doc_id, text), never from held-out rows.

    A doc_id with several labels counts as toxic if one says so, and one with several texts teaches with the least of them; null labels and texts teach nothing. Without any label of one of the classes the
    model says "not toxic" for everything (or the one class seen)."""
    picked = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows ids at most, a row for each
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    learners = max(1, round(picked.count() / LEARNER_ROWS))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        rows: list[np.ndarray] = []
        for texts in np.array_split(pdf["text"].to_numpy(), -(-len(pdf) // 256)):
            index, row = features(texts.tolist())
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(1, len(texts)))
            rows += [np.unique(x).astype("i4") for x in np.split(index[order], cuts)]
        w, bias = fit_ftrl(rows, pdf["toxic"].to_numpy())
        kept = np.flatnonzero(w)
        return pd.DataFrame({"index": np.append(kept, -1), "weight": np.append(w[kept], bias)})

    parts = rows.withColumn("learner", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(learners))).groupBy("learner").applyInPandas(learn, "index long, weight double")
    mean = parts.groupBy("index").agg((F.sum("weight") / learners).alias("weight")).toPandas()  # at most 2 ** BITS + 1 rows
    bias = mean.loc[mean["index"] < 0, "weight"]
    mean = mean[mean["index"] >= 0]
    return Model(mean["index"].to_numpy("i8"), mean["weight"].to_numpy("f4"), float(bias.iloc[0]) if len(bias) else -5.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns and score (0 to 1) and predicted (1 if score >= 0.5): each distinct n-gram of the whole text counts once. A null or empty text has
    the score of the bias alone; repeated rows have one score. Columns named score or predicted are replaced, others handed on unchanged."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = sealed(docs, ("text",))
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        m = weights.value
        index, row = features(batch.column("text").fill_null(""))
        w = m.dense()[index]
        hit = np.flatnonzero(w)
        _, once = np.unique(row[hit] << BITS | index[hit], return_index=True)
        total = np.bincount(row[hit][once], weights=w[hit][once], minlength=batch.num_rows) + m.bias
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype("i4"))], [*batch.schema.names, "score", "predicted"])

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return mapped(docs, step, "text", schema).select(*opened(columns, ("text",)), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of `documents`, learned from `labels`: a row for each row; null and empty texts have the score of the bias, repeated rows the same score,
    a null doc_id counts as held out; other columns are left out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
