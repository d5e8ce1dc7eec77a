"""The factorisation machine: its identity, its learning, and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larderflow.llm import quality
from tests.llm.helpers import empty, rows, table, untouched, words


def corpus(n):
    r = random.Random(5)
    out = []
    for i in range(n):
        text = words(1000 + i, 60)
        good = i % 4 != 0
        if not good:
            text = " ".join(w + r.choice(["###", "%%%", "&&&"]) for w in text.split()) if i % 8 else text.upper().replace(" ", "!! ")
        out.append((i, text, "en", "s", len(text), int(good)))
    return out


def frame(spark, some):
    return spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long, quality int")


def test_identity_equals_all_pairs():
    r = np.random.default_rng(1)
    m = quality.Machine(0.3, np.array([2, 5, 9, 11]), r.normal(size=4), r.normal(size=(4, 3)))
    index, value, row = np.array([2, 5, 9, 7, 11, 2]), r.random(6), np.array([0, 0, 0, 0, 1, 2])
    want = np.full(4, 0.3)
    place = {int(k): i for i, k in enumerate(m.index)}
    for d in range(4):
        here = [(place[int(i)], x) for i, x, k in zip(index, value, row, strict=True) if k == d and int(i) in place]
        want[d] += sum(m.weight[i] * x for i, x in here) + sum(m.factors[i] @ m.factors[j] * x * y for a, (i, x) in enumerate(here) for j, y in here[a + 1 :])
    assert np.allclose(m.margin(index, value, row, 4), want)


def test_pairs_are_learned_that_no_sum_of_weights_can_tell():
    """Label 1 if exactly one of two words is there."""
    r = np.random.default_rng(2)
    rows_, index, value, labels = [], [], [], []
    for i in range(600):
        a, b = r.integers(0, 2, 2)
        for f in [3 + a, 6 + b]:
            rows_.append(i)
            index.append(f)
            value.append(1.0)
        labels.append(float(a != b))
    m = quality.fit(np.array(index), np.array(value), np.array(rows_), np.array(labels), epochs=30)
    margin = m.margin(np.array(index), np.array(value), np.array(rows_), 600)
    assert ((margin > 0) == (np.array(labels) == 1)).mean() > 0.99


def test_quality_is_learned_from_rows_that_are_not_held_out(spark):
    some = frame(spark, corpus(600))
    labels = some.select("doc_id", "quality")
    wrong = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = some.select("doc_id", "text", "n_chars", F.lit("x").alias("score"))
    model = quality.train(docs, wrong)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(got) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [(i, q) for i, *_, q in corpus(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 80 and sum(got[i]["predicted"] == q for i, q in held) / len(held) > 0.97


def test_labels_lang_source_and_ids_are_no_inputs(spark):
    some = corpus(200)
    docs = frame(spark, some)
    model = quality.train(docs, docs.select("doc_id", "quality"))
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("?").alias("source"), "n_chars", (1 - F.col("quality")).alias("quality"))
    a = {r["text"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(a[r["text"]] == r["score"] for r in quality.score(other, model).collect())


def test_odd_rows(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (5, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model)
    got = out.collect()
    assert len(got) == len(rows()) and all(r["score"] is not None for r in got)
    assert all(r["lang"] == "en" and r["a.b"] == 4 for r in got)
    same = {r["score"] for r in got if r["text"] == rows()[0][1]}
    assert len(same) == 1
    assert quality.score(empty(spark), model).count() == 0
    none = quality.train(empty(spark), labels)
    assert {r["score"] for r in quality.score(docs.select("doc_id", "text"), none).collect()} == {0.5}


def test_statistics_by_hand():
    texts = pa.array(["", "AB c\nAB c\n", "aa## bb## cc", "ééé", "12 34"])
    hashes, terms = quality.term_hashes(texts)
    got = quality.structure(texts, hashes, terms, np.array([0, np.nan, 12, 4, 2]))
    name = {n: i for i, n in enumerate(quality.STATISTICS)}
    part = lambda x: int(np.searchsorted(quality.SHARES, x, side="left"))
    assert got[1, name["upper"]] == part(4 / 6) and got[1, name["alike_lines"]] == part(1 / 3) and got[1, name["alike_terms"]] == part(2 / 4)
    assert got[2, name["symbol_ends"]] == part(2 / 3) and got[2, name["symbols"]] == part(4 / 12) and got[2, name["repeated_bytes"]] == part(5 / 12)
    assert got[3, name["not_ascii"]] == part(1.0) and got[4, name["digits"]] == part(4 / 5)
    assert got[:, name["declared_off"]].tolist() == [1, 3, 1, 2, 0]  # equal, unknown, equal, more, fewer
    assert got[0, name["chars"]] == 0 and (got < quality.CLASSES).all()


def test_columns_are_handed_on(spark):
    docs = table(spark)
    model = quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    got = quality.score(docs, model)
    assert got.columns == [*kept, "score", "predicted"]
    back = got.withColumns({"predicted": F.lit(12), "score": F.lit(0.25)}).collect()
    assert untouched(back)
