import hashlib
from collections import Counter

import corpus_pipeline
from tests.llm.helpers import empty, rows, table, untouched


def tables(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    d = tables(spark, tmp_path, table(spark))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, d)
        assert docs.columns == before.columns, name
        docs = corpus_pipeline.materialised(docs, name)
        kept[name] = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        assert untouched(docs.collect()), name
    # so few labels reject nothing
    assert sum(kept["toxicity"].values()) == len(rows())
    gone = {2, 3, 10, 16}
    want = Counter()
    for i, t, *_ in rows():
        if i not in gone and not (i == 20 and want[i, t]):
            want[i, t] += 1
    twice = [k for k in want if k[0] == 21]
    assert len(twice) == 2 and sum(kept["near_duplicates"][k] for k in twice) == 1  # a repeated doc_id stays once
    assert {k: n for k, n in kept["near_duplicates"].items() if k[0] != 21} == {k: n for k, n in want.items() if k[0] != 21}
    cleaned = {i: t for i, t in kept["passages"]}
    assert all(hashlib.sha256((t or "").encode()).digest() for t in cleaned.values())
    assert cleaned[5] != dict((r[0], r[1]) for r in rows())[5]
    assert "[secret]" in {i: t for i, t in kept["secrets"]}[17]
    out = corpus_pipeline.run(spark, d)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in kept["secrets"]}


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, empty(spark))).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    """Labels that reject: the stage's answer is that of its model, row by row, and nearly all of what the labels say."""
    from tests.llm.test_operators import toxic_corpus

    corpus = toxic_corpus(600)
    rest = rows()[0][5:]
    docs = table(spark, [(i, t, "en", "src1", len(t), *rest) for i, t, _ in corpus])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[0]
    kept = {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()}
    toxic = {i for i, _, y in corpus if y}
    assert name == "toxicity" and len(kept & toxic) <= 3 and len({i for i, *_ in corpus} - toxic - kept) <= 3


def test_packed_pieces_are_their_texts_tokens(spark, tmp_path):
    """Ids, lengths and places of the last stage's pieces against the library's own ids."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, [r for r in rows() if r[0] not in (None, 20, 21)])
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = set()
    for i, t, *_ in rows():
        if i not in (None, 20, 21):
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want |= {(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(some))])
        assert [o for o, _ in sorted(some)] == ends[:-1].tolist() and ends[-1] <= 2048
