"""Every registered query over one small folder: the columns, types and values of its contract."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from larderflow import llm
from tests.llm.helpers import rows, table

TYPES = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_imatch": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op4_token_shards": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op6_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op7_best_fit": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_voronoi_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op9_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_lsh_forest": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op11_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op12_conversation_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op13_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_secret_scan": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "score": "double", "secret": "boolean"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    table(spark).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "https://www.example.net/en/1", "<p>a b</p>"), (1, None, None), (2, "x", "")], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0], 1) for i in range(45)] + [(50, None, 1), (60, [None, 1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    spark.createDataFrame([(100, 1, "user", "a"), (101, 0, None, "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return top


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns_and_types(spark, folder, name):
    out = llm.queries()[name](spark, folder)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in TYPES[name]} == TYPES[name]
    got = out.collect()
    if name in ("op1_toxicity", "op2_imatch", "op4_token_shards", "op6_substring_dedup", "op9_sentencepiece", "op10_lsh_forest", "op11_alignment", "op13_quality"):
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows())
    if name == "op4_token_shards":
        from tokenizers import Tokenizer

        tokenizer, at, want = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0, Counter()
        for i, t in sorted(((r[0], r[1] or "") for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
            want[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
            at += len(ids)
        assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    if name == "op1_toxicity":
        assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    if name == "op13_quality":
        assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    if name == "op12_conversation_trie":
        assert (0, None, 2) in {(r["depth"], r["parent_conv_id"], r["n_convs"]) for r in got}
    if name == "op5_url_filter":
        assert sorted((r["page_id"], r["host"], r["rule"] or "", r["verdict"]) for r in got) == [(1, "", "", "allow"), (1, "www.example.net", "example.net/en/", "allow"), (2, "", "", "allow")]
    if name == "op8_voronoi_top_k":
        assert Counter(r["query_id"] for r in got) == {0: 20, 20: 20, 40: 20}
    if name == "op3_secret_scan":
        text = rows()[16][1]
        assert {hashlib.sha256(text[r["start"] : r["start"] + r["length"]].encode()).hexdigest() for r in got} == {r["value_sha256"] for r in got}
