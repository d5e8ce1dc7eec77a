"""Token alignment and its pair counts, against plain loops over the two libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers

from larderflow.llm import alignment
from tests.llm.helpers import empty, rows, table

A_PATH, B_PATH = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def expected(some):
    import sentencepiece
    from tokenizers import Tokenizer

    a_library = Tokenizer.from_file(A_PATH)
    a_library.encode_special_tokens = True
    b_library, letter = sentencepiece.SentencePieceProcessor(model_file=B_PATH), alignment.byte_letters()

    def piece(i):
        p = b_library.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode()

    out, pairs = [], Counter()
    for doc_id, text in some:
        a, b = (a_library.encode(" " + text, add_special_tokens=False).ids, b_library.encode(text)) if text else ([], [])
        a_bytes, b_bytes = [bytes(letter[c] for c in a_library.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            out.append((doc_id, [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            k, n = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
            groups.append((a[i:k], b[j:n]))
            i, j = k, n
        pairs.update((x, y) for x, ends in zip(a, a_ends, strict=True) for y, stops in zip(b, b_ends, strict=True) if ends == stops) if len(a) < 300 else pairs.update((g[-1], h[-1]) for g, h in groups)
        out.append((doc_id, a, b, groups))
    best = Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    want = Counter()
    for doc_id, a, b, groups in out:
        links = [(g[-1], h[-1]) for g, h in groups]
        listed = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        want[doc_id, len(a), len(b), len(groups), len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(listed.encode()).hexdigest() if groups else ""] += 1
    return want


ODD = [(100, "a <|endoftext|> b<s></s> <unk>"), (101, " two  spaces "), (102, "▁marked"), (103, "tail\n\n \t"), (104, "日本語と English mixed 🙂🙂"), (105, " "), (106, "a <0x41> b")]


def test_alignment_against_the_libraries(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_KEYS", 50)  # many shards
    monkeypatch.setattr(alignment, "HELD_KEYS", 20)
    made = [r for r in rows() if r[0] != 12] + [(i, t, "en", "s", 1, *rows()[0][5:]) for i, t in ODD]
    out = alignment.align_documents(table(spark, made), A_PATH, B_PATH)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in out.collect())
    assert got == expected([r[:2] for r in made])
    assert {r[0] for r in got if r[1] == 0} >= {6, 7, 102}  # empty, null, and a text that holds the space's own mark


def test_long_text(spark):
    some = [r for r in rows() if r[0] == 12]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.align_documents(table(spark, some), A_PATH, B_PATH).collect())
    assert got == expected([r[:2] for r in some])


def test_empty_table_and_texts_without_tokens(spark):
    assert alignment.align_documents(empty(spark), A_PATH, B_PATH).count() == 0
    some = [r for r in rows() if not r[1]]
    assert {tuple(r)[1:] for r in alignment.align_documents(table(spark, some), A_PATH, B_PATH).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_one_pair_in_most_rows(spark):
    """A very frequent pair comes to the shard that sums it as one partial count of each task."""
    docs = spark.range(3000).selectExpr("id as doc_id", "'the the the' as text").repartition(5)
    links = alignment.align(docs, A_PATH, B_PATH)
    partial = alignment.partial_counts(links)
    assert partial.groupBy("key").count().agg({"count": "max"}).first()[0] <= 5
    assert {r["count_sum"] for r in alignment.align_documents(docs, A_PATH, B_PATH).collect()} == {3 * 9000}


def test_count_table(tmp_path):
    keys, counts = np.arange(0, 200, 2, dtype="i8"), np.arange(1, 101, dtype="i8")
    names = []
    for i, part in enumerate(np.array_split(np.arange(100), 3)):
        with open(f"{tmp_path}/s{i}.counts", "wb") as f:
            f.write(keys[part].astype("<i8").tobytes() + counts[part].astype("<i8").tobytes())
        names.append((int(keys[part[0]]), len(part), f"s{i}"))
    table_ = alignment.CountTable(str(tmp_path), names[::-1])
    asked = np.arange(-3, 210, dtype="i8")
    assert table_.counts(asked).tolist() == [k // 2 + 1 if 0 <= k < 200 and k % 2 == 0 else 0 for k in asked.tolist()]
    assert isinstance(table_.shard(0)[0], np.memmap)


def test_rows_are_compared_by_their_bytes():
    x, y = np.frombuffer(b"abcd", "u1"), np.frombuffer(b"abxd", "u1")
    assert alignment.equal_rows(x, np.array([2, 2, 4]), y, np.array([2, 2, 4])).tolist() == [True, True, False]
    assert alignment.equal_rows(x, np.array([1, 4]), y, np.array([2, 4])).tolist() == [False, False]
