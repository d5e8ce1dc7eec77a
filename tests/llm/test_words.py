import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from larderflow.llm import piece_bpe, words
from tests.llm.helpers import rows

ODD = ["", " ", "  ", "a", "a  b", " a ", "a\n", "a \n b", "▁", "a▁b", "▁ a", "日本語 テスト😀 a", "\x00 a", "  " * 20 + "x", "a\tb c\n", "é é ́x", "<s> </s> <unk>", "'s it's  'S", "1234 56", " \x1c a", "A " * 50, "<|endoftext|> x", "ﬁ ſ İ ß Σ ΑΣ"]
TEXTS = ODD + [r[1] for r in rows() if r[1] is not None]


def same(ids, counts, expected):
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)] == expected


@pytest.mark.parametrize(("file", "encode"), [("byte_bpe_50k.json", words.byte_pair_ids), ("word_bpe_49k.json", words.word_pair_ids)])
def test_pieces_give_the_ids_of_whole_texts(file, encode):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(file))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    same(*encode(pa.array(TEXTS), path), [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS])


ADDED = ["a b <|endoftext|> c", "<|endoftext|>", "a <|endoftext|>b", "a<|endoftext|> b", "a  <|endoftext|>  b c", "<|endoftext|> <|startoftext|> a b", "x <|endoftext|>\n y z", " <|endoftext|>", "<|StartOfText|> a", "<|endof text|> a <|startoftext|>'s"]


@pytest.mark.parametrize(("file", "encode"), [("byte_bpe_50k.json", words.byte_pair_ids), ("word_bpe_49k.json", words.word_pair_ids)])
def test_added_tokens_have_the_library_s_ids(file, encode):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(file))
    tokenizer = Tokenizer.from_file(path)
    same(*encode(pa.array(TEXTS + ADDED), path, added=True), [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS + ADDED])


def test_backtracking_gives_the_library_s_ids():
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    same(*piece_bpe.piece_ids(pa.array(TEXTS), path), [model.encode(t) for t in TEXTS])


def test_backtracking_on_random_words():
    import random

    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = piece_bpe.PieceEncoder(piece_bpe.model_pieces(path))
    r = random.Random(5)
    for _ in range(3000):
        word = "".join(r.choice("aaeeiioutnsrhlddcmfpgwybvkxjqzABéß0 1.,") for _ in range(r.randrange(1, 25))).replace("  ", " ")
        assert encoder.encode((" " + word).replace(" ", "▁")) == model.encode(word)


def test_cache_keeps_frequent_words_within_its_limit():
    asked = []

    def encode_many(pieces):
        asked.extend(pieces)
        return np.array([int(p[1:]) for p in pieces], "u4"), np.ones(len(pieces), "i8")

    cache = words.PieceCache(encode_many, "", "", limit=4, apart=True)
    for i in range(20):
        ids, counts = cache.encode([f"a7 b{i} a7", f"c{i} a7 c{i}", f"a7 c{i}"])
        assert counts.tolist() == [3, 3, 2] and ids.tolist() == [7, i, 7, i, 7, i, 7, i]
        assert len(cache.kept["h1"]) <= 4
    assert asked.count("a7") == 1 and asked.count("b3") == 1  # frequent ones stay
