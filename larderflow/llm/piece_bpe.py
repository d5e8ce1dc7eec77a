"""SentencePiece BPE encoding by backtracking, without a merge queue over the text.

An encoding by merges is the one sequence of vocabulary pieces in which every two neighbours, joined and merged again, fall back into just these
two. So: take the longest piece at each place (Aho-Corasick), keep it if it goes with the piece before it, else a shorter one, else step back and
mark the place as failed in a bitfield."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larderflow.llm.common import cached_words, documents, mapped, text_or_empty
from larderflow.llm.words import PieceCache, cached

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceEncoder:
    """Encodes marked text (spaces already SPACE) with a SentencePiece BPE vocabulary: pieces [(text, score, type)]."""

    def __init__(self, pieces: list[tuple[str, float, int]], pairs: int = 1_000_000):
        import ahocorasick

        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.finder = ahocorasick.Automaton()
        for p in self.ids:
            self.finder.add_word(p, p)
        self.finder.make_automaton()
        self.singles = {p for p in self.ids if len(p) == 1}
        # a piece that merging alone doesn't give back can't be in an encoding
        self.dead = {p for p in self.ids if len(p) > 1 and self.merged(p) != [p]}
        self.goes: dict[tuple[str, str], bool] = {}
        self.pairs = pairs

    def merged(self, text: str) -> list[str]:
        """The best-scored merge, leftmost of equals, until none is left: only for the few characters of two pieces."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def together(self, a: str, b: str) -> bool:
        known = self.goes.get((a, b))
        if known is None:
            if len(self.goes) >= self.pairs:
                self.goes.clear()
            known = self.goes[a, b] = self.merged(a + b) == [a, b]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all in the vocabulary."""
        n = len(text)
        at: list[list[str]] = [[] for _ in range(n)]
        for end, p in self.finder.iter(text):
            if p not in self.dead:
                at[end - len(p) + 1].append(p)  # a start's pieces come by growing length
        failed = bytearray(n + 1)  # places from which the rest has no encoding; a bit in a byte each, so that a look costs the same at any length
        out: list[str] = []
        tries: list[int] = []
        pos, k = 0, len(at[0]) - 1 if n else -1
        while pos < n:
            options, last = at[pos], out[-1] if out else None
            while k >= 0:
                p = options[k]
                if not failed[pos + len(p)] and (last is None or self.together(last, p)):
                    break
                k -= 1
            if k >= 0:
                out.append(p)
                tries.append(k)
                pos += len(p)
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                if not out:
                    return self.merged(text)  # a vocabulary whose merges are not a tree; none is known
                failed[pos] = 1
                pos -= len(out.pop())
                k = tries.pop() - 1
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if all(c in self.singles for c in text):
            return [self.ids[p] for p in self.split(text)]
        start = 0
        for i, c in enumerate(text):
            if c not in self.singles:  # never part of a merge: its bytes
                out += [self.ids[p] for p in self.split(text[start:i])]
                out += [self.byte.get(b, self.unknown) for b in c.encode()] if self.byte else [self.unknown]
                start = i + 1
        return out + [self.ids[p] for p in self.split(text[start:])]

    def encode_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.encode(w.replace(" ", SPACE)) for w in words]
        counts = np.fromiter(map(len, lists), "i8", len(lists))
        return np.fromiter((i for x in lists for i in x), "u4", int(counts.sum())), counts


def model_pieces(path: str) -> list[tuple[str, float, int]]:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    inner = [p.piece for p in model.pieces if p.type == NORMAL and SPACE in p.piece.lstrip(SPACE)]
    singles = {p.piece for p in model.pieces if p.type == NORMAL and len(p.piece) == 1}
    lost = [p.piece for p in model.pieces if p.type == NORMAL and any(c not in singles for c in p.piece)]
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or inner or lost or any(p.type in (USER, UNUSED) for p in model.pieces):
        raise ValueError("only BPE models with the identity normaliser, a space put first and pieces that start at spaces are read")
    return [(p.piece, p.score, p.type) for p in model.pieces]


def library(path: str):
    def load():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)

    return cached(("sentencepiece", path), load)


def sentence_pieces(path: str) -> PieceCache:
    return PieceCache(PieceEncoder(model_pieces(path)).encode_many, " ", " ", re.compile(SPACE))


def piece_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts (no nulls) as SentencePiece's own encode gives them, without begin and end ids; an empty text has none."""
    return cached_words(("pieces", path), lambda: sentence_pieces(path)).encode(texts)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (with begin and end ids) and decoded text, one row per row of docs (doc_id, text); a null text counts as empty, other columns are ignored."""

    def step(batch):
        model = library(path)
        out = []
        for ids in with_ends(batch, path, model):
            out.append((ids.tolist(), model.decode(ids.tolist())))
        return pa.record_batch([batch.column("doc_id"), pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.string())], ["doc_id", "ids", "decoded"])

    return mapped(docs.select("doc_id", text_or_empty()), step, "text", "doc_id long, ids array<int>, decoded string")


def with_ends(batch: pa.RecordBatch, path: str, model) -> list[np.ndarray]:
    ids, counts = piece_ids(batch.column("text"), path)
    ends = np.cumsum(counts)
    return [np.concatenate([[model.bos_id()], ids[b - n : b], [model.eos_id()]]).astype("<u4") for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode_decode with its ids and texts as digests, so that no ids leave the task."""

    def step(batch):
        model = library(path)
        counts, ids_sha, text_sha = [], [], []
        for ids in with_ends(batch, path, model):
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(model.decode(ids.tolist()).encode()).hexdigest())
        return pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select("doc_id", text_or_empty()), step, "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests() of `documents`: a row for each row, repeated ones and those with a null doc_id too; null texts count as empty and have the begin and end
    ids alone; other columns are left out; an empty table gives an empty one."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), str(public_tokenizers.path("piece_bpe_32k.model")))
