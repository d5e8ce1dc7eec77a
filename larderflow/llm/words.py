"""Word-wise token ids: a text is cut where no token can cross, and each distinct piece is encoded once per worker."""

from __future__ import annotations

import itertools
import json
import os
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larderflow.llm.common import cached_words, ragged

#: Between a character that is no white space and a single space before another such character.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces that one call of the tokenizer takes: what it returns for each is far larger than its ids.
ENCODED_AT_ONCE = 10_000
MARKS = string.punctuation
#: Below it, libraries agree on what is a letter and on lower case; U+0130 alone becomes two characters.
LATIN_END = "\u0250"
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")


class PieceCache:
    """Ids of the words of texts. A word stands after `rest`, a text's first word after `first`; words are what lies between single spaces.

    encode_many: list of pieces -> (flat ids, number of ids per piece). A word that begins or ends with white space (or is empty, or that `unsafe`
    finds) may belong together with its neighbours: its text is cut at SAFE_CUT only; not so if words never do (`apart`). With `marks`, ASCII marks
    at a word's end never share an id with the letter or digit before them, so that they are a piece of their own.

    The distinct words of a call are found by Arrow and their pieces encoded once. Pieces are kept for later calls, `limit` of them at most: beyond
    it the most frequent ones of the latest call remain, so memory is bounded and common words are never encoded anew. What is kept of a piece are two
    64-bit hashes and its ids, in arrays sorted by the first hash: some 40 bytes."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], first: str, rest: str, unsafe: re.Pattern | None = None, limit: int = 600_000, apart: bool = False, marks: bool = False, dtype: str = "u4"):
        self.encode_many, self.first, self.rest, self.unsafe, self.limit, self.apart, self.marks, self.dtype = encode_many, first, rest, unsafe, limit, apart, marks, dtype
        self._begin()

    def _begin(self) -> None:
        self.kept = {"h1": np.zeros(0, "i8"), "h2": np.zeros(0, "i8"), "start": np.zeros(0, "i4"), "length": np.zeros(0, "i4")}
        self.pool = np.zeros(0, self.dtype)

    def _all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.encode_many(pieces[a : a + ENCODED_AT_ONCE]) for a in range(0, len(pieces), ENCODED_AT_ONCE)]
        return (np.concatenate([x for x, _ in parts]).astype(self.dtype), np.concatenate([n for _, n in parts]).astype("i8")) if parts else (np.zeros(0, self.dtype), np.zeros(0, "i8"))

    def _pieces(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """(distinct pieces, for each word its first and second piece): -1 is no piece; -2, as the first, a word whose text must be cut otherwise."""
        at: dict[str, int] = {}
        find = self.unsafe.search if self.unsafe is not None and self.unsafe.search("\0".join(words)) else None
        one, two, new, rest, apart, marks, last = [], [], at.setdefault, self.rest, self.apart, self.marks, MARKS[-1]
        for w in words:
            if not apart and (not w or len(w.strip()) < len(w) or (find is not None and find(w))):
                one.append(-2)
                two.append(-1)
                continue
            if marks and w and w[-1] <= last and not w[-1].isalnum():
                body = w.rstrip(MARKS)
                if body and body[-1] < LATIN_END and body[-1].isalnum():
                    one.append(new(rest + body, len(at)))
                    two.append(new(w[len(body) :], len(at)))
                    continue
            one.append(new(rest + w, len(at)))
            two.append(-1)
        return list(at), np.column_stack([np.array(one, "i4"), np.array(two, "i4")])

    def _keep(self, hashes: np.ndarray, new: np.ndarray, times: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> None:
        """Takes the new pieces in, or if there are too many begins anew with the most frequent ones of this call."""
        if len(self.kept["h1"]) + len(new) > self.limit:
            new = np.flatnonzero(times > 1)
            if len(new) > self.limit // 2:
                new = new[np.argsort(-times[new], kind="stable")[: self.limit // 2]]
            self._begin()
        sizes = lengths[new]
        added = {"h1": hashes[0, new], "h2": hashes[1, new], "start": (len(self.pool) + np.cumsum(sizes) - sizes).astype("i4"), "length": sizes.astype("i4")}
        order = np.argsort(np.concatenate([self.kept["h1"], added["h1"]]), kind="stable")
        self.kept = {k: np.concatenate([v, added[k]])[order] for k, v in self.kept.items()}
        self.pool = np.concatenate([self.pool, pool[ragged(starts[new], sizes)]])

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per text) of texts without nulls."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, "i8")
        rows = pc.split_pattern(texts, " ")
        words_in = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype("i8")
        coded = rows.flatten().dictionary_encode()
        words, seq = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        del rows, coded
        pieces, parts = self._pieces(words)
        hashes = np.array([np.fromiter(map(hash, pieces), "i8", len(pieces)), np.fromiter((hash(p + "\0") for p in pieces), "i8", len(pieces))])
        slots, hit = np.searchsorted(self.kept["h1"], hashes[0]), np.zeros(len(pieces), bool)
        if len(self.kept["h1"]):
            slots = np.minimum(slots, len(self.kept["h1"]) - 1)
            hit = (self.kept["h1"][slots] == hashes[0]) & (self.kept["h2"][slots] == hashes[1])
        known, new = np.flatnonzero(hit), np.flatnonzero(~hit)
        flat, counts = self._all([pieces[i] for i in new.tolist()])
        starts, lengths = np.zeros(len(pieces) + 1, "i4"), np.zeros(len(pieces) + 1, "i4")  # the last one: no piece
        starts[known], lengths[known] = self.kept["start"][slots[known]], self.kept["length"][slots[known]]
        starts[new], lengths[new] = len(self.pool) + np.cumsum(counts) - counts, counts
        pool = np.concatenate([self.pool, flat])
        times = np.bincount(np.maximum(parts, -1).ravel() + 1, weights=np.repeat(np.bincount(seq, minlength=len(words)), 2), minlength=len(pieces) + 1)[1:]
        self._keep(hashes, new, times, starts, lengths, pool)

        heads = np.cumsum(words_in) - words_in
        lens, at = lengths[np.maximum(parts, -1)][seq], starts[np.maximum(parts, -1)][seq]
        own: dict[int, np.ndarray] = {}  # a text's ids, where they aren't those of its words
        if (odd := parts[:, 0] == -2).any():
            for i in np.flatnonzero(np.logical_or.reduceat(odd[seq], heads)).tolist():
                own[i] = self._apart(texts[i].as_py())
            lens[np.repeat(np.isin(np.arange(len(texts)), list(own)), words_in)] = 0
        if self.first != self.rest:  # the first words stand after something else
            todo = np.setdiff1d(np.arange(len(texts)), list(own))
            firsts, which = np.unique(seq[heads[todo]], return_inverse=True)
            flat, counts = self._all([self.first + words[i] for i in firsts.tolist()])
            at[heads[todo], 0], lens[heads[todo], 0], lens[heads[todo], 1] = (len(pool) + np.cumsum(counts) - counts)[which], counts[which], 0
            pool = np.concatenate([pool, flat])
        ids = pool[ragged(at.ravel(), lens.ravel())]
        counts = np.add.reduceat(lens.sum(1, dtype="i8"), heads)
        if own:
            ends = np.cumsum(counts)
            texts_ids = [own[i] if i in own else ids[ends[i] - counts[i] : ends[i]] for i in range(len(texts))]
            ids, counts = np.concatenate(texts_ids), np.fromiter(map(len, texts_ids), "i8", len(texts_ids))
        return ids, counts

    def _apart(self, text: str) -> np.ndarray:
        """The ids of one text, cut at SAFE_CUT, without a cut beside what `unsafe` finds."""
        cut: list[str] = []
        for x in SAFE_CUT.split(text):
            if cut and self.unsafe is not None and (self.unsafe.search(x) or self.unsafe.search(cut[-1])):
                cut[-1] += " " + x
            else:
                cut.append(x)
        if not text:
            return np.zeros(0, "u4")
        pieces = [self.first + cut[0], *(self.rest + x for x in cut[1:])]
        alike = list(dict.fromkeys(pieces))
        flat, counts = self.encode_many(alike)
        at = dict(zip(alike, np.split(flat, np.cumsum(counts)[:-1]), strict=True))
        return np.concatenate([at[p] for p in pieces]).astype("u4")


_CACHES: dict[tuple, object] = {}


def cached(key: tuple, make: Callable[[], object]) -> object:
    """One object per worker process and key: tokenizers and models outlive a task."""
    if key not in _CACHES:
        _CACHES[key] = make()
    return _CACHES[key]


LOWER_RULES = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def library_pieces(path: str, first: str, rest: str, added: bool = False) -> PieceCache:
    """Pieces encoded by the tokenizers library with the file at `path`, without special tokens around them. The file's added tokens, such as
    <|endoftext|>, are plain text, or with `added` the ids that the library by itself gives them; no cut is made beside them."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added else []
    # a token with white space in it may lie over any cut: then none is made
    unsafe = re.compile("" if any(re.search(r"\s", x) for x in names) else "|".join(map(re.escape, names))) if names else None

    # a normaliser that lower-cases and does nothing else to plain words: these are lower-cased here, and alike ones encoded once
    rules = json.loads(tokenizer.to_str())
    lowers = (rules["normalizer"] or {}).get("normalizers") == LOWER_RULES
    plain = Tokenizer.from_str(json.dumps(rules | {"normalizer": None})) if lowers else None

    def ids_of(t, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [x.ids for x in t.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), "i8", len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), "u4", int(counts.sum())), counts

    def encode_many(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not lowers:
            return ids_of(tokenizer, pieces)
        low, rest_of = {}, {}
        place = [low.setdefault(p.lower(), len(low)) if PLAIN.fullmatch(p) and "<|" not in p else ~rest_of.setdefault(p, len(rest_of)) for p in pieces]
        (a, n), (b, m) = ids_of(plain, list(low)), ids_of(tokenizer, list(rest_of))
        at = np.array(place, "i8")
        at = np.where(at < 0, len(low) + ~at, at)
        counts = np.concatenate([n, m])
        return np.concatenate([a, b])[ragged((np.cumsum(counts) - counts)[at], counts[at])], counts[at]

    return PieceCache(encode_many, first, rest, unsafe, marks=True)


def library_cache(path: str, rest: str, added: bool = False) -> PieceCache:
    """library_pieces() for texts as they stand, kept by the worker."""
    return cached_words(("library", path, rest, added), lambda: library_pieces(path, "", rest, added))


def byte_pair_ids(texts: pa.Array, path: str, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids by a byte-level BPE file: a space belongs to the word after it."""
    return library_cache(path, " ", added).encode(texts)


def word_pair_ids(texts: pa.Array, path: str, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids by a BPE file with word ends, which drops white space: words stand alone."""
    return library_cache(path, "", added).encode(texts)


def term_hashes(texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all terms, number of terms per text). Terms are runs of letters and digits, lower-cased."""

    def make() -> PieceCache:
        import xxhash

        find = re.compile(r"[^\W_]+").findall

        def encode_many(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lists = [[xxhash.xxh64_intdigest(t) for t in find(w.lower())] for w in words]
            counts = np.fromiter(map(len, lists), "i8", len(lists))
            return np.fromiter(itertools.chain.from_iterable(lists), "u8", int(counts.sum())), counts

        return PieceCache(encode_many, "", "", apart=True, marks=True, dtype="u8")

    return cached_words(("terms",), make).encode(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
