"""I-Match fingerprints: the terms of a document within a band of inverse document frequency, sorted and hashed once per randomised lexicon subset."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm.common import documents, steps, text_map, text_or_empty
from larderflow.llm.words import mix, term_hashes

#: log2 of the different terms that a task counts before it hands their numbers on.
BITS = 20
#: The band: a term is in at least 1 / RARE and at most 1 / COMMON of the documents.
RARE, COMMON = 5_000, 5
#: Lexicon subsets.
SUBSETS = 32
#: Terms that are hashed for all subsets at a time.
BLOCK_TERMS = 1 << 15
#: Ranges of doc_id that documents are dealt to, at most.
MOST_RANGES = 4_096


def distinct(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, text) of term_hashes(), each term once for each text, sorted within it. Texts lie side by side, so each is sorted by itself."""
    out, ends = h.copy(), np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    text = np.repeat(np.arange(len(n)), n)
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[first], text[first]


class Held:
    """Numbers of terms that a task has met."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, terms: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((terms, times))
        self.n += len(terms)

    def given(self, most: int) -> Iterator[pa.RecordBatch]:
        """Adds up what is held; hands it on if these are more than `most` terms."""
        if not self.parts:
            return
        terms, place = np.unique(np.concatenate([t for t, _ in self.parts]), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([n for _, n in self.parts]), minlength=len(terms)).astype("i8")
        self.parts, self.n = [(terms, times)], len(terms)
        if len(terms) > most:
            self.parts, self.n = [], 0
            for a in range(0, len(terms), 100_000):
                yield pa.record_batch([pa.array(terms[a : a + 100_000].view("i8")), pa.array(times[a : a + 100_000])], ["term", "n"])


def packed_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each batch, eight bytes each, as one value."""
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch([pa.array([batch.column("term").to_numpy().astype("<i8").tobytes()], pa.binary())], ["terms"])


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> np.ndarray:
    """The sorted hashes of the terms within the band, by their own document frequencies over all docs (text).

    One pass: tasks count the terms of their documents, the shuffle adds these numbers up. However large the corpus, a document has on average at
    least 1 / `rare` of a place for each term of the band: it has `rare` times the mean number of distinct terms of a document at most."""
    n_docs, most = docs.count(), 1 << BITS
    low, high = max(2, -(-n_docs // rare)), max(2, n_docs // common)

    def count(batches):
        held = Held()
        for batch in steps(batches, "text"):
            terms, _ = distinct(*term_hashes(batch.column("text")))
            held.add(*np.unique(terms, return_counts=True))
            if held.n > most:
                yield from held.given(most // 2)
        yield from held.given(0)

    counted = text_map(docs.select(text_or_empty()), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # a row for each batch of terms, not one for each term
    packed = counted.filter(F.col("n").between(low, high)).select("term").mapInArrow(packed_terms, "terms binary").collect()
    return np.sort(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(row["terms"], "<u8") for row in packed)]))


def fingerprints(texts: list[str], band: np.ndarray | None) -> list[str]:
    """`level:all:signatures:signatures:signatures` of each text: a hash of all its terms in the band, and SUBSETS four-digit signatures (0000: none of
    its terms is in the subset) on a level and the next two. A level halves the lexicon subsets; a text's own is that on which about one of its terms
    is in a subset, so likeness is told by a sample of some 40 terms, equality by all of them.

    Texts without a term in the band use all their terms; texts without any term have `=` and a digest of themselves."""
    terms, text = distinct(*term_hashes(texts))
    if band is not None and len(band):
        inside = band[np.minimum(np.searchsorted(band, terms), len(band) - 1)] == terms
        some = np.bincount(text[inside], minlength=len(texts)) > 0
        keep = inside | ~some[text]
        terms, text = terms[keep], text[keep]
    n = np.bincount(text, minlength=len(texts))
    seeds = mix(np.arange(1, SUBSETS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
    value = mix(terms * np.uint64(0xC2B2AE3D27D4EB4F))
    level = np.maximum(np.frexp(n.astype("f8"))[1] - 1, 0)  # bit length less one
    sums = np.zeros((3, len(texts) * SUBSETS), "u8")
    met = np.zeros((3, len(texts) * SUBSETS), bool)
    every = np.zeros(len(texts), "u8")
    # a term is in a subset on a level if its hash there begins with so many zeros: what is in one on the text's own level is looked at for the next two
    most = [np.uint64(2**64 - 1) >> (level + k).astype("u8") for k in range(3)]
    # blocks of terms, whole texts or parts of a long one: what is held doesn't grow with a text
    for a in range(0, len(terms), BLOCK_TERMS):
        t, v, at = terms[a : a + BLOCK_TERMS], value[a : a + BLOCK_TERMS], text[a : a + BLOCK_TERMS]
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        every[at[begins]] += np.add.reduceat(v, begins)
        chance = mix(t[:, None] ^ seeds)
        row, subset = np.nonzero(chance <= most[0][at][:, None])
        chance, owner, v = chance[row, subset], at[row], v[row]
        for k in range(3):
            inside = chance <= most[k][owner]
            cell = owner[inside] * SUBSETS + subset[inside]
            np.add.at(sums[k], cell, v[inside])
            met[k, cell] = True
    sums, met = sums.reshape(3, -1, SUBSETS), met.reshape(3, -1, SUBSETS)
    signs = np.where(met, np.maximum(mix(sums ^ seeds) >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype(">u2")
    out = []
    for i, own in enumerate(texts):
        if n[i]:
            out.append(":".join([str(level[i]), f"{int(every[i]):016x}", *(signs[k, i].tobytes().hex() for k in range(3))]))
        else:
            out.append("=" + hashlib.sha256(own.encode()).hexdigest())
    return out


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: equal signatures out of those that either text has, on the lowest level both show; 0 if there is none. Below 1 if the hashes
    of all terms differ."""
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    (la, all_a, *sa), (lb, all_b, *sb) = a.split(":"), b.split(":")
    level = max(int(la), int(lb))
    if level - min(int(la), int(lb)) >= len(sa):
        return 0.0
    x, y = sa[level - int(la)], sb[level - int(lb)]
    same = either = 0
    for i in range(0, len(x), 4):
        p, q = x[i : i + 4], y[i : i + 4]
        if p != "0000" or q != "0000":
            either += 1
            same += p == q
    return min(same / either if either else 0.0, 1.0 if all_a == all_b else 1 - 0.5 / SUBSETS)


def edited(text: str, following: str) -> str:
    """The last third of a text, in code points, replaced by as many first ones of the following text, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _between(value: Column, cuts: list[int], low: int = 0) -> Column:
    """How many of the sorted cuts are at most value, as a balanced tree of conditions."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(value < cuts[mid], _between(value, cuts[:mid], low)).otherwise(_between(value, cuts[mid + 1 :], low + mid + 1))


def with_following(docs: DataFrame, step, schema: str) -> DataFrame:
    """step over (doc_ids, texts, texts of the next documents) in descending doc_id order (null ids last, equal ids by text); the last one's next is
    the first. Documents are dealt by ranges of doc_id; the head of each range is also sent to the range before it, so no range waits for another."""
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    ids = docs.select(key.alias("k"))
    cuts = sorted({int(x) for x in ids.filter("k > -9223372036854775808").approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    place = _between(F.col("k"), cuts)
    heads = {r["at"]: r["k"] for r in ids.groupBy(place.alias("at")).agg(F.max("k").alias("k")).collect()}  # a row per range
    filled = sorted(heads, reverse=True)
    before = {heads[at]: filled[i - 1] for i, at in enumerate(filled)}
    targets = sorted(before)
    jump = F.lit(-1)
    if targets:
        jump = F.when(F.col("k").isin(targets), F.element_at(F.array(*[F.lit(before[t]) for t in targets]), _between(F.col("k"), targets))).otherwise(-1)
    rows = docs.select("doc_id", text_or_empty(), key.alias("k")).withColumn("at", place)
    rows = rows.withColumn("to", F.when(jump >= 0, F.array(F.struct("at", F.lit(False).alias("extra")), F.struct(jump.alias("at"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct("at", F.lit(False).alias("extra")))))
    rows = rows.select("doc_id", "text", "k", F.explode("to").alias("to")).select("doc_id", "text", "k", "to.*")
    dealt = rows.repartitionById(max(1, len(cuts) + 1), F.col("at")).sortWithinPartitions("extra", F.desc("k"), "text").select("doc_id", "text", "extra")

    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, texts, over = [], [], False  # the row that waits for the next one
        for batch in steps(batches, "text"):
            if over:
                continue
            for i, t, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "extra")), strict=True):
                ids.append(i)
                texts.append(t)
                if extra:
                    over = True
                    break
            if len(texts) > 1:
                yield step(ids[:-1], texts[:-1], texts[1:])
                ids, texts = ids[-1:], texts[-1:]

    return text_map(dealt, run, schema)


def fingerprinted(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """fingerprint, edited_fingerprint and their likeness for every row of docs (doc_id, text); null texts count as empty, other columns are ignored.
    Equal texts have equal fingerprints. An empty table gives an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs, rare, common))

    def step(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        band = held.value
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        both = fingerprints([*texts, following[-1], *changed], band)  # at once: an edited text has the words of its two
        own, other = both[: len(texts) + 1], both[len(texts) + 1 :]
        return pa.record_batch(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(own[:-1]), pa.array(other),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)]), pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_following(docs, step, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprinted() of `documents`: a row for each row. Null texts count as empty; rows that repeat a doc_id follow each other by their texts, null
    ids come last; other columns are left out; an empty table gives an empty one."""
    return fingerprinted(documents(spark, sf_dir))
