"""Token ids as raw binary shards with a minimal perfect hash index from document keys to shard offsets.

Files under a shared folder:
  ids/part-NNNNNN.ids   16 bytes of header (b"LFIDS001", width, 0), then the ids of all documents of the shard, little-endian unsigned
                        integers of `width` bytes; shards follow each other in ascending doc_id order (null ids first)
  index/part-NNNNNN.mph a minimal perfect hash over the keys that hash to this index part: slot -> stored fingerprint, shard, offset, length
A key is (doc_id, occurrence): rows that repeat a doc_id are numbered in the order of their texts.
Tasks write under a name of their own and rename, so that a lost or repeated task leaves one whole file.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm.common import documents, runs, shared_dir, steps, text_map, text_or_empty
from larderflow.llm.words import byte_pair_ids, cached

HEADER = "<8sII"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"LFIDS001"
#: Keys of one index part on average; a part is built and held by one task.
KEYS_PER_PART = 65_536
LEAST_PARTS = 64


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(uri: str, write) -> None:
    """Writes a file whole: under another name first, then renamed."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        write(out)
    files.move(part, path)


def mixed(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of a 128-bit one (the finaliser of splitmix64)."""
    x = h1 ^ (h2 * np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by levels: a key takes the first level on which no other waiting key has its position; its slot is the rank of that bit."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype("i8"), bits
        self.first = np.cumsum(self.sizes) - self.sizes
        words = np.unpackbits(bits, bitorder="little")
        self.set = words.astype(bool)
        self.rank = np.cumsum(words, dtype="i8") - words

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, spread: float = 1.5) -> PerfectHash:
        waiting, sizes, levels = np.arange(len(h1)), [], []
        while len(waiting):
            if len(sizes) > 200:
                raise ValueError("two keys have the same 128-bit hash")
            size = max(64, int(spread * len(waiting)))
            at = (mixed(h1[waiting], h2[waiting], len(sizes)) % np.uint64(size)).astype("i8")
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, "u1")
            level[at[alone]] = 1
            sizes.append(size)
            levels.append(level)
            waiting = waiting[~alone]
        return cls(np.array(sizes, "i8"), np.packbits(np.concatenate([*levels, np.zeros(0, "u1")]), bitorder="little"))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a key that is not in the set."""
        out, open_ = np.full(len(h1), -1, "i8"), np.arange(len(h1))
        for level, (size, first) in enumerate(zip(self.sizes.tolist(), self.first.tolist(), strict=True)):
            if not len(open_):
                break
            at = first + (mixed(h1[open_], h2[open_], level) % np.uint64(size)).astype("i8")
            hit = self.set[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mixed(h2, h1, 7919) >> np.uint64(32)).astype("u4")


def keyed(df: DataFrame) -> DataFrame:
    """Adds the 128-bit key hash of (doc_id, occurrence)."""
    return df.withColumns({"h1": F.xxhash64("doc_id", "occurrence", F.col("doc_id").isNull()), "h2": F.xxhash64(F.lit(0x5EED), "occurrence", "doc_id")})


def write_shards(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, width: int = 2) -> DataFrame:
    """Encodes docs (doc_id, text) and writes the id shards; returns and keeps (under out/records) one row per document:
    doc_id, occurrence, shard, offset (ids before it in the shard), n_tokens.

    Null texts count as empty; every document has at least its end id. Other columns are ignored."""
    spark = docs.sparkSession
    dtype = f"<u{width}"

    def write(batches):
        shard = TaskContext.get().partitionId()
        rows = []
        last, again, at = object(), 0, 0

        def body(stream):
            nonlocal last, again, at
            stream.write(struct.pack(HEADER, MAGIC, width, 0))
            for batch in steps(batches, "text"):
                ids, counts = byte_pair_ids(batch.column("text"), tokenizer_path, added=True)
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                ends = np.cumsum(counts)
                stream.write(np.insert(ids, ends, end_id).astype(dtype).tobytes())
                keys, occurrences = batch.column("doc_id"), []
                for key in keys.to_pylist():
                    again = again + 1 if key == last else 0
                    last = key
                    occurrences.append(again)
                counts = counts + 1
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                rows.append(pa.record_batch([keys, pa.array(occurrences, pa.int32()), pa.array(np.full(len(keys), shard, "i4")), pa.array(starts), pa.array(counts)], ["doc_id", "occurrence", "shard", "offset", "n_tokens"]))

        put(f"{out}/ids/part-{shard:06d}.ids", body)
        yield from rows

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", text_or_empty()).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    text_map(ordered, write, "doc_id long, occurrence int, shard int, offset long, n_tokens long").write.parquet(f"{out}/records")
    return spark.read.schema("doc_id long, occurrence int, shard int, offset long, n_tokens long").parquet(f"{out}/records")


def index_parts(records: DataFrame) -> int:
    return max(LEAST_PARTS, -(-records.count() // KEYS_PER_PART))


def write_index(records: DataFrame, out: str, parts: int) -> int:
    """Builds the minimal perfect hash index over the records' keys; returns the number of keys indexed."""

    def build(batches):
        for part, rows in runs(batches, "part"):
            h1, h2 = (rows.column(c).to_numpy().view("u8") for c in ("h1", "h2"))
            tree = PerfectHash.build(h1, h2)
            at = tree.slots(h1, h2)
            held = {"sizes": tree.sizes, "bits": tree.bits, "fingerprint": np.zeros(len(h1), "u4"), "shard": np.zeros(len(h1), "u4"), "offset": np.zeros(len(h1), "u8"), "length": np.zeros(len(h1), "u8")}
            held["fingerprint"][at] = _fingerprint(h1, h2)
            for column, name in (("shard", "shard"), ("offset", "offset"), ("n_tokens", "length")):
                held[name][at] = rows.column(column).to_numpy()
            raw = io.BytesIO()
            np.savez(raw, **held)
            put(f"{out}/index/part-{int(part):06d}.mph", lambda stream, data=raw.getvalue(): stream.write(data))
            yield pa.record_batch([pa.array([len(h1)], pa.int64())], ["n"])

    dealt = keyed(records).withColumn("part", F.pmod("h1", F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(build, "n long").agg(F.sum("n")).first()[0] or 0


def load_index(out: str, part: int) -> dict:
    files, path = filesystem(f"{out}/index/part-{part:06d}.mph")
    with files.open_input_file(path) as f:
        held = dict(np.load(io.BytesIO(f.read())))
    held["hash"] = PerfectHash(held["sizes"], held["bits"])
    return held


def find(held: dict, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, found): found where the slot's stored fingerprint is the key's."""
    at = held["hash"].slots(h1, h2)
    seen = (at >= 0) & (at < len(held["fingerprint"]))
    at = np.where(seen, at, 0)
    return at, seen & (held["fingerprint"][at] == _fingerprint(h1, h2)) if len(held["fingerprint"]) else np.zeros(len(h1), bool)


def located(keys: DataFrame, out: str, parts: int) -> DataFrame:
    """shard, offset, n_tokens of keys (doc_id, occurrence) by the index; keys it doesn't hold have no row (a foreign key passes once in 2^32)."""

    def look(batches):
        for part, rows in runs(batches, "part"):
            try:
                held = load_index(out, int(part))
            except FileNotFoundError:
                continue
            at, found = find(held, *(rows.column(c).to_numpy().view("u8") for c in ("h1", "h2")))
            rows, at = rows.filter(pa.array(found)), at[found]
            yield from pa.table([rows.column("doc_id"), rows.column("occurrence"), pa.array(held["shard"][at].astype("i4")), pa.array(held["offset"][at].astype("i8")), pa.array(held["length"][at].astype("i8"))], ["doc_id", "occurrence", "shard", "offset", "n_tokens"]).to_batches()

    dealt = keyed(keys.select("doc_id", "occurrence")).withColumn("part", F.pmod("h1", F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(look, "doc_id long, occurrence int, shard int, offset long, n_tokens long")


def read_ids(places: DataFrame, out: str) -> DataFrame:
    """Adds ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and n_read to located rows, reading each shard's ranges in order."""

    def read(batches):
        shard, stream, width = None, None, 0
        for batch in batches:
            crcs, counts = [], []
            for s, offset, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n_tokens")), strict=True):
                if s != shard:
                    if stream is not None:
                        stream.close()
                    files, path = filesystem(f"{out}/ids/part-{s:06d}.ids")
                    stream, shard = files.open_input_file(path), s
                    magic, width, _ = struct.unpack(HEADER, stream.read(HEADER_BYTES))
                    if magic != MAGIC:
                        raise ValueError(f"{path} is no id shard")
                stream.seek(HEADER_BYTES + offset * width)
                ids = np.frombuffer(stream.read(n * width), f"<u{width}").astype("<u4")
                crcs.append(zlib.crc32(ids.tobytes()))
                counts.append(len(ids))
            if batch.num_rows:
                yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "occurrence", "shard", "offset")), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "occurrence", "shard", "offset", "n_tokens", "ids_crc32"])
        if stream is not None:
            stream.close()

    return places.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(read, "doc_id long, occurrence int, shard int, offset long, n_tokens long, ids_crc32 long")


def shard_sizes(out: str) -> list[tuple[int, int]]:
    """(shard, number of ids) of all id files, by their sizes: a row for each file."""
    from pyarrow import fs

    files, path = filesystem(f"{out}/ids")
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    sizes = []
    for f in sorted(found, key=lambda f: f.base_name):
        if f.extension == "ids":
            with files.open_input_file(f.path) as stream:
                width = struct.unpack(HEADER, stream.read(HEADER_BYTES))[1]
            sizes.append((int(f.base_name[5:-4]), (f.size - HEADER_BYTES) // width))
    return sizes


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, writes, indexes and reads back every document; all answers come from the files by way of the index. Null texts are empty, and every
    document has its end id; rows that repeat a doc_id follow each other by their texts, null ids come first; other columns are left out."""
    import public_tokenizers

    out = shared_dir(spark, "token-shards")
    records = write_shards(documents(spark, sf_dir), out, str(public_tokenizers.path("byte_bpe_50k.json")), end_id=2)
    parts = index_parts(records)
    write_index(records, out, parts)
    starts, at = [], 0
    for shard, n in shard_sizes(out):
        starts.append((shard, at))
        at += n
    shards = spark.createDataFrame(starts, "shard int, before long")  # a row for each file
    back = read_ids(located(records, out, parts), out)
    return back.join(F.broadcast(shards.select("shard", "before")), "shard").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
