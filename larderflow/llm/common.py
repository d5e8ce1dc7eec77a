"""Helpers shared by the training-data operators: shared folders, sorted runs, ragged arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one Python step works on at a time; a longer single text is its own step.
STEP_BYTES = 4 << 20
#: Rows that Arrow brings to Python at a time, where rows hold texts: JVM and worker each hold a batch.
TEXT_ROWS = 1_000
#: log2 of the bits of the filter that keeps rows without a partner out of a join.
FILTER_BITS = 24


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (as a URI or path) under spark.checkpoint.dir, which all executors see."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="larderflow-")  # one process: the driver's folder is the executors'
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/larderflow/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage is cut and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WORDS: dict[tuple, object] = {}


def give_back() -> None:
    """Returns a worker's freed memory to the system: a worker outlives its tasks, and what one stage has freed would stand beside the next one's."""
    pa.default_memory_pool().release_unused()
    c = ctypes.CDLL(None)
    if hasattr(c, "malloc_trim"):
        c.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays of 1 MB and more go back at once when freed
        c.malloc_trim(0)


def cached_words(key: tuple, make: Callable[[], object]) -> object:
    """A worker's cache of words: a worker that turns to another stage's cache drops the one it has."""
    if key not in _WORDS:
        without_words()
        _WORDS[key] = make()
    return _WORDS[key]


def without_words() -> None:
    """Drops a worker's cache of words. To be called first by whatever a worker does without one: workers are used again by the stages that follow."""
    _WORDS.clear()
    give_back()


def steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column's bytes stay near STEP_BYTES each."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype("f8")))
        cuts = [0, *(np.flatnonzero(np.diff((sizes // STEP_BYTES).astype("i8"))) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) for each run of equal keys in batches that are sorted by it; holds one run at a time."""
    without_words()
    held: list[pa.RecordBatch] = []
    now: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
    give_back()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0].., starts[1].., each with its length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, "i8")
    kind = "i4" if max(total, int(starts.max()) + total) < 2**31 else "i8"
    ends = np.cumsum(lengths, dtype="i8")
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def mapped(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, schema: str) -> DataFrame:
    """step over df's batches, in bounded slices by the bytes of a column."""

    def run(batches):
        for batch in steps(batches, column):
            out = step(batch)
            if out is not None:
                yield out

    return text_map(df, run, schema)


def text_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow for rows with texts: from here on the session's Arrow batches have TEXT_ROWS rows at most."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty() -> F.Column:
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


#: Holds the columns that an operator only hands on, whatever their names.
REST = "_rest"


def sealed(df: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """df's columns `own` and all others in one struct, so that their names cannot clash with an operator's."""
    rest = [F.col(f"`{c}`").alias(c) for c in df.columns if c not in own]
    return df.select(*own, F.struct(*(rest or [F.lit(0).alias("none")])).alias(REST))


def opened(columns: list[str], own: tuple[str, ...] = ("doc_id", "text")) -> list[Column]:
    """What to select from sealed rows to get `columns` back, in their order."""
    return [F.col(c) if c in own else F.col(REST).getField(c).alias(c) for c in columns]


def sieved(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with _touched: false for those whose keys are surely not in found (a join would only carry their texts about), true for the rest.

    rows: without columns _bit and _touched. The filter has a fixed 2 ** FILTER_BITS bits, 2 MB, whatever the number of keys: filled up, it lets every row pass to the join, which decides."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(1 << FILTER_BITS))
    words = found.select(bit.alias("b")).distinct().groupBy((F.col("b") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), "i8")
    bits[words["w"].to_numpy("i8")] = words["bits"].to_numpy("i8")
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def sieve(batches):
        without_words()
        for batch in batches:
            key = batch.column("_bit").to_numpy(zero_copy_only=False)
            hit = (held.value[key >> 6] >> (key & 63)) & 1 == 1
            columns = [batch.column(c) for c in batch.schema.names if c != "_bit"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hit)], [*(c for c in batch.schema.names if c != "_bit"), "_touched"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_touched", T.BooleanType())])
    return text_map(rows.withColumn("_bit", bit), sieve, schema)


def repeated_ids(docs: DataFrame) -> bool:
    """Whether two rows have the same doc_id."""
    return bool(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count())
