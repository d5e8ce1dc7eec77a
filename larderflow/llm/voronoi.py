"""Exact top-k by inner product as a Voronoi kNN join.

Vectors belong to the cell of their nearest pivot p, at a distance r. By Cauchy-Schwarz, q.x <= q.p + |q| r for every vector x of the cell. Queries of
neighbouring cells form groups. A group is first compared with a share of the vectors of its own cells; the k-th best score that a query has found
there is one that the final answer cannot fall below. So a vector matters to the group only if, for one of its queries, the bound reaches that score:
r must be at least the least (score - q.p) / |q|. Cells whose farthest vector is nearer are not sent, of the others only the vectors far enough from
their pivot. What is sent is compared in blocks of bounded size, whose best k per query are merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.llm.common import STEP_BYTES, materialised, ragged, without_words

#: Vectors of a cell, on average, and the most pivots: the driver and every task hold the pivots and one summary row for each.
CELL_ROWS, MOST_PIVOTS = 160, 1_024
#: Vectors and queries of one block, on average: a task compares one block of each at a time.
BLOCK_ROWS = 2_048
#: The table of which group needs which cell is sent to every task up to so many rows; beyond it, it is joined by cell.
MOST_NEEDS = 200_000


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and v (integer components) of the vectors that take part: neither null nor with a null or non-finite component; floor(64 * x)."""
    x = F.col("embedding").cast("array<double>")
    whole = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    # as doubles first: what is too large for exact scores is refused, not wrapped
    return vectors.filter(whole).select("vec_id", F.transform(x, lambda e: F.floor(F.greatest(F.least(e * 64, F.lit(2.0**62)), F.lit(-(2.0**62))))).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows as a matrix of doubles, shorter ones filled up with zeros to `width`; integer products are exact in it up to 2^53."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype("f8")
    if len(flat) == len(values) * width:
        return flat.reshape(len(values), width)
    sizes = pa.compute.list_value_length(values).to_numpy(zero_copy_only=False).astype("i8")
    out = np.zeros((len(values), width))
    out[np.repeat(np.arange(len(values)), sizes), ragged(np.zeros(len(sizes), "i8"), sizes)] = flat
    return out


def measured(vectors: DataFrame) -> tuple[int, int]:
    """(rows, greatest length, 1 at least) of vectors. Raises if components are so large that a score might not be exact in a double."""
    rows, width, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda e: F.abs(e.cast("double")))))).first()
    if rows and (most or 0) ** 2 * (width or 0) >= 2**53:
        raise ValueError("components are too large for exact scores")
    return rows, max(1, width or 0)


def best(asked: np.ndarray, q_ids: np.ndarray, data: np.ndarray, s_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices into data, scores) of each query's k best, equal scores in the order of data; -inf where there is none. The query's own id is none."""
    product = asked @ data.T
    product[q_ids[:, None] == s_ids] = -np.inf
    order = np.argsort(-product, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(product, order, 1)


def candidates(vectors: DataFrame, queries: DataFrame, k: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame] | None:
    """(asked, sent): queries and the vectors that they need, by group g and block b (vec_id, v); None if there is nothing to ask or to find."""
    spark = vectors.sparkSession
    rows, width = measured(vectors)
    if pivots is None:
        pivots = max(1, min(MOST_PIVOTS, -(-rows // CELL_ROWS)))
    chosen = vectors.orderBy(F.xxhash64("v", "vec_id")).limit(pivots).select("v").collect()  # pivots: rows with the least hashes
    if not chosen:
        return None
    p = np.unique(np.array([r["v"] + [0] * (width - len(r["v"])) for r in chosen], "f8").reshape(len(chosen), width), axis=0)

    def dealt(batches):
        without_words()
        rows = max(1, STEP_BYTES // (16 * max(1, *p.shape)))
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                x = matrix(part.column("v"), width)
                cell = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(cell.astype("i4")), pa.array(np.sqrt(((x - p[cell]) ** 2).sum(1)))], ["vec_id", "v", "cell", "r"])

    schema = "vec_id long, v array<long>, cell int, r double"
    # u numbers the rows, so that repeated ids are dealt out as well; it is written, and so the same for whoever reads it
    s = materialised(vectors.mapInArrow(dealt, schema).withColumn("u", F.xxhash64(F.monotonically_increasing_id())), "voronoi-vectors")
    r = materialised(queries.mapInArrow(dealt, schema), "voronoi-queries")
    n, far, asks = (np.zeros(len(p)) for _ in range(3))
    for c, count, most in s.groupBy("cell").agg(F.count("*"), F.max("r")).collect():  # a row per pivot
        n[c], far[c] = count, most
    for c, count in r.groupBy("cell").count().collect():
        asks[c] = count
    if not asks.any():
        return None

    # groups: neighbouring cells with few queries together, a cell with many in parts
    around = ((p - p[int(asks.argmax())]) ** 2).sum(1)
    place, groups, filled = {}, 0, block_rows + 1
    for c in sorted(np.flatnonzero(asks).tolist(), key=lambda c: (around[c], c)):
        parts = max(1, -(-int(asks[c]) // block_rows))
        if parts > 1 or filled + asks[c] > block_rows:
            place[c], groups = (groups, parts), groups + parts
            filled = block_rows + 1 if parts > 1 else asks[c]
        else:
            place[c], filled = (groups - 1, 1), filled + asks[c]
    near = np.bincount([g for g, _ in place.values()], weights=[n[c] for c in place], minlength=groups)
    of_cell = spark.createDataFrame([(c, g, parts, max(1, -(-int(near[g]) // (4 * block_rows)))) for c, (g, parts) in place.items()], "cell int, g0 int, parts int, share int")  # a row per pivot at most
    grouped = r.join(F.broadcast(of_cell), "cell").select((F.col("g0") + F.pmod(F.xxhash64("vec_id"), "parts")).cast("int").alias("g"), "vec_id", "v")
    home = s.join(F.broadcast(of_cell), "cell").filter(F.pmod("u", "share") == 0).select(F.explode(F.sequence("g0", F.col("g0") + F.col("parts") - 1)).alias("g"), "vec_id", "v")
    salts = np.maximum(1, -(-n // (8 * block_rows))).astype("i8")  # parts of a cell, so that none is joined in one task
    slack = 1e-6 * (1 + float(np.abs(p).max()))

    def bounds(left: pa.Table, right: pa.Table) -> pa.Table:
        without_words()
        least, g = np.full(len(p), np.inf), left.column("g")[0].as_py() if left.num_rows else -1
        for a in range(0, left.num_rows, 256):
            some = left.slice(a, 256)
            q = matrix(some.column("v"), width)
            score = np.full(len(q), -np.inf)
            if right.num_rows >= k:
                score = best(q, some.column("vec_id").to_numpy(), matrix(right.column("v"), width), right.column("vec_id").to_numpy(), k)[1][:, -1]
            length = np.sqrt((q * q).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                need = (score[:, None] - q @ p.T) / length[:, None] - slack
            least = np.minimum(least, np.where((length == 0)[:, None], -np.inf, need).min(0))
        needed = np.flatnonzero((n > 0) & (far >= least))
        blocks = max(1, -(-int(n[needed].sum()) // block_rows))
        rows = np.repeat(needed, salts[needed])
        salt = np.concatenate([np.arange(x) for x in salts[needed]] + [np.zeros(0, "i8")])
        return pa.table([pa.array(np.full(len(rows), g, "i4")), pa.array(rows.astype("i4")), pa.array(salt.astype("i4")), pa.array(np.maximum(least[rows], 0)), pa.array(np.full(len(rows), blocks, "i4"))], ["g", "cell", "salt", "least", "blocks"])

    needs = materialised(grouped.groupBy("g").cogroup(home.groupBy("g")).applyInArrow(bounds, "g int, cell int, salt int, least double, blocks int"), "voronoi-needs").filter("g >= 0")
    salted = s.join(F.broadcast(spark.createDataFrame([(c, int(x)) for c, x in enumerate(salts)], "cell int, salts int")), "cell").withColumn("salt", F.pmod(F.xxhash64("u"), "salts").cast("int"))
    sent = salted.join(F.broadcast(needs) if needs.count() <= MOST_NEEDS else needs, ["cell", "salt"]).filter("r >= least").select("g", F.pmod("u", "blocks").alias("b"), "vec_id", "v")
    blocks = needs.groupBy("g").agg(F.max("blocks").alias("blocks"))
    asked = grouped.join(blocks, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("b"), "vec_id", "v")
    return asked, sent


def top_k(vectors: DataFrame, queries: DataFrame, k: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best vectors by inner product, all if fewer, never a row with its own id; ties go to the
    smaller vec_id. vectors and queries: vec_id, v (array of integers). Of vectors of different lengths the common part counts, as if the shorter one went on
    with zeros; an empty one scores 0 with all. Components whose scores might pass 2^53 raise a ValueError. Repeated rows count each for itself (a query that
    is repeated is answered once). Empty tables give an empty result; other columns are ignored. Queries are taken to be among the vectors or of their size."""
    found = candidates(vectors.select("vec_id", "v"), queries.select("vec_id", "v").dropDuplicates(["vec_id"]), k, pivots, block_rows)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, sent = found

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        without_words()
        rows = []
        if left.num_rows and right.num_rows:
            q_ids, s_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            order = np.argsort(s_ids, kind="stable")
            width = max(1, *(pa.compute.max(pa.compute.list_value_length(t.column("v"))).as_py() for t in (left, right)))
            s_ids, data = s_ids[order], matrix(right.column("v"), width)[order]
            q = matrix(left.column("v"), width)
            for a in range(0, len(q_ids), 256):
                at, score = best(q[a : a + 256], q_ids[a : a + 256], data, s_ids, k)  # equal scores stay in the order of ids
                ok = np.isfinite(score)
                rows.append((np.repeat(q_ids[a : a + 256], at.shape[1])[ok.ravel()], s_ids[at][ok], score[ok]))
        parts = [np.concatenate([x[i] for x in rows]) if rows else np.zeros(0) for i in range(3)]
        return pa.table([pa.array(x.astype("i8")) for x in parts], ["query_id", "vec_id", "score"])

    pairs = asked.groupBy("g", "b").cogroup(sent.groupBy("g", "b")).applyInArrow(compare, "query_id long, vec_id long, score long")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", first).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k() of `embeddings`, 20 for each row whose id is divisible by 20, against all rows. Rows with a null id, or with a null, non-finite or no
    vector take no part; of unequal lengths the common part counts; repeated rows are found each for itself; an empty table gives an empty one; other columns
    are left out. Raises where components are so large (from some 2^17 on for 64 of them, after the factor 64) that a score might not be exact."""
    vectors = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda t: t[1] * t[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
