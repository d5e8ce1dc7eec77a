"""Rows that append-only tables make current: latest per key, uncorrected rows, ends of supersession chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.sources.shared import written


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in `order` (say desc_nulls_last for "newest"); give a tie-break, or equal rows are chosen freely."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """At most n rows per key, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def effective(df: DataFrame, id_col: str, corrections: DataFrame, corrects_col: str) -> DataFrame:
    """Rows that no correction names."""
    named = corrections.filter(F.col(corrects_col).isNotNull()).select(F.col(corrects_col).alias(id_col)).distinct()
    return df.join(named, id_col, "left_anti")


def changed(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Key union of two states: keys whose value differs, null-safe, with both values."""
    b = before.select(*keys, F.col(value).alias("before"))
    a = after.select(*keys, F.col(value).alias("after"))
    return b.join(a, keys, "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows with how many more copies the left side has (`removed`) or the right one (`added`)."""
    count = lambda d, name: d.groupBy(*columns).agg(F.count("*").alias(name))
    both = count(left.select(*columns).withColumn("_side", F.lit(1)), "l").alias("l")
    other = count(right.select(*columns).withColumn("_side", F.lit(1)), "r").alias("r")
    joined = both.join(other, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns], "full")
    n = F.coalesce("l", F.lit(0)) - F.coalesce("r", F.lit(0))
    return joined.select(*[F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in columns], F.greatest(n, F.lit(0)).alias("removed"), F.greatest(-n, F.lit(0)).alias("added")).filter("removed > 0 or added > 0")


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with place, a row's rank from 1 in a total `order` over all rows. Ranges of rows are sorted apart and written with their places; only the ranges' counts
    meet in one task."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranges = written(spread, "placed")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return ranges.join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")
