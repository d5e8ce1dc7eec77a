"""Chains of records: each names the one that it follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.sources.shared import written


def chains(links: DataFrame) -> DataFrame:
    """id, root and generation (1 for the root) of links (id, previous): previous is null for the first of a chain.

    Every record looks twice as far back in each round, so a chain of n takes log2(n) rounds, each an equi-join and a written table. A record whose
    chain has no beginning, since a previous one is missing or it is its own ancestor, is left out."""
    first = F.col("previous").isNull()
    now = written(links.select("id", F.when(first, F.col("id")).alias("root"), F.col("previous").alias("up"), F.when(first, 0).otherwise(1).cast("long").alias("steps")), "chains")
    far, n = 1, now.count()
    while far <= n and now.filter("up is not null").limit(1).count():
        above = now.select(F.col("id").alias("up"), F.col("root").alias("top"), F.col("up").alias("further"), F.col("steps").alias("more"))
        looked = now.filter("up is not null").join(above, "up").select("id", F.col("top").alias("root"), F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        now, far = written(now.filter("up is null").unionByName(looked), "chains"), far * 2
    return now.filter("up is null").select("id", "root", (F.col("steps") + 1).alias("generation"))
