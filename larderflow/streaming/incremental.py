"""A projection kept up to date by a stream of changes: each batch writes the affected partitions anew, and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from larderflow.sources.shared import shared_path


def kept_up(changes: DataFrame, history: Callable[[], DataFrame], project: Callable[[DataFrame], DataFrame], partition: str, path: str | None = None) -> str:
    """Follows changes (a stream) until it has what is there now, and returns the projection's folder, one partition for each value of `partition`.

    For each batch: the distinct partitions that it touches, the history of these alone (a semi-join), projected and written over just these partitions. A
    batch that comes again after a failure writes the same partitions from the same history, so repeating it is safe; others keep their files."""
    spark = changes.sparkSession
    out, cursor = path or shared_path(spark, "projection"), shared_path(spark, "projection-cursor")

    def put(batch: DataFrame, epoch: int) -> None:
        touched = batch.select(partition).distinct()
        projected = project(history().join(touched, partition, "left_semi"))
        projected.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(out)

    changes.writeStream.foreachBatch(put).option("checkpointLocation", cursor).trigger(availableNow=True).start().awaitTermination()
    return out
