"""Change and status logs followed as streams: feeds, idempotent commands, latest status, timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from larderflow.sources.shared import shared_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds after which a started dispatch without an outcome is uncertain.
RECOVERY_SECONDS = 150
TERMINAL = ("acknowledged", "failed", "canceled", "uncertain")


def feed(spark: SparkSession, path: str, schema, files_per_trigger: int = 50) -> DataFrame:
    """A folder of log files as a stream; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append", stateful: bool = False, seconds: int | None = None) -> DataFrame:
    """All rows that are there now, through the stream, as a table under the shared folder. In complete mode the last state wins. A stream with timers
    never ends by itself: give the seconds after which it is stopped."""
    spark = stream.sparkSession
    out, cursor = shared_path(spark, name), shared_path(spark, f"{name}-cursor")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    if stateful:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")  # the same epoch again: the same files

    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", cursor).foreachBatch(put)
        if seconds is None:
            writer.trigger(availableNow=True).start().awaitTermination()
        else:
            run = writer.trigger(processingTime="1 second").start()
            run.awaitTermination(seconds)
            run.stop()
    finally:
        if stateful and before is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        elif stateful:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(stream.schema).parquet(out)


def latest_status(log: DataFrame, key: str, *order: str) -> DataFrame:
    """Of a batch or stream: the last row of each key in the order of the columns, which come first in the answer's struct."""
    return log.groupBy(key).agg(F.max(F.struct(*order)).alias("last")).select(key, "last.*")


class Idempotent(StatefulProcessor):
    """The first command of an operation id runs; the same request again is replayed, another one under the id refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "request string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        held = self.first.get()[0] if self.first.exists() else None
        outcomes = []
        for request in pdf["request"]:
            if held is None:
                held = request
                outcomes.append("accepted")
            else:
                outcomes.append("replayed" if request == held else "conflict")
        self.first.update((held,))
        yield pd.DataFrame({"seq": pdf["seq"], "outcome": outcomes})

    def close(self) -> None:
        pass


def commands_stream(commands: DataFrame) -> DataFrame:
    """seq and outcome of streamed commands (operation, seq, request)."""
    return commands.groupBy("operation").transformWithStateInPandas(Idempotent(), outputStructType="seq long, outcome string", outputMode="append", timeMode="none")


def commands_batch(commands: DataFrame) -> DataFrame:
    """commands_stream over a finished log."""
    w = Window.partitionBy("operation").orderBy("seq")
    first = F.first("request").over(w)
    return commands.select("seq", F.when(F.row_number().over(w) == 1, "accepted").when(F.col("request") == first, "replayed").otherwise("conflict").alias("outcome"))


class Dispatch(StatefulProcessor):
    """Status per batch: a late outcome after a terminal one is noted and never overwrites; a dispatch that stays started turns uncertain."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("id")
        now = self.status.get()[0] if self.status.exists() else None
        out = []
        for status in pdf["status"]:
            late = now in TERMINAL
            if not late:
                now = status
                if status == "dispatch_started":
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + RECOVERY_SECONDS * 1000)
            out.append((key[0], status, now, late))
        self.status.update((now,))
        yield pd.DataFrame(out, columns=["batch", "reported", "status", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.status.exists() and self.status.get()[0] == "dispatch_started":
            self.status.update(("uncertain",))
            yield pd.DataFrame([(key[0], None, "uncertain", False)], columns=["batch", "reported", "status", "late"])

    def close(self) -> None:
        pass


def dispatch_stream(log: DataFrame) -> DataFrame:
    """Streamed status log (batch, id, status)."""
    return log.groupBy("batch").transformWithStateInPandas(Dispatch(), outputStructType="batch string, reported string, status string, late boolean", outputMode="append", timeMode="processingtime")


def overdue(log: DataFrame, now) -> DataFrame:
    """Of a finished log (batch, id, status, at): batches whose last status is a dispatch started more than RECOVERY_SECONDS before now."""
    last = log.groupBy("batch").agg(F.max(F.struct("id", "status", "at")).alias("l")).select("batch", "l.*")
    return last.filter((F.col("status") == "dispatch_started") & (F.col("at") < now - F.expr(f"INTERVAL '{RECOVERY_SECONDS}' SECOND"))).select("batch", "at")
