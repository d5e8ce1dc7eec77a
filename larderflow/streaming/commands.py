"""Write commands as one keyed fold: replays, reused operation ids, expected revisions; as a stream and over a finished log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

OUTCOME = "household long, seq long, entity string, outcome string, code string, revision int"


def first_of_operation(commands: DataFrame) -> DataFrame:
    """commands (household, seq, operation, actor, request, entity, expected) with `again`: null for an operation's first command, else replayed (the same request of
    the same actor) or operation_id_reused."""
    w = Window.partitionBy("household", "operation").orderBy("seq")
    same = F.col("actor").eqNullSafe(F.first("actor").over(w)) & F.col("request").eqNullSafe(F.first("request").over(w)) & F.col("entity").eqNullSafe(F.first("entity").over(w))
    return commands.withColumn("again", F.when(F.row_number().over(w) > 1, F.when(same, "replayed").otherwise("operation_id_reused")))


def outcome(again, expected, revision: int) -> tuple[str, str | None, int]:
    """(outcome, code, revision after) of one command on an entity at `revision`."""
    if again == "replayed":
        return "replayed", None, revision
    if again is not None:
        return "rejected", again, revision
    if pd.isna(expected) or expected != revision:
        return "rejected", "stale_revision", revision
    return "accepted", None, revision + 1


def decided(commands: DataFrame) -> DataFrame:
    """OUTCOME of every command of a finished log: accepted ones raise their entity's revision by one, rejected ones say why and change nothing.

    Entities are dealt out and sorted; a task folds them one after another and holds one revision, however long an entity's history is."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, revision = None, 0
        for pdf in batches:
            rows = []
            for h, s, e, again, expected in zip(pdf["household"], pdf["seq"], pdf["entity"], pdf["again"], pdf["expected"], strict=True):
                if (h, e) != now:
                    now, revision = (h, e), 0
                told, code, revision = outcome(again, expected, revision)
                rows.append((h, s, e, told, code, revision))
            yield pd.DataFrame(rows, columns=["household", "seq", "entity", "outcome", "code", "revision"])

    marked = first_of_operation(commands).select("household", "seq", "entity", "again", "expected")
    return marked.repartition("household", "entity").sortWithinPartitions("household", "entity", "seq").mapInPandas(fold, OUTCOME)


class Reducer(StatefulProcessor):
    """A household's commands in the order of seq: what each operation id asked first, and the revision of each entity."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getListState("first", "operation string, actor string, request string, entity string")
        self.revisions = handle.getListState("revisions", "entity string, revision int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # state is read and written once for a household and batch, not for each command; what operations asked first is only added to
        pdf = pd.concat(list(rows)).sort_values("seq")
        first = {r[0]: tuple(r[1:]) for r in self.first.get()}
        revisions = {r[0]: r[1] for r in self.revisions.get()}
        added, before_batch, out = [], dict(revisions), []
        for r in pdf.itertuples(index=False):
            asked, before = (str(r.actor), r.request, r.entity), None
            if r.operation in first:
                before = "replayed" if first[r.operation] == asked else "operation_id_reused"
            else:
                first[r.operation] = asked
                added.append((r.operation, *asked))
            told, code, now = outcome(before, r.expected, revisions.get(r.entity, 0))
            if now:
                revisions[r.entity] = now
            out.append((key[0], r.seq, r.entity, told, code, now))
        if added:
            self.first.appendList(added)
        if revisions != before_batch:
            self.revisions.put(list(revisions.items()))
        yield pd.DataFrame(out, columns=["household", "seq", "entity", "outcome", "code", "revision"])

    def close(self) -> None:
        pass


def decided_stream(commands: DataFrame) -> DataFrame:
    """decided() of a stream whose batches come in the order of seq."""
    return commands.groupBy("household").transformWithStateInPandas(Reducer(), outputStructType=OUTCOME, outputMode="append", timeMode="none")
