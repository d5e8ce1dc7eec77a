"""Closures, ranges, projections and commands by hand."""

import os

import pytest
from pyspark.sql import functions as F

from larderflow.plans import edits, histories, library, proposal
from larderflow.streaming import commands, incremental
from larderflow.streaming.logs import feed


def test_closure_ends_on_cycles_and_takes_as_many_rounds_as_ways_are_long(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "z"), (1, "x", "y")], "scope long, node string, to string")
    seeds = spark.createDataFrame([(1, "a"), (1, "a"), (3, "a")], "scope long, node string")
    assert sorted(map(tuple, edits.closure(seeds, edges).collect())) == [(1, "a"), (1, "b"), (1, "c"), (3, "a")]
    long = spark.range(70).select(F.lit(1).alias("scope"), F.col("id").cast("string").alias("node"), (F.col("id") + 1).cast("string").alias("to"))
    with pytest.raises(ValueError, match="longer"):
        edits.closure(spark.createDataFrame([(1, "0")], "scope int, node string"), long)


def test_ranges_meet_by_bins(spark):
    days = [f"2024-01-{x:02d}" for x in range(1, 31)]
    points = spark.createDataFrame([("a", x) for x in days], "k string, d string").withColumn("d", F.to_date("d"))
    spans = spark.createDataFrame([("a", 1, "2024-01-05", "2024-01-20"), ("a", 2, "2024-01-09", "2024-01-09"), ("b", 3, "2024-01-01", "2024-02-01"), ("a", 4, "2023-12-01", "2024-01-02")], "k string, s int, x string, y string").withColumns({"x": F.to_date("x"), "y": F.to_date("y")})
    out = histories.within(points, spans, ["k"], "d", "x", "y", days=4)
    assert {r["s"]: r["n"] for r in out.groupBy("s").agg(F.count("*").alias("n")).collect()} == {1: 15, 4: 1}
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_basis_stops_at_breaks(spark):
    rows = [(1, None, "2", None), (2, 1, "2", None), (3, 2, "3", None), (4, 3, "3", None), (5, 2, "2", "legacy"), (6, 5, "2", None), (7, 99, "1", None), (8, 9, "1", None), (9, 8, "1", None)]
    got = {r["id"]: (r["basis"], r["origin"]) for r in histories.basis(spark.createDataFrame(rows, "id long, source long, quantity string, stated string")).collect()}
    assert got == {1: ("exact", 1), 2: ("exact", 1), 3: ("exact", 3), 4: ("exact", 3), 5: ("legacy", 5), 6: ("legacy", 5), 7: ("invalid", None), 8: ("invalid", None), 9: ("invalid", None)}


def test_simplest_fraction(spark):
    cases = {"0.3333": "1/3", "0.333333333333": "1/3", "0.6667": "2/3", "0.333": None, "0.1429": "1/7", "1.666666666667": "5/3", "0.12345": None, "2": None, "0.0001": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", histories.simplest_fraction(F.col("s"))).collect()} == cases


def test_untouched_partitions_keep_their_files(spark):
    schema = "bucket long, v long"
    from larderflow.sources.shared import shared_path

    log, out = shared_path(spark, "log"), shared_path(spark, "out")
    project = lambda rows: rows.groupBy("bucket").agg(F.sum("v").alias("v"))
    history = lambda: spark.read.schema(schema).parquet(log)

    def files():
        top = out.removeprefix("file://")
        return {b: sorted(os.listdir(f"{top}/{b}")) for b in os.listdir(top) if b.startswith("bucket=")}

    spark.createDataFrame([(1, 1), (2, 2), (3, 3)], schema).write.parquet(log)
    incremental.kept_up(feed(spark, log, spark.createDataFrame([], schema).schema), history, project, "bucket", out)
    before = files()
    spark.createDataFrame([(2, 40)], schema).write.mode("append").parquet(log)
    incremental.kept_up(feed(spark, log, spark.createDataFrame([], schema).schema).filter("v = 40"), history, project, "bucket", out)
    after = files()
    assert before["bucket=1"] == after["bucket=1"] and before["bucket=3"] == after["bucket=3"] and before["bucket=2"] != after["bucket=2"]
    assert {r["bucket"]: r["v"] for r in spark.read.parquet(out).collect()} == {1: 1, 2: 42, 3: 3}


def test_commands_are_rejected_with_a_code(spark):
    rows = [(1, 1, "o1", "ann", "x", "list", 0), (1, 2, "o1", "ann", "x", "list", 0), (1, 3, "o1", "bo", "x", "list", 0), (1, 4, "o2", "bo", "y", "list", 0), (1, 5, "o3", "bo", "y", "list", 1), (1, 6, "o4", "bo", "y", "plan", None)]
    got = {r["seq"]: (r["outcome"], r["code"], r["revision"]) for r in commands.decided(spark.createDataFrame(rows, "household long, seq long, operation string, actor string, request string, entity string, expected int")).collect()}
    assert got == {1: ("accepted", None, 1), 2: ("replayed", None, 1), 3: ("rejected", "operation_id_reused", 1), 4: ("rejected", "stale_revision", 1), 5: ("accepted", None, 2), 6: ("rejected", "stale_revision", 0)}


def test_a_week_by_hand(spark):
    households = spark.createDataFrame([(1, None, 1), (2, 2, None), (3, 4, None)], "household long, sessions int, max_new int")
    recipes = spark.createDataFrame([(1, 10, "a", 9, False, False), (1, 11, "b", 8, True, True), (1, 12, "c", 7, True, False), (1, 13, "d", 1, False, True), (2, 20, "x", 5, False, True), (2, 21, "y", 4, False, False)], "household long, recipe long, title string, score int, is_new boolean, friendly boolean")
    kept = spark.createDataFrame([(2, 1, "out", None)], "household long, night int, kind string, recipe long")
    got = {}
    for r in proposal.proposals(households, recipes, kept).orderBy("household", "night").collect():
        got.setdefault(r["household"], []).append((r["kind"], r["recipe"]))
    # 1: friendly b and d first, then a; c is one new dish too many, so four sessions become three; two nights of leftovers only once nothing else is to be cooked
    assert got[1] == [("cook", 11), ("leftover", 11), ("cook", 13), ("leftover", 13), ("cook", 10), ("open", None), ("open", None)]
    assert got[2] == [("cook", 20), ("out", None), ("cook", 21)] + [("open", None)] * 4
    assert got[3] == [("open", None)] * 7


def test_components_of_one_name(spark):
    lines = [(1, 1, "flour"), (1, 2, "Sauce:"), (1, 3, "tomato"), (1, 4, "For the SAUCE"), (1, 5, "basil"), (1, 6, "Empty:"), (1, 7, "Main:"), (1, 8, "salt")]
    df = spark.createDataFrame([(*x, False) for x in lines], "r int, i int, text string, has_amount boolean")
    assert [r["component"] for r in library.components(df, ["r"], "i").orderBy("i").collect()] == ["Main", "Sauce", "Sauce 2", "Main 2"]
