"""Which nights of a plan have their dinner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.operators.latest import latest_by


def running_shortage(nights: DataFrame, keys: list[str], night: str, plates: str, supply: Column) -> DataFrame:
    """Adds used (plates up to and with this night) and short (more than the supply): from the first short night on, all later ones are short."""
    total = F.sum(plates).over(Window.partitionBy(*keys).orderBy(night).rowsBetween(Window.unboundedPreceding, 0))
    return nights.withColumn("used", total).withColumn("short", F.col("used") > supply)


def coverage(assignments: DataFrame, events: DataFrame, plates: DataFrame, observations: DataFrame) -> DataFrame:
    """Status and reason of every assignment's night.

    assignments: week, night, kind (cook, leftover, out, open), event; events: event, status, cook_night; plates: event, night (one row per dinner plate);
    observations: event, portions_remaining (whole number), observed_night, observed_at. Leftover plates on nights after the cooking and not before the
    latest observation draw on what it found; without one nothing is short."""
    per_night = plates.groupBy("event", "night").agg(F.count("*").alias("plates"))
    seen = latest_by(observations, ["event"], F.desc_nulls_last("observed_at"), F.asc("portions_remaining")).select("event", "portions_remaining", "observed_night")
    drawn = per_night.join(seen, "event").join(events.select("event", "cook_night"), "event").filter("night > cook_night and night >= observed_night")
    short = running_shortage(drawn, ["event"], "night", "plates", F.col("portions_remaining")).select("event", "night", "short")
    rows = assignments.join(events, "event", "left").join(per_night, ["event", "night"], "left").join(short, ["event", "night"], "left")
    reason = (
        F.when(F.col("kind") == "out", F.lit(None).cast("string"))
        .when(F.col("kind") == "open", "nothing planned")
        .when(~F.col("status").eqNullSafe(F.lit("scheduled")), "not scheduled")
        .when((F.col("kind") == "leftover") & ~F.coalesce(F.col("night") > F.col("cook_night"), F.lit(False)), "leftover before its cooking")
        .when(F.col("plates").isNull(), "no dinner plates")
        .when(F.coalesce("short", F.lit(False)), "leftovers run short")
    )
    state = F.when(F.col("kind") == "out", "out").when(F.col("kind") == "open", "uncovered").when(F.col("reason").isNotNull(), "unresolved").otherwise("covered")
    return rows.withColumn("reason", reason).select("week", "night", "kind", "event", state.alias("state"), "reason")


def weeks_complete(nights: DataFrame) -> DataFrame:
    """week, complete: seven different nights, each covered or out."""
    return nights.groupBy("week").agg(((F.countDistinct("night") == 7) & F.bool_and(F.col("state").isin("covered", "out"))).alias("complete"))
