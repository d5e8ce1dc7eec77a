"""Scoped edits of a plan, each computed against the plan as it stands: what it touches, what keeps it from being applied, what it leaves.

Kinds of edits (op, household, type and what the type needs): replace and backup (night, recipe), move (night, to_night), place (event, to_night), set_kind
(night, new_kind), plate (event, member, meal, night, remove). All edits of all households are computed together, by equi-joins on the household and a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.sources.shared import written


def closure(seeds: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """Everything that can be reached from seeds (scope, node) along edges (scope, node, to), the seeds with it.

    Semi-naive: a round follows the edges of what the round before has found for the first time, and is written; so there are as many rounds as the longest
    way has edges, whatever the number of rows. Cycles end, since nothing is found twice. Raises beyond `most` rounds."""
    seen = written(seeds.select("scope", "node").distinct(), "closure")
    fresh = seen
    for _ in range(most):
        fresh = written(fresh.join(edges, ["scope", "node"]).select("scope", F.col("to").alias("node")).distinct().join(seen, ["scope", "node"], "left_anti"), "closure")
        if not fresh.limit(1).count():
            return seen
        seen = seen.unionByName(fresh)
    raise ValueError(f"ways are longer than {most}")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def plan_edits(ops: DataFrame, assignments: DataFrame, events: DataFrame, plates: DataFrame) -> dict[str, DataFrame]:
    """closure (op, what, id, revision), blockers (op, code, night), assignments and events (op, id and what they become), plates (op, event, member, meal,
    night after the edit, of the events that it touches; a new event is -op).

    ops: op, household, type, night, to_night, event, recipe, friendly, status (ok, violated, unknown), leftovers (follow, open or null), new_kind, member, meal,
    remove; assignments: household, night, id, kind (cook, leftover, out, open), event, locked, revision; events: household, event, status, cook_night, revision;
    plates: household, event, member, meal, night. members come from `ops` as `people`, an array. An edit whose target is missing is blocked and changes nothing."""
    a = assignments
    target = a.select("household", "night", *(F.col(c).alias(f"t_{c}") for c in ("id", "kind", "event", "locked", "revision")))
    goal = a.select("household", F.col("night").alias("to_night"), *(F.col(c).alias(f"d_{c}") for c in ("id", "kind", "locked", "revision")))
    on_night = F.col("type").isin("replace", "backup", "move", "set_kind", "plate")
    rows = ops.withColumn("night", F.when(on_night, F.col("night"))).join(target, ["household", "night"], "left").join(goal, ["household", "to_night"], "left")
    rows = rows.withColumn("e_id", F.when(F.col("type").isin("place", "plate"), F.col("event")).otherwise(F.col("t_event")))
    cooking = events.select("household", F.col("event").alias("e_id"), F.col("status").alias("e_status"), F.col("cook_night").alias("e_night"), F.col("revision").alias("e_revision"))
    rows = rows.join(cooking, ["household", "e_id"], "left").withColumn("e_id", F.when(F.col("e_status").isNotNull(), F.col("e_id")))
    kind = F.col("type")
    found = (
        F.when(kind.isin("replace", "backup"), F.col("t_id").isNotNull() & F.col("recipe").isNotNull())
        .when(kind == "move", F.col("t_id").isNotNull() & F.col("d_id").isNotNull() & F.col("t_kind").eqNullSafe("cook") & F.col("e_id").isNotNull())
        .when(kind == "place", F.col("e_status").eqNullSafe("deferred") & F.col("d_id").isNotNull())
        .when(kind == "set_kind", F.col("t_id").isNotNull())
        .otherwise(F.col("e_status").eqNullSafe("scheduled") & F.col("e_night").isNotNull())
    )
    swaps = kind.isin("replace", "backup")
    follow = swaps & (kind == "replace") & F.col("friendly") & F.coalesce(F.col("leftovers") == "follow", F.lit(True))
    cooks, eats = F.coalesce(F.col("t_kind") == "cook", F.lit(False)) & F.col("e_id").isNotNull(), F.coalesce(F.col("t_kind") == "leftover", F.lit(False)) & F.col("e_id").isNotNull()
    rows = written(rows.withColumns({"found": found, "follow": F.coalesce(follow, F.lit(False)), "cooks": cooks, "eats": eats}), "edits")
    ok = rows.filter("found")

    # what is touched: nights and cookings of the edit, and, where the cooking itself goes or moves, the nights that eat of it
    nights = ok.select("op", F.explode(F.array(F.when(kind != "place", F.when((kind != "plate") | (F.col("meal") == "dinner"), F.col("t_id"))), F.when(kind.isin("move", "place"), F.col("d_id")))).alias("id")).filter("id is not null")
    seeds = _union([nights.select(F.col("op").alias("scope"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("node")), ok.filter("e_id is not null").select(F.col("op").alias("scope"), F.concat(F.lit("e"), F.col("e_id").cast("string")).alias("node"))])
    whole = ok.filter(F.col("cooks") & kind.isin("replace", "backup", "move", "set_kind"))
    eating = a.filter("kind = 'leftover'").select("household", F.col("event").alias("e_id"), F.col("id").alias("dep"), F.col("night").alias("dep_night"), F.col("locked").alias("dep_locked"), F.col("revision").alias("dep_revision"))
    deps = written(whole.join(eating, ["household", "e_id"]), "dependents")
    edges = deps.select(F.col("op").alias("scope"), F.concat(F.lit("e"), F.col("e_id").cast("string")).alias("node"), F.concat(F.lit("a"), F.col("dep").cast("string")).alias("to"))
    touched = closure(seeds, edges).select(F.col("scope").alias("op"), F.substring("node", 1, 1).alias("what"), F.expr("substring(node, 2)").cast("bigint").alias("id"))
    households = ops.select("op", "household")
    revisions = _union([a.select("household", F.lit("a").alias("what"), "id", "revision"), events.select("household", F.lit("e").alias("what"), F.col("event").alias("id"), "revision")])
    touched = touched.join(households, "op").join(revisions, ["household", "what", "id"]).select("op", "what", "id", "revision")

    def block(df: DataFrame, condition: Column, code: str, night: str) -> DataFrame:
        return df.filter(condition).select("op", F.lit(code).alias("code"), F.col(night).cast("int").alias("night"))

    checked = swaps | (kind == "place") | ((kind == "plate") & ~F.col("remove") & F.col("plate_is_new"))
    mine = plates.select("household", F.col("event").alias("e_id"), "member", "meal", "night").distinct().withColumn("has_plate", F.lit(True))
    ok_plates = ok.join(mine, ["household", "e_id", "member", "meal", "night"], "left").withColumn("plate_is_new", F.col("has_plate").isNull())
    early = deps.filter((kind == "move") & (F.col("dep_night") <= F.col("to_night")))
    blockers = [
        block(rows, ~F.col("found"), "not_found", "night"),
        block(ok, (kind.isin("replace", "backup", "move", "set_kind") | ((kind == "plate") & (F.col("meal") == "dinner"))) & F.col("t_locked"), "locked", "night"),
        block(ok, kind.isin("move", "place") & F.col("d_locked"), "locked", "to_night"),
        block(ok, kind.isin("move", "place") & F.col("d_kind").isin("cook", "leftover"), "destination_occupied", "to_night"),
        block(ok, (kind == "backup") & ~F.col("cooks"), "invalid", "night"),
        block(ok, (kind == "plate") & (F.col("night") < F.col("e_night")), "invalid", "night"),
        block(ok, (kind == "plate") & (F.col("meal") == "dinner") & ~F.col("t_event").eqNullSafe(F.col("e_id")), "invalid", "night"),
        block(ok_plates, checked & (F.col("status") == "violated"), "constraint_violation", "night"),
        block(ok_plates, checked & (F.col("status") == "unknown"), "constraint_unknown", "night"),
        block(deps.filter(kind != "move"), F.col("dep_locked"), "locked_dependent", "dep_night"),
        block(early, F.col("dep_locked"), "locked_dependent", "dep_night"),
    ]

    # nights after the edit
    def night_row(df: DataFrame, id: str, to: Column, event: Column) -> DataFrame:
        return df.select("op", F.col(id).alias("id"), to.alias("kind"), event.cast("bigint").alias("event"))

    nothing, new = F.lit(None), -F.col("op")
    after = [
        night_row(ok.filter(swaps), "t_id", F.lit("cook"), new), night_row(ok.filter(kind == "move"), "t_id", F.lit("open"), nothing), night_row(ok.filter(kind.isin("move", "place")), "d_id", F.lit("cook"), F.col("e_id")),
        night_row(ok.filter(kind == "set_kind"), "t_id", F.col("new_kind"), nothing), night_row(deps.filter(swaps & F.col("follow")), "dep", F.lit("leftover"), new),
        night_row(deps.filter((swaps & ~F.col("follow")) | (kind == "set_kind")), "dep", F.lit("open"), nothing), night_row(early, "dep", F.lit("open"), nothing),
    ]
    # a night that is moved to itself, or to a night of its own leftovers, ends as the cooking's night
    place = F.max_by(F.struct("kind", "event"), F.when(F.col("kind") == "cook", 1).otherwise(0)).alias("x")
    nights_after = _union(after).groupBy("op", "id").agg(place).select("op", "id", "x.kind", "x.event")

    # cookings after the edit
    status = F.when((kind == "backup") & F.col("cooks"), "deferred").when((kind.isin("replace", "set_kind")) & F.col("cooks"), "retired").when(kind == "place", "scheduled").otherwise(F.col("e_status"))
    cook_night = F.when((kind == "backup") & F.col("cooks"), None).when(kind.isin("move", "place"), F.col("to_night")).otherwise(F.col("e_night"))
    events_after = _union([
        ok.filter("e_id is not null").filter(~(swaps & ~F.col("cooks") & ~F.col("eats"))).select("op", F.col("e_id").alias("event"), status.alias("status"), cook_night.cast("int").alias("cook_night"), (F.col("e_revision") + 1).alias("revision")),
        ok.filter(swaps).select("op", new.alias("event"), F.lit("scheduled").alias("status"), F.col("night").cast("int").alias("cook_night"), F.lit(1).cast("bigint").alias("revision")),
    ])

    # plates after the edit, of the cookings that it touches
    held = ok.filter("e_id is not null").join(plates.select("household", F.col("event").alias("e_id"), F.col("member").alias("p_member"), F.col("meal").alias("p_meal"), F.col("night").alias("p_night")), ["household", "e_id"])
    gone_nights = early.select("op", F.col("dep_night").alias("p_night")).distinct().withColumn("gone", F.lit(True))
    held = held.join(gone_nights, ["op", "p_night"], "left")
    own_night = F.col("p_night") == F.col("night")
    moved = (kind == "move") & own_night & (F.col("p_meal") == "dinner")
    drop = (
        (swaps & F.col("cooks") & ~(own_night | F.col("follow"))) | (swaps & F.col("eats") & own_night) | ((kind == "set_kind") & F.col("cooks")) | ((kind == "set_kind") & F.col("eats") & own_night)
        | ((kind == "move") & F.coalesce("gone", F.lit(False)) & ~moved) | ((kind == "move") & (F.col("p_meal") == "lunch") & (F.col("p_night") <= F.col("to_night")))
        | ((kind == "plate") & F.col("remove") & own_night & (F.col("p_meal") == F.col("meal")) & (F.col("p_member") == F.col("member")))
    )
    kept = held.filter(~F.coalesce(drop, F.lit(False))).select("op", F.when(swaps & F.col("cooks"), new).otherwise(F.col("e_id")).alias("event"), F.col("p_member").alias("member"), F.col("p_meal").alias("meal"), F.when(moved, F.col("to_night")).otherwise(F.col("p_night")).cast("int").alias("night"))
    fresh = ok.filter((swaps & ~F.col("cooks")) | (kind == "place")).select("op", F.when(swaps, new).otherwise(F.col("e_id")).alias("event"), F.explode("people").alias("member"), F.lit("dinner").alias("meal"), F.when(swaps, F.col("night")).otherwise(F.col("to_night")).cast("int").alias("night"))
    added = ok.filter((kind == "plate") & ~F.col("remove")).select("op", F.col("e_id").alias("event"), "member", "meal", F.col("night").cast("int").alias("night"))
    plates_after = written(_union([kept, fresh, added]).distinct(), "plates-after")
    timed = plates_after.join(events_after.select("op", "event", "status", F.col("cook_night").alias("_cook")), ["op", "event"]).filter("status = 'scheduled' and _cook is not null")
    blockers.append(block(timed, (F.col("night") < F.col("_cook")) | ((F.col("meal") == "lunch") & (F.col("night") <= F.col("_cook"))), "invalid", "night"))
    return {"closure": touched, "blockers": _union(blockers).distinct(), "assignments": nights_after, "events": events_after, "plates": plates_after}
