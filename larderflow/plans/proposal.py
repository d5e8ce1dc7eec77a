"""Weekly proposals for all households at once: which dishes are chosen, and what each of the seven nights gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NIGHTS = 7
#: What a household that has not said otherwise cooks in a week.
SESSIONS = 4


def queues(recipes: DataFrame, wanted: DataFrame, novelty: dict[str, int]) -> DataFrame:
    """wanted with one column for each name of novelty: an array of (place, recipe, friendly, title) of the recipes that are cooked, in the order of the queue.

    recipes: household, recipe, title, score, is_new, friendly, all of them eligible; wanted: household, cooks (how many, a week's at most), rests (nights that
    leftovers should fill), max_new (null: any); novelty: what is added to a new recipe's score. The best `rests` leftover-friendly ones come first, then all by
    rank; beyond max_new, new ones are passed over. No more than seven of each kind (new or not, friendly or not) can be chosen, whatever the novelty, which
    moves all of a kind alike: a household with very many recipes is cut to them before any shuffle, once for all names."""
    kind = Window.partitionBy("household", "is_new", "friendly").orderBy(F.desc("score"), F.asc("title"), F.asc("recipe"))
    some = recipes.withColumn("_kind", F.row_number().over(kind)).filter(F.col("_kind") <= NIGHTS)
    some = some.groupBy("household", "is_new", "friendly").agg(F.collect_list(F.struct("_kind", "score", "title", "recipe", "friendly", "is_new")).alias("_some"))
    out = wanted.join(some.groupBy("household").agg(F.flatten(F.collect_list("_some")).alias("_some")), "household", "left")
    # what is not among the first `cooks` of its kind is not chosen; of friendly ones, what is not among the first `rests` does not come first either
    out = _made(out, _most=F.when(F.col("cooks") > 0, F.greatest("cooks", "rests")).otherwise(0))
    out = _made(out, _some=F.filter("_some", lambda x: (x["_kind"] <= F.col("cooks")) | x["is_new"].isNull() | (x["friendly"] & (x["_kind"] <= F.col("_most"))))).drop("_most")
    back = lambda x, name: F.coalesce(-x["score"].cast("bigint") - F.when(x["is_new"], novelty[name]).otherwise(0), F.lit(2**63 - 1))
    rank = lambda x, name: F.struct(back(x, name).alias("back"), x["title"].alias("title"), x["recipe"].alias("recipe"))
    easy = lambda name: F.sort_array(F.transform(F.filter("_some", lambda x: x["friendly"]), lambda x: rank(x, name)))
    # the last of those that come first; then the queue: all sorted once more with them in front
    out = _made(out, **{f"_easy_{name}": easy(name) for name in novelty})
    out = _made(out, **{f"_last_{name}": F.get(f"_easy_{name}", F.least("rests", F.size(f"_easy_{name}")) - 1) for name in novelty})

    def queue(name: str) -> Column:
        front = lambda x: F.coalesce(x["friendly"] & (rank(x, name) <= F.col(f"_last_{name}")), F.lit(False))
        return F.sort_array(F.transform("_some", lambda x: F.struct((~front(x)).alias("later"), back(x, name).alias("back"), x["title"].alias("title"), x["recipe"].alias("recipe"), x["friendly"].alias("friendly"), x["is_new"].alias("is_new"))))

    of = {f.name: f.dataType.simpleString() for f in recipes.schema}
    nothing = F.array().cast(f"array<struct<place:int,recipe:{of['recipe']},friendly:boolean,title:{of['title']}>>")

    def step(s: Column, x: Column) -> Column:
        # as in SQL, the sum of none known is unknown
        news = F.when(x["is_new"].isNull(), s["news"]).otherwise(F.coalesce(s["news"], F.lit(0)) + x["is_new"].cast("int"))
        allowed = (F.size(s["taken"]) < F.col("cooks")) & (~x["is_new"] | F.col("max_new").isNull() | (news <= F.col("max_new")))
        dish = F.struct((F.size(s["taken"]) + 1).alias("place"), x["recipe"].alias("recipe"), x["friendly"].alias("friendly"), x["title"].alias("title"))
        return F.struct(news.alias("news"), F.when(allowed, F.concat(s["taken"], F.array(dish))).otherwise(s["taken"]).alias("taken"))

    out = _made(out, **{f"_queue_{name}": queue(name) for name in novelty})
    taken = {name: F.coalesce(F.aggregate(f"_queue_{name}", F.struct(F.lit(None).cast("int").alias("news"), nothing.alias("taken")), step, lambda s: s["taken"]), nothing) for name in novelty}
    return _made(out, **taken).select(*wanted.columns, *novelty)


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are evaluated once for a row: generated, so that neither lambdas nor filters on them hold their expressions again."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def chosen(recipes: DataFrame, wanted: DataFrame) -> DataFrame:
    """household and dishes, those that are cooked, in the order of the queue: see queues()."""
    return queues(recipes, wanted, {"dishes": 0}).filter(F.size("dishes") > 0).select("household", "dishes")


def week(dishes: Column, kept: Column, rests: Column) -> Column:
    """The seven nights as an array of (night, kind, recipe, source, kept), by a fold over the nights.

    dishes: the queue; kept: map of night to (kind, recipe); rests: nights for leftovers. After a leftover-friendly cooking comes one night of its leftovers,
    two once nothing else is to be cooked, while there are such nights left; a night without either stays open. A kept night ends what leftovers could follow.
    source: the night of the cooking that the leftovers are of."""
    nothing = F.lit(None)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("last"), F.lit(0).alias("served"), rests.cast("int").alias("rests"), F.lit(-1).alias("since"), F.array().cast("array<struct<night:int,kind:string,recipe:bigint,source:int,kept:boolean>>").alias("nights"))

    def step(s: Column, night: Column) -> Column:
        held = F.try_element_at(kept, night)
        friendly = F.coalesce(F.try_element_at(dishes, F.greatest(s["last"], F.lit(1)))["friendly"], F.lit(False)) & (s["last"] > 0)
        again = held.isNull() & friendly & (s["rests"] > 0) & (s["served"] < F.when(s["used"] >= F.size(dishes), 2).otherwise(1))
        cooks = held.isNull() & ~again & (s["used"] < F.size(dishes))
        row = F.struct(
            night.alias("night"), F.when(held.isNotNull(), held["kind"]).when(again, "leftover").when(cooks, "cook").otherwise("open").alias("kind"),
            F.when(held.isNotNull(), held["recipe"]).when(again, F.try_element_at(dishes, F.greatest(s["last"], F.lit(1)))["recipe"]).when(cooks, F.try_element_at(dishes, s["used"] + 1)["recipe"]).cast("bigint").alias("recipe"),
            F.when(again, s["since"]).otherwise(nothing).cast("int").alias("source"), held.isNotNull().alias("kept"),
        )
        return F.struct(
            F.when(cooks, s["used"] + 1).otherwise(s["used"]).alias("used"), F.when(cooks, s["used"] + 1).when(again, s["last"]).otherwise(0).alias("last"), F.when(again, s["served"] + 1).otherwise(0).alias("served"),
            F.when(again, s["rests"] - 1).otherwise(s["rests"]).alias("rests"), F.when(cooks, night).when(again, s["since"]).otherwise(-1).alias("since"), F.concat(s["nights"], F.array(row)).alias("nights"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(NIGHTS - 1)), start, step, lambda s: s["nights"])


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), i)


def _shape(n: Column, friendly: Column, held: Column) -> Column:
    return (held * (NIGHTS + 1) + n) * (1 << NIGHTS) + friendly


def week_shapes(spark: SparkSession) -> DataFrame:
    """shape and nights of all 4,246 ways that a week can go: (night, kind, dish, source, kept), dish being a place in the queue.

    A week depends on no more than how many dishes there are, which of them are leftover-friendly and which nights are kept."""
    ways = spark.range((NIGHTS + 1) << 2 * NIGHTS, numPartitions=4).select(F.col("id").cast("int").alias("id")).select((F.col("id") % 128).alias("friendly"), (F.floor(F.col("id") / 128).cast("int") % 128).alias("held"), F.floor(F.col("id") / 128 / 128).cast("int").alias("n"))
    ways = ways.filter((F.col("n") + F.bit_count("held") <= NIGHTS) & (F.col("friendly") < _bit(F.col("n"))))
    dishes = F.transform(F.slice(F.sequence(F.lit(1), F.lit(NIGHTS)), 1, F.col("n")), lambda i: F.struct(i.alias("place"), i.cast("bigint").alias("recipe"), (F.col("friendly").bitwiseAND(_bit(i - 1)) != 0).alias("friendly")))
    held = F.filter(F.sequence(F.lit(0), F.lit(NIGHTS - 1)), lambda i: F.col("held").bitwiseAND(_bit(i)) != 0)
    kept = F.map_from_entries(F.transform(held, lambda i: F.struct(i.alias("night"), F.struct(F.lit("").alias("kind"), F.lit(None).cast("bigint").alias("recipe")))))
    nights = week(F.col("dishes"), F.col("kept"), NIGHTS - F.bit_count("held") - F.col("n"))
    rows = _made(_made(ways, dishes=dishes, kept=kept), shape=_shape(F.col("n"), F.col("friendly"), F.col("held")), nights=nights).select("shape", "nights")
    return _made(rows, nights=F.transform("nights", lambda x: F.struct(x["night"].alias("night"), x["kind"].alias("kind"), x["recipe"].cast("int").alias("dish"), x["source"].alias("source"), x["kept"].alias("kept"))))


def planned(households: DataFrame, fresh: DataFrame, kept: DataFrame, novelty: dict[str, int]) -> DataFrame:
    """household, kept (map of night to kind and recipe, if kept has recipes), and for each name of novelty its dishes and its nights (`<name>_nights`, as in
    week_shapes()). fresh: recipes without those of kept nights."""
    said = [F.map_from_entries(F.collect_list(F.struct(F.col("night").cast("int"), F.struct("kind", F.col("recipe").cast("bigint").alias("recipe"))))).alias("kept")] if "recipe" in kept.columns else []
    own = kept.groupBy("household").agg(F.bit_or(_bit(F.col("night").cast("int"))).alias("held"), F.count_if(F.col("kind") == "cook").alias("kept_cooks"), *said)
    open_nights = NIGHTS - F.bit_count("held")
    cooks = F.greatest(F.lit(0), F.least(F.coalesce("sessions", F.lit(SESSIONS)) - F.col("kept_cooks"), open_nights)).cast("int")
    wanted = households.select("household", "sessions", "max_new").join(own, "household", "left").withColumns({"held": F.coalesce("held", F.lit(0)), "kept_cooks": F.coalesce("kept_cooks", F.lit(0))}).withColumn("cooks", cooks)
    out = queues(fresh, wanted.select("household", "held", "cooks", (open_nights - F.col("cooks")).alias("rests"), "max_new", *["kept"] * len(said)), novelty)
    shapes = F.broadcast(week_shapes(households.sparkSession))
    for name in novelty:
        friendly = F.coalesce(F.aggregate(name, F.lit(0), lambda s, x: s + F.when(x["friendly"], _bit(x["place"] - 1)).otherwise(0)), F.lit(0))
        out = out.withColumn("shape", _shape(F.size(name), friendly, F.col("held"))).join(shapes.withColumnRenamed("nights", f"{name}_nights"), "shape").drop("shape")
    return out.select("household", *["kept"] * len(said), *[c for name in novelty for c in (name, f"{name}_nights")])


def proposals(households: DataFrame, recipes: DataFrame, kept: DataFrame) -> DataFrame:
    """household, night (0 to 6), kind (cook, leftover, open, or a kept night's own), recipe, source, kept: seven rows for each household.

    households: household, sessions (null: SESSIONS), max_new (null: any); recipes: as in queues(), eligible ones; kept: household, night, kind, recipe, one row
    for each night. A recipe of a kept night is not proposed again; kept cookings count as sessions. Without enough recipes the rest is open."""
    fresh = recipes.join(kept.filter("recipe is not null").select("household", "recipe").distinct(), ["household", "recipe"], "left_anti")
    return fresh_proposals(households, fresh, kept)


def fresh_proposals(households: DataFrame, fresh: DataFrame, kept: DataFrame) -> DataFrame:
    """proposals() of recipes among which those of kept nights are not."""
    rows = planned(households, fresh, kept, {"dishes": 0}).select("household", F.col("kept").alias("own"), "dishes", F.inline("dishes_nights"))
    own = F.try_element_at("own", F.col("night"))
    recipe = F.get("dishes", F.col("dish") - 1)["recipe"].cast("bigint")
    return rows.select("household", "night", F.when(F.col("kept"), own["kind"]).otherwise(F.col("kind")).alias("kind"), F.when(F.col("kept"), own["recipe"]).otherwise(recipe).alias("recipe"), "source", "kept")


def changes(households: DataFrame, fresh: DataFrame, kept: DataFrame, before: int, after: int) -> DataFrame:
    """household, night, was, now of the nights whose dinner differs between proposals with two values of novelty (see queues()), both made in one pass; a kept
    night is never a change. fresh: recipes without those of kept nights; kept: household, night, kind."""
    rows = planned(households, fresh, kept, {"was": before, "now": after}).filter(F.col("was") != F.col("now"))
    nights = rows.select("household", "was", "now", F.inline(F.arrays_zip(F.col("was_nights").alias("w"), F.col("now_nights").alias("n")))).filter(~F.col("n.kept"))

    def said(dishes: str, x: str) -> Column:
        title = F.coalesce(F.get(dishes, F.col(f"{x}.dish") - 1)["title"], F.lit("?"))
        return F.when(F.col(f"{x}.kind") == "cook", title).when(F.col(f"{x}.kind") == "leftover", F.concat(F.lit("leftovers of "), title)).otherwise(F.col(f"{x}.kind"))

    return nights.select("household", F.col("n.night").alias("night"), said("was", "w").alias("was"), said("now", "n").alias("now")).filter("was <> now")


def admission(content: DataFrame, events: DataFrame, plates: DataFrame, accepted: DataFrame, members: DataFrame, checks: DataFrame) -> DataFrame:
    """household, code, night, subject: every distinct reason why a proposed week cannot be adopted; a household without rows can adopt it.

    content: household, night, kind, event, kept; events: household, event, recipe, cook_night, is_new; plates: household, event, member, meal, night; accepted:
    household, night, kind, event, locked; members: household, member; checks: household, recipe, status. Codes: no_dinner (night missing or open), no_cooking,
    other_night, too_early, no_plate (subject: the member), lunch_too_early, not_served, lock_broken, violated, unknown (subject: the recipe)."""
    row = lambda df, code, night, subject: df.select("household", F.lit(code).alias("code"), F.col(night).cast("int").alias("night") if night else F.lit(None).cast("int").alias("night"), (F.col(subject).cast("bigint") if subject else F.lit(None).cast("bigint")).alias("subject"))
    all_nights = members.select("household").distinct().withColumn("night", F.explode(F.sequence(F.lit(0), F.lit(NIGHTS - 1))))
    chosen_nights = content.filter("kind <> 'open'").select("household", "night")
    out = [row(all_nights.join(chosen_nights, ["household", "night"], "left_anti"), "no_dinner", "night", None)]
    dinners = content.filter("kind in ('cook', 'leftover')").join(events.select("household", "event", "cook_night"), ["household", "event"], "left")
    out.append(row(dinners.filter("cook_night is null"), "no_cooking", "night", None))
    cooked = dinners.filter("cook_night is not null")
    out.append(row(cooked.filter("kind = 'cook' and cook_night <> night"), "other_night", "night", None))
    out.append(row(cooked.filter("kind = 'leftover' and night <= cook_night"), "too_early", "night", None))
    # every member has a plate every night: compared by their number first, and looked for one by one only where it falls short
    dinner_plates = plates.filter("meal = 'dinner'").join(members, ["household", "member"]).select("household", "event", "night", "member").distinct()
    served = dinner_plates.groupBy("household", "event", "night").agg(F.count(F.lit(1)).alias("served"))
    people = members.groupBy("household").agg(F.count(F.lit(1)).alias("people"))
    short = cooked.join(served, ["household", "event", "night"], "left").join(people, "household").filter(F.coalesce("served", F.lit(0)) < F.col("people")).select("household", "event", "night")
    out.append(row(short.join(members, "household").join(dinner_plates, ["household", "event", "night", "member"], "left_anti"), "no_plate", "night", "member"))
    of_cooking = plates.join(events.select("household", "event", "cook_night"), ["household", "event"])
    out.append(row(of_cooking.filter("meal = 'lunch' and not coalesce(night > cook_night, true)"), "lunch_too_early", "night", "member"))
    that_night = content.select("household", "night", F.col("event").alias("served_by"))
    out.append(row(of_cooking.filter("meal = 'dinner'").join(that_night, ["household", "night"], "left").filter("not (served_by <=> event)"), "not_served", "night", "member"))
    now = content.select("household", "night", F.col("kind").alias("_kind"), F.col("event").alias("_event"), F.col("kept").alias("_kept"))
    locks = accepted.filter("locked").join(now, ["household", "night"], "left").filter(~F.coalesce("_kept", F.lit(False)) | ~F.col("_kind").eqNullSafe(F.col("kind")) | ~F.col("_event").eqNullSafe(F.col("event")))
    out.append(row(locks, "lock_broken", "night", None))
    failed = events.filter("is_new").join(checks, ["household", "recipe"]).filter("status <> 'ok'")
    out += [row(failed.filter(F.col("status") == s), s, None, "recipe") for s in ("violated", "unknown")]
    problems = out[0]
    for more in out[1:]:
        problems = problems.unionByName(more)
    return problems.distinct()
