"""Constraint checks, nutrition totals, recipe ranking, list states and merges, each over all households at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.functions.exact import BESIDE, number, total


def check_recipes(recipe_ingredients: DataFrame, ingredients: DataFrame, exclusions: DataFrame, eaters: DataFrame) -> DataFrame:
    """recipe, group, status (ok, violated, unknown), reasons, of every recipe and group of a household.

    recipe_ingredients: recipe, ingredient; ingredients: ingredient, name, tags, allergens_known; exclusions: term, member (null: everyone); eaters: group,
    member. A match on key or tag violates, whatever the case; with an exclusion in force an ingredient without known allergens can't pass; without one
    everything is ok. With a column household in the first, third and fourth table, households are apart; without it, all rows are of one."""
    tables = [recipe_ingredients, exclusions, eaters]
    given = all("household" in t.columns for t in tables)
    recipe_ingredients, exclusions, eaters = [t if given else t.withColumn("household", F.lit("")) for t in tables]
    said = exclusions.select("household", F.lower("term").alias("term"), F.col("term").alias("shown"), "member")
    groups = eaters.select("household", "group").distinct()
    everyone = groups.join(said.filter("member is null"), "household").select("household", "group", "term", "shown")
    applied = everyone.unionByName(eaters.join(said.filter("member is not null"), ["household", "member"]).select("household", "group", "term", "shown")).distinct()
    known = recipe_ingredients.join(ingredients, "ingredient", "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    terms = known.select("household", "recipe", F.coalesce("name", "ingredient").alias("name"), F.explode(F.array_distinct(F.transform(F.concat(F.array("ingredient"), tags), F.lower))).alias("term"))
    hits = terms.join(applied, ["household", "term"]).groupBy("household", "recipe", "group").agg(F.array_sort(F.collect_set(F.concat(F.col("name"), F.lit(" matches excluded "), F.col("shown")))).alias("hits"))
    gaps = F.array_sort(F.collect_set(F.when(~F.coalesce("allergens_known", F.lit(False)), F.coalesce("name", "ingredient"))))
    recipes = known.groupBy("household", "recipe").agg(gaps.alias("gaps"))
    bound = applied.select("household", "group").distinct().withColumn("bound", F.lit(True))
    rows = recipes.join(groups, "household").join(hits, ["household", "recipe", "group"], "left").join(bound, ["household", "group"], "left")
    status = F.when(F.col("bound").isNull(), "ok").when(F.col("hits").isNotNull(), "violated").when(F.size("gaps") > 0, "unknown").otherwise("ok")
    nothing = F.array().cast("array<string>")
    out = rows.select("household", "recipe", "group", status.alias("status"), F.when(status == "violated", F.col("hits")).when(status == "unknown", F.col("gaps")).otherwise(nothing).alias("reasons"))
    return out if given else out.drop("household")


NUTRIENTS = ("calories", "protein_g", "carbs_g", "fat_g")


def plate_nutrition(amounts: DataFrame, facts: DataFrame) -> DataFrame:
    """Per plate and nutrient: value (null if a part is unknown), known (the sum of the rest), missing (ingredients).

    amounts: plate, ingredient, q (exact, in the facts' basis unit; null if not convertible); facts: ingredient, basis_qty and the nutrients, as text."""
    rows = amounts.join(facts, "ingredient", "left")
    # q * per / basis as whole numbers of 28 digits at most; texts that are longer are kept until the end
    rows = rows.withColumns({"_q": number(F.col("q"), 10, 8), "_b": number(F.col("basis_qty"), 10, 8), **{f"_{x}": number(F.col(x), 10, 8) for x in NUTRIENTS}})
    rows = rows.withColumn("_b", F.when(F.col("_b.n") > 0, F.col("_b")))
    known = lambda x: F.col("q").isNotNull() & F.col("basis_qty").isNotNull() & F.col(x).isNotNull()
    n = lambda x: (F.col("_q.n") * F.col(f"_{x}.n") * F.col("_b.d")).cast("decimal(28,0)")
    d = lambda x: (F.col("_q.d") * F.col(f"_{x}.d") * F.col("_b.n")).cast("decimal(38,0)")
    each = rows.select("plate", "ingredient", *[c for x in NUTRIENTS for c in (n(x).alias(f"n_{x}"), d(x).alias(f"d_{x}"), F.when(known(x) & n(x).isNull(), F.concat_ws(BESIDE, "q", x, "basis_qty")).alias(f"t_{x}"), F.when(~known(x), F.col("ingredient")).alias(f"m_{x}"))])
    # all nutrients in one pass: sums for each plate and set of denominators, then a plate's few sets together
    sums = each.groupBy("plate", *[f"d_{x}" for x in NUTRIENTS]).agg(*[c for x in NUTRIENTS for c in (F.sum(f"n_{x}").alias(f"n_{x}"), F.collect_list(f"t_{x}").alias(f"t_{x}"), F.collect_set(f"m_{x}").alias(f"m_{x}"))])
    fraction = lambda x: F.when(F.col(f"n_{x}").isNotNull(), F.array(F.concat_ws("/", F.col(f"n_{x}").cast("string"), F.col(f"d_{x}").cast("string")))).otherwise(F.array().cast("array<string>"))
    texts = lambda x: F.flatten(F.collect_list(F.concat(fraction(x), f"t_{x}")))
    plates = sums.groupBy("plate").agg(*[F.struct(F.lit(x).alias("nutrient"), texts(x).alias("texts"), F.min(f"n_{x}").alias("n"), F.min(f"d_{x}").alias("d"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"m_{x}")))).alias("missing")).alias(x) for x in NUTRIENTS])
    out = plates.select("plate", F.inline(F.array(*NUTRIENTS))).withColumn("known", total(F.col("texts"), F.col("n"), F.col("d")))
    return out.select("plate", "nutrient", F.when(F.size("missing") == 0, F.col("known")).alias("value"), "known", "missing")


def score(interested: Column, liked: Column, recent: Column, new: Column, avoided: Column, variety: Column) -> Column:
    """A recipe's score in tenths; liked: the sum of 20 for each "make again" and 5 for each "occasionally"."""
    novelty = F.when(new & (variety == "familiar"), -15).when(new & (variety == "adventurous"), 15).otherwise(0)
    return F.when(interested, 30).otherwise(0) + liked - F.when(recent, 40).otherwise(0) + novelty - F.when(avoided, 100).otherwise(0)


def recipe_scores(recipes: DataFrame, preferences: DataFrame, variety: Column) -> DataFrame:
    """recipes (household, recipe, title, interested, recent, cooked, avoided) with score in tenths and rank per household: interest +30, "make again" +20,
    "occasionally" +5, recently planned -40, new and familiar wanted -15, new and adventure wanted +15, avoided -100; ties by title, then id."""
    liked = preferences.groupBy("household", "recipe").agg(F.sum(F.when(F.col("value") == "make_again", 20).when(F.col("value") == "occasionally", 5).otherwise(0)).alias("liked"), F.bool_or(F.col("value") == "not_for_me").alias("refused"))
    rows = recipes.join(liked, ["household", "recipe"], "left").filter(~F.coalesce("refused", F.lit(False)))
    value = score(F.col("interested"), F.coalesce("liked", F.lit(0)), F.col("recent"), ~F.col("cooked"), F.col("avoided"), variety)
    return rows.withColumn("score", value).withColumn("rank", F.row_number().over(Window.partitionBy("household").orderBy(F.desc("score"), "title", "recipe"))).select("household", "recipe", "score", "rank")


def list_state(lines: DataFrame) -> DataFrame:
    """Adds the state of a shopping list's line: later rules override earlier ones."""
    enough = ((F.col("availability") == "enough") & ~F.col("requested")) | F.coalesce(F.col("net").eqNullSafe(F.lit("0")) & F.col("meal").isNotNull(), F.lit(False))
    state = F.when(F.col("sent") > 0, "sent_to_cart").when(F.col("ordered") > 0, "already_ordered").when(F.col("conflict").isNotNull() | F.col("to_send").isNull(), "unknown_amount").when(F.coalesce(enough, F.lit(False)), "have_enough").otherwise("to_buy")
    return lines.withColumn("state", F.when(F.col("ordered") > 0, "already_ordered").otherwise(state))


def omission(lines: DataFrame, store: Column) -> DataFrame:
    """Adds why a line is left out of a partial handoff, null if it goes: the first reason that holds."""
    reason = F.when(F.col("product").isNull(), "no product").when(F.col("retailer") != store, "other store").when(F.col("to_send").isNull(), "amount unknown").when(F.size("issues") > 0, "unresolved").when(F.col("price_minor").isNull(), "price unknown").when(~F.col("approved"), "not approved")
    return lines.withColumn("omitted", reason)


def three_way(base: DataFrame, current: DataFrame, draft: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the merged value and its outcome (same, theirs, mine, both, conflict) of three versions (keys, value); a null is a value."""
    rows = base.withColumnRenamed("value", "b").join(current.withColumnRenamed("value", "c"), keys, "full").join(draft.withColumnRenamed("value", "d"), keys, "full")
    theirs, mine, alike = ~F.col("c").eqNullSafe(F.col("b")), ~F.col("d").eqNullSafe(F.col("b")), F.col("c").eqNullSafe(F.col("d"))
    outcome = F.when(~theirs & ~mine, "same").when(~mine, "theirs").when(~theirs, "mine").when(alike, "both").otherwise("conflict")
    return rows.select(*keys, F.when(outcome != "conflict", F.when(mine, F.col("d")).otherwise(F.col("c"))).alias("value"), outcome.alias("outcome"))


def headed(lines: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Ingredient lines with the component they stand under: the last heading above (a line that ends with a colon), `main` before any. Headings go; one
    without lines vanishes."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("text").rlike(r":\s*$"), F.regexp_replace(F.trim("text"), r"\s*:$", ""))
    return lines.withColumns({"_h": heading, "component": F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("main"))}).filter("_h is null").drop("_h")


