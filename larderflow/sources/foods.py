"""Foods of a nutrition service's JSON, normalised: what is missing, or in a unit that cannot be used, is told apart and never counted as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.functions.amounts import let
from larderflow.functions.readers import decimal_of, form_hint, plain_decimal

# Kinds of foods, nutrient numbers in the order in which they are asked for, units, spellings of gram.
KINDS = ("Foundation", "SR Legacy", "Survey (FNDDS)", "Branded")
NUTRIENTS = {"energy": (("208", "958", "957"), "kcal"), "protein": (("203",), "g"), "fat": (("204",), "g"), "carbs": (("205",), "g")}
GRAMS = ("g", "grm", "gram", "grams")

FOOD = """struct<fdcId: bigint, description: string, dataType: string, brandOwner: string, servingSize: string, servingSizeUnit: string,
foodNutrients: array<struct<nutrient: struct<number: string, unitName: string>, nutrientNumber: string, number: string, unitName: string, amount: string, value: string>>,
foodPortions: array<struct<id: string, amount: string, gramWeight: string, measureUnit: struct<name: string>, modifier: string, portionDescription: string>>>"""


def said(text: Column) -> Column:
    """A text that says something, trimmed; else null."""
    return F.nullif(F.trim(text), F.lit(""))


def foods(bodies: DataFrame) -> DataFrame:
    """bodies (body) with food_id, description, kind, brand, form, basis_known, entries (number, unit, amount) and portions (id, amount, unit, grams), or
    with the reason why a body is none. A branded food whose serving is not stated in grams has no known basis; else amounts are for 100 g."""
    f = F.col("f")
    rows = bodies.withColumn("f", F.from_json("body", FOOD))
    reason = (
        F.when(f.isNull() | ~F.trim("body").startswith("{"), "the food is not a JSON object")
        .when(f["fdcId"].isNull() | (f["fdcId"] <= 0), "fdcId missing or not an integer")
        .when(said(f["description"]).isNull(), "description missing")
        .when(~F.coalesce(f["dataType"].isin(*KINDS), F.lit(False)), "unsupported or missing data type")
    )
    entry = lambda n: F.struct(F.coalesce(said(n["nutrient"]["number"]), said(n["nutrientNumber"]), said(n["number"])).alias("number"), F.lower(F.coalesce(said(n["nutrient"]["unitName"]), said(n["unitName"]))).alias("unit"), decimal_of(F.coalesce(n["amount"], n["value"])).alias("amount"))
    words = lambda t: F.when(~t.rlike(r"^\d+$"), t)

    def portion(p: Column) -> Column:
        measure, modifier = said(p["measureUnit"]["name"]), words(said(p["modifier"]))
        described = said(F.regexp_replace(p["portionDescription"], r"^\s*[\d./]+\s*", ""))
        unit = F.when(F.lower(measure) != "undetermined", F.concat_ws(" ", measure, modifier)).otherwise(F.coalesce(modifier, described))
        return F.struct(F.concat(F.lit("p"), p["id"]).alias("id"), F.coalesce(decimal_of(p["amount"]), F.lit("1")).alias("amount"), F.lower(unit).alias("unit"), decimal_of(p["gramWeight"]).alias("grams"))

    usable = lambda p: (p["grams"].cast("decimal(38,9)") > 0) & (p["amount"].cast("decimal(38,9)") > 0) & p["unit"].isNotNull()
    grams = F.lower(F.trim(f["servingSizeUnit"])).isin(*GRAMS)
    branded, size = f["dataType"] == "Branded", decimal_of(f["servingSize"])
    serving = F.when(branded & grams & (size.cast("decimal(38,9)") > 0), F.array(F.struct(F.lit("serving").alias("id"), F.lit("1").alias("amount"), F.lit("serving").alias("unit"), size.alias("grams"))))
    none = F.array().cast("array<struct<id: string, amount: string, unit: string, grams: string>>")
    return rows.select(
        *bodies.columns, reason.alias("reason"), f["fdcId"].alias("food_id"), said(f["description"]).alias("description"), f["dataType"].alias("kind"), F.when(branded, said(f["brandOwner"])).alias("brand"), form_hint(f["description"]).alias("form"),
        (~(branded & F.coalesce(~grams, F.lit(False)))).alias("basis_known"),
        F.coalesce(F.filter(F.transform(f["foodNutrients"], entry), lambda x: x["number"].isNotNull()), F.array().cast("array<struct<number: string, unit: string, amount: string>>")).alias("entries"),
        F.concat(F.coalesce(F.filter(F.transform(f["foodPortions"], portion), usable), none), F.coalesce(serving, none)).alias("portions"),
    )


def nutrients(normalised: DataFrame) -> DataFrame:
    """A row for each food without a reason and nutrient: amount for 100 g, unit, number, and status: ok, missing or bad_unit. Of several numbers for one
    nutrient the first counts that has an amount; of several entries for one number the first."""

    def first(number: str) -> Column:
        found = F.get(F.filter("entries", lambda x: x["number"] == number), F.lit(0))
        return let(found, lambda x: F.when(x["amount"].isNotNull(), x))

    def picked(name: str) -> Column:
        numbers, expected = NUTRIENTS[name]
        status = lambda x: F.when(x.isNull() | ~F.col("basis_known"), "missing").when(F.coalesce(x["unit"] != expected, F.lit(True)), "bad_unit").otherwise("ok")
        row = lambda x: F.struct(F.lit(name).alias("nutrient"), F.when(status(x) == "ok", x["amount"]).alias("amount"), x["unit"].alias("unit"), x["number"].alias("number"), status(x).alias("status"))
        return let(F.coalesce(*[first(n) for n in numbers]), row)

    kept = ["food_id", "description", "form", "basis_known", "portions"]
    rows = normalised.filter("reason is null").select(*kept, F.explode(F.array(*[picked(n) for n in NUTRIENTS])).alias("picked"))
    return rows.select(*kept, "picked.*")


def effective_facts(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """facts (of nutrients()) for 100 g, or for the portion that chosen (food_id, portion) names: amounts times its weight, exact to 18 places. problem:
    basis_unknown or portion_unknown, and then no amount."""
    rows = facts.join(chosen, "food_id", "left").withColumn("p", F.get(F.filter("portions", lambda x: x["id"] == F.col("portion")), F.lit(0)))
    problem = F.when(~F.col("basis_known"), "basis_unknown").when(F.col("portion").isNotNull() & F.col("p").isNull(), "portion_unknown")
    scaled = plain_decimal((F.col("amount").cast("decimal(18,9)") * F.col("p.grams").cast("decimal(18,6)") / 100).cast("decimal(38,18)"))
    amount = F.when(problem.isNull(), F.when(F.col("p").isNotNull(), scaled).otherwise(F.col("amount")))
    return rows.select("food_id", "nutrient", problem.alias("problem"), F.coalesce("p.amount", F.lit("100")).alias("basis_qty"), F.coalesce("p.unit", F.lit("g")).alias("basis_unit"), amount.alias("amount"))
