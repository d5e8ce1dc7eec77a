"""Ingredient demand in exact quantities.

Recipe lines carry an exact amount per portion as reduced text. Per (keys, base unit, denominator) the JVM sums whole numerators; the few denominators
of a group are joined by one Arrow aggregate."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderflow.functions.exact import BESIDE, number, ratio, total
from larderflow.functions.units import SCALE, base_unit, parts


def with_factors(rows: DataFrame) -> DataFrame:
    """rows (unit) with the base unit in unit's place and factor, its whole parts of 10^-11; other units count as themselves."""
    return rows.withColumns({"factor": F.coalesce(parts(F.col("unit")), F.lit(SCALE)).cast("decimal(20,0)"), "unit": base_unit(F.col("unit"))})


def demand_parts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines: keys, event, quantity (whole number), unit, and factor if with_factors() has read the units already. Sums per key and base unit, in whole
    parts of 10^-11 of it."""
    lines = lines if "factor" in lines.columns else with_factors(lines)
    rows = lines.select(*keys, "event", "unit", (F.col("quantity").cast("decimal(17,0)") * F.col("factor")).alias("parts"))
    return rows.groupBy(*keys, "unit").agg(F.sum(F.col("parts").cast("decimal(28,0)")).alias("parts"), F.countDistinct("event").alias("n_events"))


@F.pandas_udf(T.StringType())
def _joined(n: pd.Series, d: pd.Series) -> str:
    return str(sum((Fraction(int(a), int(b)) for a, b in zip(n, d, strict=True)), Fraction(0)))


def portions(plates: DataFrame) -> DataFrame:
    """Portions per event and component of plates (event, component_portions map<string,string>; decimals or fractions): exact sums.

    Whole numerators are summed for each denominator, before and after the shuffle; only a sum for each denominator of a group reaches Python."""
    rows = plates.select("event", F.explode("component_portions").alias("component", "portion"))
    rows = rows.withColumn("r", ratio(F.col("portion")))
    partial = rows.select("event", "component", F.col("r.n").cast("decimal(38,0)").alias("n"), F.col("r.d").alias("d")).groupBy("event", "component", "d").agg(F.sum("n").alias("n"))
    return partial.groupBy("event", "component").agg(_joined(F.col("n").cast("string"), F.col("d")).alias("portions"))


def event_demand(lines: DataFrame, served: DataFrame, keys: list[str] | None = None, reduced: bool = True) -> DataFrame:
    """Demand per (event, ingredient, base unit).

    lines: event, component, ingredient, quantity (per portion, text), unit, exact (boolean); served: event, component, portions (text). Portions of zero
    or less ask for nothing. quantity is exact; exact says whether all rows were exact, any_exact whether one was. keys (such as a scenario) go along. Sums that are
    summed on need not be reduced."""
    keys = keys or []
    rows = lines.join(served, [*keys, "event", "component"]).withColumns({"a": number(F.col("quantity"), 10, 8), "b": number(F.col("portions"), 8, 8), "factor": F.coalesce(parts(F.col("unit")), F.lit(SCALE)), "unit": base_unit(F.col("unit"))})
    # whole numbers in the JVM, as long as they have 33 digits at most; others as fractions of any size
    n = (F.col("a.n") * F.col("b.n")).cast("decimal(18,0)") * F.col("factor").cast("decimal(15,0)")
    d = (F.col("a.d") * F.col("b.d")).cast("decimal(16,0)") * F.lit(SCALE).cast("decimal(12,0)")
    sign = lambda text: F.startswith(F.trim(text), F.lit("-"))
    some = lambda text: text.rlike(r"^\s*-?[0.]*[1-9]")
    asks = F.coalesce(n > 0, (sign("quantity") == sign("portions")) & some(F.col("quantity")) & some(F.col("portions")))
    product = F.when(n.isNull(), F.concat_ws(BESIDE, "quantity", "portions", F.concat_ws("/", F.lit(str(SCALE)), F.col("factor").cast("string"))))
    split = rows.filter(asks).select(*keys, "event", "ingredient", "unit", "exact", F.col("exact").alias("any_exact"), n.cast("decimal(33,0)").alias("n"), d.cast("decimal(38,0)").alias("d"), product.alias("product"))
    return _summed(split, [*keys, "event", "ingredient"], reduced)


def combine(rows: DataFrame, keys: list[str], reduced: bool = True) -> DataFrame:
    """Exact sums of q per keys and unit, with exact and any_exact. Where a group has one denominator and the sum need not be reduced, it stays in the JVM."""
    r = number(F.col("q"), 33, 33)
    split = rows.withColumns({"n": r["n"], "d": r["d"].cast("decimal(38,0)"), "product": F.when(r.isNull(), F.concat_ws(BESIDE, "q", F.lit("1"), F.lit("1")))})
    return _summed(split if "any_exact" in rows.columns else split.withColumn("any_exact", F.col("exact")), keys, reduced)


def _summed(rows: DataFrame, keys: list[str], reduced: bool) -> DataFrame:
    """Sums of rows (keys, unit, n and d or product, exact, any_exact): whole numerators for each denominator, before and after the shuffle, then a group's few
    denominators and the products that are too long for them."""
    partial = rows.groupBy(*keys, "unit", "d").agg(F.sum("n").alias("n"), F.collect_list("product").alias("products"), F.bool_and("exact").alias("exact"), F.bool_or("any_exact").alias("any_exact"))
    fraction = F.when(F.col("d").isNotNull(), F.array(F.concat_ws("/", F.col("n").cast("string"), F.col("d").cast("string")))).otherwise(F.array().cast("array<string>"))
    sums = partial.groupBy(*keys, "unit").agg(F.flatten(F.collect_list(F.concat(fraction, "products"))).alias("texts"), F.min("n").alias("n"), F.min("d").alias("d"), F.bool_and("exact").alias("exact"), F.bool_or("any_exact").alias("any_exact"))
    return sums.select(*keys, "unit", total(F.col("texts"), F.col("n"), F.col("d"), reduced).alias("q"), "exact", "any_exact")


def meal_lines(demand: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys and ingredient: its quantity and unit, both null if units can't be combined, which `conflict` then lists."""
    by_unit = combine(demand, [*keys, "ingredient"])
    rows = by_unit.groupBy(*keys, "ingredient").agg(F.array_sort(F.collect_list(F.struct("unit", "q"))).alias("u"), F.bool_and("exact").alias("exact"), F.bool_or("any_exact").alias("any_exact"))
    one = F.size("u") == 1
    return rows.select(*keys, "ingredient", F.when(one, F.col("u")[0]["q"]).alias("meal"), F.when(one, F.col("u")[0]["unit"]).alias("unit"), F.when(~one, F.transform("u", lambda x: x.unit)).alias("conflict"), "exact", "any_exact")


