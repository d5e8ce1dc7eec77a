"""Units: three dimensions, exact factors, aliases. Mass ounces and fluid ounces are different dimensions and never convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Factors to the base unit (g, ml, each), as exact decimal text.
UNITS = {
    "g": ("mass", "1"),
    "kg": ("mass", "1000"),
    "oz": ("mass", "28.349523125"),
    "lb": ("mass", "453.59237"),
    "ml": ("volume", "1"),
    "l": ("volume", "1000"),
    "tsp": ("volume", "4.92892159375"),
    "tbsp": ("volume", "14.78676478125"),
    "cup": ("volume", "236.5882365"),
    "fl_oz": ("volume", "29.5735295625"),
    "each": ("count", "1"),
}
# Other spellings.
ALIASES = {
    "gram": "g", "grams": "g", "kilogram": "kg", "kilograms": "kg", "ounce": "oz", "ounces": "oz", "lbs": "lb", "pound": "lb", "pounds": "lb",
    "milliliter": "ml", "milliliters": "ml", "liter": "l", "liters": "l", "teaspoon": "tsp", "teaspoons": "tsp", "tablespoon": "tbsp", "tablespoons": "tbsp",
    "cups": "cup", "fl oz": "fl_oz", "fluid ounce": "fl_oz", "fluid ounces": "fl_oz", "ea": "each", "item": "each", "items": "each",
}
BASES = {"mass": "g", "volume": "ml", "count": "each"}
#: ALIASES as one literal: a plan's columns are made by calls to the JVM, and a call for each word takes seconds.
_ALIASES = "map(" + ", ".join(f"'{a}', '{u}'" for a, u in ALIASES.items()) + ")"
#: Every factor is a whole number of these parts.
SCALE = 10**11


def factor_parts(unit: str) -> int:
    """The factor to the base unit, times SCALE; an integer for every unit."""
    whole, _, fraction = UNITS[unit][1].partition(".")
    return int(whole + fraction.ljust(11, "0"))


def units_table(spark: SparkSession) -> DataFrame:
    """unit, dim, base, parts (factor times SCALE): eleven rows."""
    return spark.createDataFrame([(u, d, BASES[d], factor_parts(u)) for u, (d, _) in UNITS.items()], "unit string, dim string, base string, parts long")



def normalize_unit(unit: Column) -> Column:
    """Trimmed, lower case, without one trailing dot, with aliases folded; other units stay themselves."""
    folded = F.regexp_replace(F.lower(F.trim(unit)), r"\.$", "")
    return F.coalesce(F.try_element_at(F.expr(_ALIASES), folded), folded)


def dimension(unit: Column) -> Column:
    """mass, volume or count; null for other units, which only match themselves."""
    return F.try_element_at(F.create_map(*[F.lit(x) for u, (d, _) in UNITS.items() for x in (u, d)]), normalize_unit(unit))


def parts(unit: Column) -> Column:
    """The factor to the base unit as whole parts of 10^-11; null for other units."""
    return F.try_element_at(F.create_map(*[F.lit(x) for u in UNITS for x in (u, factor_parts(u))]), normalize_unit(unit))


def base_unit(unit: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for d, b in BASES.items() for x in (d, b)]), dimension(unit)), normalize_unit(unit))
