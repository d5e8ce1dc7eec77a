"""Short texts as streams of tokens: words, numbers and the marks ( ) , ;."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[(),;]|[^\s(),;]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def first(stream: Column, n: int = 1) -> Column:
    return F.coalesce(F.try_element_at(stream, F.lit(n)), F.lit(""))


def rest(stream: Column, n: Column | int) -> Column:
    return F.slice(stream, F.lit(n) + 1 if isinstance(n, int) else n + 1, F.size(stream))


def spoken(stream: Column) -> Column:
    """A stream as text, marks set as they are written."""
    return F.regexp_replace(F.regexp_replace(F.array_join(stream, " "), r" (?=[),;])", ""), r"(?<=\() ", "")


def tidy(text: Column) -> Column:
    """Without marks or blanks at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[\s,;:]+|[\s,;:]+$", "")


def bare(token: Column) -> Column:
    """A word of at most 12 letters, without the point of an abbreviation; else nothing."""
    return F.regexp_extract(token, r"^([A-Za-z]{1,12})\.?$", 1)


def parts(stream: Column) -> Column:
    """struct(name, aside, asides, tail) by a fold over tokens: what stands before the first comma outside parentheses, the texts in parentheses there, and the
    rest. What a parenthesis that never closes holds (aside) belongs to the name."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("after"), empty.alias("name"), empty.alias("aside"), empty.alias("asides"), empty.alias("tail"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = ~s["after"] & (t == "("), ~s["after"] & (t == ")")
        ends = closes & (s["depth"] == 1)
        comma = ~s["after"] & (t == ",") & (s["depth"] == 0)
        inside = (s["depth"] > 0) & ~ends
        depth = F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(
            depth.alias("depth"), (s["after"] | comma).alias("after"), F.when(~s["after"] & ~comma & ~opens & ~closes & (s["depth"] == 0), F.concat(s["name"], F.array(t))).otherwise(s["name"]).alias("name"),
            F.when(ends, empty).when(~s["after"] & inside, F.concat(s["aside"], F.array(t))).otherwise(s["aside"]).alias("aside"),
            F.when(ends, F.concat(s["asides"], F.array(tidy(spoken(s["aside"]))))).otherwise(s["asides"]).alias("asides"), F.when(s["after"], F.concat(s["tail"], F.array(t))).otherwise(s["tail"]).alias("tail"),
        )

    return F.aggregate(stream, start, step)
