"""Histories: what a log says as of a cut, ranges of nights, where an amount comes from, what a stored decimal may have been."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.operators.chains import chains


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, stop: str, days: int = 16) -> DataFrame:
    """points joined with spans of equal keys whose [start, stop) holds `at` (dates).

    A span is dealt out to the bins of `days` days that it touches, so the join is one of equal keys and bins, and a pair meets in one bin only."""
    bin_of = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    binned = spans.filter(F.col(start) < F.col(stop)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.date_sub(F.col(stop), 1)))))
    return points.withColumn("_bin", bin_of(F.col(at))).join(binned, [*keys, "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_bin")


def as_of(log: DataFrame, household: list[str], keys: list[str], seq: str, cuts: DataFrame) -> DataFrame:
    """The latest row of each household's keys that is not after the household's cut (household, cut): one state over several logs, whatever has been written since.
    A household without a cut has no state."""
    seen = log.join(cuts, household).filter(F.col(seq) <= F.col("cut"))
    rest = [c for c in log.columns if c not in [*household, *keys]]
    return seen.groupBy(*household, *keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*household, *keys, *(F.col("_r").getField(c).alias(c) for c in rest))


def basis(rows: DataFrame) -> DataFrame:
    """id, basis (exact, legacy, invalid) and origin (the row whose amount it is) of rows (id, source, quantity, stated): stated is exact or legacy where a row
    says so itself, else null.

    A row that says nothing has its source's basis as long as their quantities are equal; a changed or new one is exact as typed. Links that hold are followed by
    pointer jumping, which stops where one doesn't; a source that isn't there, or a row that descends from itself, is invalid lineage."""
    theirs = rows.select(F.col("id").alias("source"), F.col("quantity").alias("_theirs"), F.lit(True).alias("_there"))
    linked = rows.join(theirs, "source", "left")
    lost = F.col("source").isNotNull() & F.col("_there").isNull()
    follows = F.col("stated").isNull() & F.col("_there").isNotNull() & F.col("_theirs").eqNullSafe(F.col("quantity"))
    links = linked.filter(~lost).select("id", F.when(follows, F.col("source")).alias("previous"))
    ends = linked.select(F.col("id").alias("root"), F.coalesce("stated", F.lit("exact")).alias("basis"))
    found = chains(links).join(ends, "root").select("id", "basis", F.col("root").alias("origin"))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("basis", F.lit("invalid")).alias("basis"), "origin")


# legacy decimals


def places(stored: Column) -> Column:
    """Decimal places of a plain decimal's text, zeros at its end aside."""
    return F.when(F.contains(stored, F.lit(".")), F.length(F.rtrim(F.substring_index(stored, ".", -1), F.lit("0")))).otherwise(0)


def risk(stored: Column) -> Column:
    p = places(stored)
    return F.when(p <= 3, "short_decimal").when(p == 4, "rounded_4dp").when(p == 12, "rounded_12dp").otherwise("long_decimal")


def simplest_fraction(stored: Column, most: int = 48) -> Column:
    """The fraction of the least denominator up to `most` that rounds to a decimal of more than three places at its own number of places; null if there is none.
    |n / d - s / 10^p| < half a unit of the last place, in whole numbers: 2 |n 10^p - s d| < d."""
    p = places(stored)
    scale = F.rpad(F.lit("1"), p + 1, F.lit("0")).cast("decimal(13,0)")
    whole = F.rpad(F.substring_index(F.concat(stored, F.lit(".")), ".", 1), F.length(F.substring_index(F.concat(stored, F.lit(".")), ".", 1)), F.lit("0"))
    digits = F.when(p > 0, F.substring(F.substring_index(stored, ".", -1), F.lit(1), p)).otherwise("")
    held = F.struct(scale.alias("scale"), F.concat(whole, digits).try_cast("decimal(18,0)").alias("s"))

    def found(x: Column, s: Column, scale: Column, near) -> Column:
        fits = F.filter(F.transform(F.sequence(F.lit(2), F.lit(most)), lambda d: F.struct(d.alias("d"), near(d).alias("n"))), lambda f: (f["n"] > 0) & (F.abs(f["n"] * scale - s * f["d"]) * 2 < f["d"]))
        first = F.try_element_at(fits, F.lit(1))
        return F.when(first.isNotNull(), F.concat_ws("/", first["n"].cast("string"), first["d"].cast("string")))

    def tried(x: Column) -> Column:
        # longs hold 2 s d + scale for most
        s, scale = x["s"].cast("long"), x["scale"].cast("long")
        short = found(x, s, scale, lambda d: F.call_function("div", s * d * 2 + scale, scale * 2))
        return F.when(F.abs(s) < 4 * 10**18 // most, short).otherwise(found(x, x["s"], x["scale"], lambda d: F.floor((x["s"] * d * 2 + x["scale"]) / (x["scale"] * 2)).cast("decimal(18,0)")))

    return F.when((p > 3) & (p <= 12), F.transform(F.array(held), tried)[0])


def stored_forms(n: Column, d: Column) -> Column:
    """The decimals that n / d may have been stored as, each once, with how: exact (if it ends within 12 places), 4 or 12 places half up, 12 places down."""

    def scaled(p: int, up: bool) -> Column:
        top = n.cast("decimal(18,0)") * F.lit(10**p).cast("decimal(13,0)")
        return F.floor((top * 2 + d) / (d * 2)).cast("decimal(30,0)") if up else ((top - top % d) / d).cast("decimal(30,0)")

    def text(v: Column, p: int) -> Column:
        digits = F.lpad(v.cast("string"), 30, "0")
        return F.regexp_replace(F.regexp_replace(F.concat(F.regexp_replace(F.substring(digits, 1, 30 - p), r"^0+(?=\d)", ""), F.lit("."), F.substring(digits, 31 - p, p)), "0+$", ""), r"\.$", "")

    ends = (n.cast("decimal(18,0)") * F.lit(10**12).cast("decimal(13,0)")) % d == 0
    forms = [("exact", F.when(ends, text(scaled(12, False), 12))), ("4dp_half_up", text(scaled(4, True), 4)), ("12dp_half_up", text(scaled(12, True), 12)), ("12dp_down", text(scaled(12, False), 12))]
    every = F.array(*[F.struct(v.alias("stored"), F.lit(i).alias("i"), F.lit(how).alias("how")) for i, (how, v) in enumerate(forms)])
    return F.filter(every, lambda x: x["stored"].isNotNull())


def draft_evidence(rows: DataFrame, drafts: DataFrame) -> DataFrame:
    """rows (id, draft, ingredient, unit, stored) with evidence (import_draft, conflicting, missing), amount and matches of draft lines (draft, ingredient, unit, n, d,
    servings): a line is evidence if its share of one serving, rounded in one of the known ways, is the stored decimal.

    Lines are turned into the few decimals that they may have been stored as, so the fuzzy join is one of equal keys. Two different amounts that fit conflict, and so
    do lines for the ingredient of which none fits."""
    keys = ["draft", "ingredient", "unit"]
    share = drafts.withColumn("whole", F.concat_ws("/", F.col("n").cast("string"), F.when(F.col("d") > 1, F.col("d").cast("string"))))
    forms = share.select(*keys, "whole", F.explode(stored_forms(F.col("n"), F.col("d") * F.col("servings"))).alias("f")).select(*keys, "whole", "f.*").groupBy(*keys, "stored", "whole").agg(F.min(F.struct("i", "how")).alias("f"))
    fits = forms.groupBy(*keys, "stored").agg(F.count(F.lit(1)).alias("amounts"), F.min("whole").alias("amount"), F.min("f").alias("f"))
    any_line = drafts.select(*keys).distinct().withColumn("lines", F.lit(True))
    out = rows.join(fits, [*keys, "stored"], "left").join(any_line, keys, "left")
    one = F.col("amounts") == 1
    evidence = F.when(one, "import_draft").when(F.col("lines").isNotNull(), "conflicting").otherwise("missing")
    return out.select(*rows.columns, evidence.alias("evidence"), F.when(one, F.col("amount")).alias("amount"), F.when(one, F.col("f.how")).alias("matches"))
