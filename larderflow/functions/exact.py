"""Exact rational quantities. At rest and in columns they are reduced text, "2" or "2/3"; nothing passes through floating point.

Sums over rows stay in the JVM while all denominators are powers of a common scale (see units.SCALE); what cannot is done by Arrow UDFs over Python's
Fraction, one batch at a time. Unknown stays unknown: a null argument gives null. A division by zero and a text that is no number are errors."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderflow.functions.amounts import gcd, let

#: What a number is written with; Fraction itself would also take "+1", "1_000" and digits of other scripts.
WRITTEN = frozenset("0123456789.-/eE+")


def parse(text: str) -> Fraction:
    """A decimal ("12", "-1.5", "1e-7") or a ratio ("2/3")."""
    text = text.strip()
    if text.startswith("+") or not WRITTEN.issuperset(text):
        raise ValueError(f"not a decimal: {text}")
    return Fraction(text)


def to_decimal(value: Fraction, places: int) -> str:
    """Plain decimal text, rounded half away from zero, without trailing zeros; never "-0"."""
    nearest = math.floor(abs(value) * 10**places + Fraction(1, 2))
    text = format(Decimal((int(value < 0 and nearest > 0), Decimal(nearest).as_tuple().digits, -places)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def packages(demand: Fraction, package: Fraction) -> int:
    """The least number of packages that holds the demand; none for no demand."""
    if demand <= 0:
        return 0
    if package <= 0:
        raise ValueError("package quantity must be positive")
    return -(-demand // package)


def _binary(op: Callable[[Fraction, Fraction], Fraction]):
    @F.pandas_udf("string")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else str(op(parse(x), parse(y))) for x, y in zip(a, b, strict=True)], dtype=object)

    return apply


def q_add(a: Column, b: Column) -> Column:
    return _binary(lambda x, y: x + y)(a, b)


def q_sub(a: Column, b: Column) -> Column:
    return _binary(lambda x, y: x - y)(a, b)


def q_mul(a: Column, b: Column) -> Column:
    return _binary(lambda x, y: x * y)(a, b)


def q_div(a: Column, b: Column) -> Column:
    return _binary(lambda x, y: x / y)(a, b)


def q_min(a: Column, b: Column) -> Column:
    return _binary(min)(a, b)


def q_max(a: Column, b: Column) -> Column:
    return _binary(max)(a, b)


def q_cmp(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else (parse(p) > parse(q)) - (parse(p) < parse(q)) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return apply(a, b)


def q_to_decimal(a: Column, places: int) -> Column:
    @F.pandas_udf("string")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else to_decimal(parse(p), places) for p in x], dtype=object)

    return apply(a)


def q_packages(demand: Column, package: Column) -> Column:
    @F.pandas_udf("long")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else packages(parse(p), parse(q)) for p, q in zip(x, y, strict=True)], dtype="Int64")

    return apply(demand, package)


def q_convert(qty: Column, unit: Column, to: Column) -> Column:
    """qty in another unit; null between dimensions and for other units that differ."""
    from larderflow.functions.units import dimension, normalize_unit, parts

    same = normalize_unit(unit).eqNullSafe(normalize_unit(to))
    ratio = F.concat(parts(unit).cast("string"), F.lit("/"), parts(to).cast("string"))  # null where either is unknown
    return F.when(same, qty).when(dimension(unit) == dimension(to), q_mul(qty, ratio))


def q_sum(qty: Column) -> Column:
    """Grouped exact sum; known rows only, "0" if there is none."""

    @F.pandas_udf("string")
    def total(x: pd.Series) -> str:
        return str(sum((parse(p) for p in x if p is not None), Fraction(0)))

    return total(qty)


#: Between the factors and the divisor of a product that is kept as text: a, b, c for a * b / c.
BESIDE = "\x1f"


def ratio(text: Column) -> Column:
    """struct(n, d) of the texts of a decimal's or fraction's numerator and denominator."""
    point = F.contains(text, F.lit("."))
    places = F.when(point, F.length(F.substring_index(text, ".", -1))).otherwise(0)
    fraction = F.contains(text, F.lit("/"))
    n = F.when(fraction, F.substring_index(text, "/", 1)).otherwise(F.replace(text, F.lit("."), F.lit("")))
    d = F.when(fraction, F.substring_index(text, "/", -1)).otherwise(F.rpad(F.lit("1"), places + 1, F.lit("0")))
    return F.struct(n.alias("n"), d.alias("d"))


def number(text: Column, n_digits: int, d_digits: int) -> Column:
    """struct(n, d) of a plain decimal or fraction as whole numbers of at most so many digits, d over zero; null for texts that are longer or written otherwise."""
    r = ratio(text)
    n, d = r["n"].try_cast(f"decimal({n_digits},0)"), r["d"].try_cast(f"decimal({d_digits},0)")
    return F.when(text.rlike("^-?[0-9]+([./][0-9]+)?$") & n.isNotNull() & (d > 0), F.struct(n.alias("n"), d.alias("d")))


def reduced(n: Column, d: Column) -> Column:
    """Text of n / d, longs, d over zero."""
    div = lambda a, b: F.call_function("div", a, b).cast("string")
    return F.when(n % d == 0, div(n, d)).otherwise(let(gcd(F.abs(n), d), lambda g: F.concat_ws("/", div(n, g), div(d, g))))


def _product(text: str) -> Fraction:
    if BESIDE not in text:
        return Fraction(text)
    a, b, c = text.split(BESIDE)
    return parse(a) * parse(b) / parse(c)


@F.pandas_udf(T.StringType())
def _sum(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else str(sum(map(_product, t), Fraction(0))) for t in texts], dtype=object)


def total(texts: Column, n: Column, d: Column, reduce: bool = True) -> Column:
    """Text of the sum of texts (array of fractions and products, see BESIDE); n and d, decimals, are the numbers of one of its fractions, null if it has none.

    A single fraction stays in the JVM, if it need not be reduced or both numbers are short; of such rows Python sees nulls only."""
    single = (F.size(texts) == 1) & n.isNotNull()
    if reduce:
        short, small = n.try_cast("decimal(18,0)").cast("long"), d.try_cast("decimal(18,0)").cast("long")
        single = single & short.isNotNull() & small.isNotNull()
        done = let(F.struct(short.alias("n"), small.alias("d")), lambda x: reduced(x["n"], x["d"]))
    else:
        done = F.concat_ws("/", n.cast("string"), d.cast("string"))
    return F.when(F.size(texts) == 0, "0").when(single, done).otherwise(_sum(F.when(~single & (F.size(texts) > 0), texts)))


def short(text: Column) -> Column:
    """struct(n, d) of a plain decimal or fraction as longs of 17 digits at most, d over zero; null for texts that are longer or written otherwise."""
    whole = F.struct(text.try_cast("long").alias("n"), F.lit(1).cast("long").alias("d"))
    return F.when(text.rlike("^-?[0-9]{1,17}$"), whole).when(text.isNotNull(), number(text, 17, 17).cast("struct<n:bigint,d:bigint>"))


# exact steps on such pairs; n or d of what would not fit into a long is null, see known()


def pair(n: Column | int, d: Column | int = 1) -> Column:
    of = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.struct(of(n).alias("n"), of(d).alias("d"))


def known(a: Column) -> Column:
    return a["n"].isNotNull() & a["d"].isNotNull()


def times(a: Column, b: Column) -> Column:
    return pair(F.try_multiply(a["n"], b["n"]), F.try_multiply(a["d"], b["d"]))


def less(a: Column, b: Column) -> Column:
    """a less b."""
    return pair(F.try_subtract(F.try_multiply(a["n"], b["d"]), F.try_multiply(b["n"], a["d"])), F.try_multiply(a["d"], b["d"]))


def at_least(a: Column, b: Column) -> Column:
    """Whether a >= b; null if it can't be told in longs."""
    return F.try_multiply(a["n"], b["d"]) >= F.try_multiply(b["n"], a["d"])


def lesser(a: Column, b: Column) -> Column:
    return F.when(at_least(b, a), a).when(~at_least(b, a), b)


def not_below_zero(a: Column) -> Column:
    return F.when(a["n"] < 0, pair(0)).otherwise(a)


def rounded(a: Column, places: int) -> Column:
    """Whole number of 10^-places, half away from zero."""
    size = F.call_function("div", F.try_add(F.try_multiply(F.abs(a["n"]), F.lit(2 * 10**places).cast("long")), a["d"]), F.try_multiply(a["d"], F.lit(2).cast("long")))
    return F.when(a["n"] < 0, -size).otherwise(size)


def packs(demand: Column, package: Column) -> Column:
    """packages() of pairs; null also where it is an error."""
    n, d = F.try_multiply(demand["n"], package["d"]), F.try_multiply(demand["d"], package["n"])
    return F.when(demand["n"] <= 0, F.lit(0).cast("long")).when(d > 0, F.call_function("div", n - 1, d) + 1)


def shown(a: Column) -> Column:
    """A pair's reduced text; null if it is not known."""
    return F.when(known(a), reduced(a["n"], a["d"]))


def conversion(unit: Column, to: Column) -> Column:
    """Pair that an amount in `unit` is multiplied by to be one in `to`; null between dimensions and for other units that differ."""
    from larderflow.functions.units import UNITS, factor_parts, normalize_unit

    ratios = {f"{a}>{b}": Fraction(factor_parts(a), factor_parts(b)) for a in UNITS for b in UNITS if a != b and UNITS[a][0] == UNITS[b][0]}
    table = F.expr("map(" + ", ".join(f"'{k}', named_struct('n', {v.numerator}L, 'd', {v.denominator}L)" for k, v in ratios.items()) + ")")
    a, b = normalize_unit(unit), normalize_unit(to)
    return F.when(unit.eqNullSafe(to), pair(1)).when(unit.isNotNull() & to.isNotNull(), F.when(a == b, pair(1)).otherwise(F.try_element_at(table, F.concat_ws(">", a, b))))


def by_fractions(step: Callable, schema: str, needed: Column, *args: Column) -> Column:
    """step(*args) in Python, a tuple of schema's fields, where needed (what longs can't hold); of other rows Python sees nulls only."""
    fields = [f.split()[1] for f in schema.split(", ")]
    kinds = {"string": object, "boolean": "boolean", "long": "Int64"}
    names = [f.split()[0] for f in schema.split(", ")]

    @F.pandas_udf(schema)
    def apply(now: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        out = [[None] * len(now) for _ in names]
        for i in now.to_numpy(dtype=bool, na_value=False).nonzero()[0].tolist():
            for held, value in zip(out, step(*(None if pd.isna(c.iat[i]) else c.iat[i] for c in columns)), strict=True):
                held[i] = value
        return pd.DataFrame({n: pd.Series(v, dtype=kinds[k]) for n, k, v in zip(names, fields, out, strict=True)})

    return apply(needed, *[F.when(needed, a) for a in args])


def sum_parts(value: Column, product: Column) -> Column:
    """Aggregate for sum_text(): whole numbers of pairs are summed; other pairs and products (see BESIDE; where the pair is not known) are kept as texts."""
    whole = known(value) & (value["d"] == 1)
    return F.struct(F.sum(F.when(whole, value["n"].cast("decimal(19,0)"))).alias("whole"), F.collect_list(F.when(known(value) & ~whole, F.concat_ws("/", value["n"].cast("string"), value["d"].cast("string"))).otherwise(product)).alias("others"))


def sum_text(*sums: Column) -> Column:
    """Text of the sum of sum_parts(), null ones as nothing; whole numbers stay in the JVM."""
    zero = F.lit(0).cast("decimal(29,0)")
    whole = sum((F.coalesce(s["whole"].cast("decimal(29,0)"), zero) for s in sums[1:]), F.coalesce(sums[0]["whole"].cast("decimal(29,0)"), zero)).cast("string")
    others = F.concat(*[F.coalesce(s["others"], F.array().cast("array<string>")) for s in sums])
    return F.when(F.size(others) == 0, whole).otherwise(_sum(F.when(F.size(others) > 0, F.concat(others, F.array(whole)))))


def whole_packages(demand_parts: Column, package_parts: Column) -> Column:
    """Package count in the JVM, both sides as whole parts (long or decimal(38,0)) of one scale; never a division of decimals, which would round."""
    d, p = demand_parts.cast("decimal(38,0)"), package_parts.cast("decimal(38,0)")
    floor = ((d - d % p) / p).cast("bigint")
    return F.when(d <= 0, F.lit(0).cast("bigint")).otherwise(floor + F.when(d % p > 0, 1).otherwise(0))


def cents(amount: Column) -> Column:
    """A double of money as whole minor units."""
    return F.round(amount * 100).cast("bigint")
