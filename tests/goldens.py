"""Scalar functions with cases by hand: each applied to a table of cases, held against the results that the cases must have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larderflow.functions import amounts, readers, temporal, text, units

QUERIES, ORACLES = {}, {}

SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}


def literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).upper() if isinstance(value, bool) else str(value)


def golden(name: str, inputs: str, outputs: dict[str, tuple[str, Callable[[], Column]]], cases: list[tuple]) -> None:
    """Registers a query over the cases' inputs; its SQL is what the cases say the outputs are."""
    fields = [f.rsplit(" ", 1) for f in inputs.split(", ")]
    kinds = dict(fields) | {k: v for k, (v, _) in outputs.items()}

    def run(spark, d):
        given = spark.createDataFrame([c[: len(fields)] for c in cases], inputs)
        return given.select(*dict(fields), *[make().cast(kind).alias(k) for k, (kind, make) in outputs.items()])

    run.__name__, run.__doc__ = name, f"{', '.join(outputs)} of {', '.join(dict(fields))}."
    QUERIES[name] = run
    rows = ", ".join("(" + ", ".join(map(literal, c)) + ")" for c in cases)
    ORACLES[name] = f"SELECT {', '.join(f'CAST({k} AS {SQL_TYPES[v]}) AS {k}' for k, v in kinds.items())} FROM (VALUES {rows}) t({', '.join(kinds)})"


a = lambda: amounts.leading_amount(F.col("line"))
golden(
    "h08_leading_amount", "line string",
    {"status": ("string", lambda: a()["status"]), "n": ("long", lambda: a()["n"]), "d": ("long", lambda: a()["d"]), "used": ("int", lambda: a()["len"]), "was_decimal": ("boolean", lambda: a()["decimal"])},
    [
        ("1 1/2 cups flour", "ok", 3, 2, 5, False), ("1-1/2 cups", "ok", 3, 2, 5, False), ("1½ tsp", "ok", 3, 2, 2, False), ("½ onion", "ok", 1, 2, 1, False), ("1⁄2 cup", "ok", 1, 2, 3, False),
        ("2/4 cup", "ok", 1, 2, 3, False), ("1,000 g", "ok", 1000, 1, 5, False), (".5 l", "ok", 1, 2, 2, True), ("1.50 l", "ok", 3, 2, 4, True), ("12 eggs", "ok", 12, 1, 2, False), ("salt", None, None, None, None, None),
        ("1/0 cup", "invalid", None, None, None, False), ("0 eggs", "invalid", None, None, None, False), ("1 3/2 cup", "invalid", None, None, None, False), ("1,5 l", "invalid", None, None, None, False), ("", None, None, None, None, None), (None, None, None, None, None, None),
    ],
)
golden(
    "h09_parsed_amount", "line string", {"n": ("long", lambda: amounts.parsed_amount(F.col("line"))["n"]), "d": ("long", lambda: amounts.parsed_amount(F.col("line"))["d"])},
    [("12", 12, 1), (" 1 1/3 ", 4, 3), ("1½", 3, 2), ("1.5", 3, 2), ("10000", 10000, 1), ("10001", None, None), ("2 cups", None, None), ("0", None, None), ("-1", None, None), ("", None, None), (None, None, None)],
)
golden(
    "h10_amount_text", "n long, d long, as_decimal boolean", {"shown": ("string", lambda: amounts.amount_text(F.col("n"), F.col("d"), F.col("as_decimal")))},
    [(2, 1, False, "2"), (3, 2, False, "1 1/2"), (3, 2, True, "1.5"), (1, 3, True, "1/3"), (4, 3, False, "1 1/3"), (1, 8, True, "0.125"), (12001, 10000, True, "1.2001")],
)
golden(
    "h10_kitchen_amount", "q string", {"shown": ("string", lambda: amounts.kitchen_amount(F.col("q")))},
    [("0.333333333333", "⅓"), ("1.5", "1 ½"), ("0.0833", "1/12"), ("2", "2"), ("2.00001", "2"), ("0.37", "0.37"), ("1/3", "⅓"), ("1 1/2", "1 ½"), ("0.0625", "1/16"), ("3.141", "3.14"), ("abc", "abc"), ("0", "0"), ("-1", "-1"), (None, None)],
)
golden(
    "h11_per_serving", "line string, servings int", {"value": ("string", lambda: amounts.per_serving(F.col("line"), F.col("servings"))["value"]), "exact": ("boolean", lambda: amounts.per_serving(F.col("line"), F.col("servings"))["exact"])},
    [("2", 3, "0.666666666666", False), ("1", 8, "0.125", True), ("1 1/2", 2, "0.75", True), ("10", 4, "2.5", True), ("1/3", 3, "0.111111111111", False), ("12", 1, "12", True), ("x", 2, None, None), ("2", 0, None, None)],
)
golden(
    "h12_per_portion", "exact string, stored string, servings int",
    {"value": ("string", lambda: F.coalesce(amounts.per_serving(F.col("exact"), F.col("servings"))["value"], F.col("stored")))},
    [("3", "0.74", 4, "0.75"), (None, "0.333333333333", 3, "0.333333333333"), ("1/4", "9", 1, "0.25")],
)
golden(
    "h15_short_day", "day string", {"name": ("string", lambda: temporal.day_name(F.to_date("day"))), "short": ("string", lambda: F.substring(temporal.day_name(F.to_date("day")), 1, 3))},
    [("2026-10-12", "Monday", "Mon"), ("2026-10-18", "Sunday", "Sun"), ("2024-02-29", "Thursday", "Thu")],
)
golden(
    "h16_next_dinner", "moment string, zone string", {"day": ("string", lambda: temporal.next_dinner(F.to_timestamp("moment"), F.col("zone")))},
    [("2026-10-12 20:59:00", "UTC", "2026-10-12"), ("2026-10-12 21:00:00", "UTC", "2026-10-13"), ("2026-11-01 04:30:00", "America/Chicago", "2026-11-01"), ("2026-11-01 04:30:00", "America/Los_Angeles", "2026-11-01"), ("2026-03-08 12:00:00", "America/New_York", "2026-03-08")],
)
golden(
    "h01_units", "unit string", {"name": ("string", lambda: units.normalize_unit(F.col("unit"))), "dim": ("string", lambda: units.dimension(F.col("unit"))), "base": ("string", lambda: units.base_unit(F.col("unit"))), "parts": ("long", lambda: units.parts(F.col("unit")))},
    [(" Tbsp. ", "tbsp", "volume", "ml", 1478676478125), ("Pounds", "lb", "mass", "g", 45359237000000), ("fl oz", "fl_oz", "volume", "ml", 2957352956250), ("oz", "oz", "mass", "g", 2834952312500), ("items", "each", "count", "each", 100000000000), ("Clove", "clove", None, "clove", None), (None, None, None, None, None)],
)
golden(
    "h18_slug", "name string", {"slug": ("string", lambda: text.slug(F.col("name")))},
    [("Crème Brûlée", "cre_me_bru_le_e"), ("  Two--words!  ", "two_words"), ("ℌello", "ello"), ("ﬁne", "fine"), ("", ""), (None, None)],
)
golden(
    "h19_decimal_key", "q string", {"key": ("string", lambda: readers.decimal_key(F.col("q")))},
    [("075.50", "75.5"), ("75.5", "75.5"), ("0.500", "0.5"), ("3.000", "3"), ("100", "100"), ("000", "0"), (" 2 ", "2"), ("1/3", "1/3"), ("-1.0", "-1.0")],
)
golden("h20_form", "form string", {"name": ("string", lambda: readers.normalized_form(F.col("form")))}, [(None, "raw"), ("", "raw"), (" As Sold", "as_sold"), ("pan-fried  dry", "pan_fried_dry")])
golden(
    "h21_form_hint", "description string", {"hint": ("string", lambda: readers.form_hint(F.col("description")))},
    [("Chicken, raw", "raw"), ("Beef, roasted", "cooked"), ("Onions, raw, then fried", None), ("Strawberries", None), ("Potatoes, BOILED", "cooked"), ("rawhide", None)],
)
golden("h22_decimal_of", "v string", {"value": ("string", lambda: readers.decimal_of(F.col("v")))}, [("1.50", "1.5"), ("1e3", "1000"), (" -0.25 ", "-0.25"), ("2.5e-2", "0.025"), ("1,5", None), ("", None), (None, None)])
golden("h23_cents", "price string", {"cents": ("long", lambda: readers.dollars_to_cents(F.col("price")))}, [("2.50", 250), ("3", 300), ("0", None), ("-1", None), ("1.999", None), ("x", None), (None, None), ("1.0000001", None), ("2.500", 250), ("1e2", 10000), ("1.005", None)])
golden(
    "h24_package_size", "size string", {"quantity": ("string", lambda: readers.package_size(F.col("size"))["quantity"]), "unit": ("string", lambda: readers.package_size(F.col("size"))["unit"])},
    [
        ("1 gal", "3785.411784", "ml"), ("1/2 Gallon", "1892.705892", "ml"), ("2 lb", "2", "lb"), ("12 fl oz", "12", "fl_oz"), ("each", "1", "each"), ("16 oz", None, None), ("6 ct / 12 oz", None, None), ("about 1.5 lb", None, None),
        ("1.5 lbs.", "1.5", "lb"), ("12 CT", "12", "each"), ("1/3 gal", None, None), ("0 lb", None, None), ("1/0 lb", None, None), ("5-6 lb", None, None), ("", None, None), (None, None, None),
    ],
)
golden("h25_sale_basis", "sold_by string", {"basis": ("string", lambda: readers.sale_basis(F.col("sold_by")))}, [(" UNIT ", "unit"), ("weight", "weight"), ("dozen", "unknown"), (None, "unknown")])
golden(
    "h26_duration", "v string", {"minutes": ("int", lambda: readers.duration_minutes(F.col("v")))},
    [("PT1H30M", 90), ("P1DT2H", 1560), ("pt45m", 45), ("PT90S", 2), ("PT89.4S", 1), ("PT", None), ("P", None), ("P31D", None), ("P30D", 43200), ("1 hour", None), (None, None)],
)
golden("h27_clean_text", "markup string", {"shown": ("string", lambda: text.clean(F.col("markup")))}, [("<p>Salt &amp; <b>pepper</b></p>", "Salt & pepper"), ("a&lt;script&gt;x&lt;/script&gt;b", "a b"), (" a \n\t b ", "a b"), ("", ""), (None, None), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("a &copy b &copy; &#x1F600;", "a &copy b © 😀"), ("a<b", "a"), ("x<script>y</scriptz</script >z", "x z"), ("&#0;&#xD800;", "��")])
golden(
    "h28_link_key", "url string", {"ok": ("boolean", lambda: text.link(F.col("url"))["ok"]), "code": ("string", lambda: text.link(F.col("url"))["code"]), "key": ("string", lambda: text.link(F.col("url"))["key"])},
    [
        ("https://www.a.com/r?_ga=1&b=2&a=1", True, "ok", "a.com/r?a=1&b=2"), ("http://a.com/r", True, "ok", "a.com/r"), ("https://a.com/r/?utm_source=x&si=3#top", True, "ok", "a.com/r"), ("ftp://a.com", False, "unsupported_scheme", None),
        ("https://u:p@a.com", False, "credentials_in_url", None), ("https://10.0.0.1/x", False, "invalid_host", None), ("https://printer.local/x", False, "invalid_host", None), ("https://a_b.com/x", False, "invalid_host", None), ("", False, "invalid_url", None), ("https://a.com/r#top", True, "ok", "a.com/r"), ("https://a.com/a\tb", False, "invalid_url", None), ("https://a.com/" + "x" * 3000, False, "too_long", None), ("https://A.com./r//?b=1&b=0&c", True, "ok", "a.com/r?b=1&b=0&c="), ("a.com", False, "invalid_url", None),
    ],
)
golden(
    "h29_domain_of", "url string", {"host": ("string", lambda: text.domain(F.col("url")))},
    [("https://user:pw@www.Host.example.com:8443/x", "host.example.com"), ("http://a.com", "a.com"), ("https://www.b.org/?q", "b.org"), ("no url", None), ("", None), (None, None)],
)
golden(
    "h30_title_from_url", "url string", {"title": ("string", lambda: readers.title_from_url(F.col("url")))},
    [("https://a.com/easy-one-pot-chili/", "Easy one pot chili"), ("https://a.com/r/Best_PIE.html?x=1", "Best pie"), ("https://a.com/12345", None), ("https://a.com/", None), ("nothing", None), ("https://a.com/a%20pot+roast", "A pot roast")],
)
golden(
    "h31_seasoning", "name string, unit string, note string", {"seasoning": ("boolean", lambda: readers.is_seasoning(F.col("name"), F.col("unit"), F.col("note")))},
    [
        ("salt", None, None, True), ("kosher salt, divided", "tsp", None, True), ("salt (smoked)", "tsp", None, False), ("pepper", "tsp", "white", False), ("pepper", "each", None, False), ("freshly ground black pepper", "g", None, True), ("red bell pepper", "each", None, False),
        ("salt", "tsp", "plus more for the pasta water", True), ("black salt", "tsp", None, False), ("", None, None, False), ("salt and pepper to taste", None, "about 1 1/2 teaspoons", True),
    ],
)
golden(
    "h32_headings", "line string, has_amount boolean", {"heading": ("boolean", lambda: readers.is_heading(F.col("line"), F.col("has_amount"))), "name": ("string", lambda: readers.heading_name(F.col("line")))},
    [("For the pickled onions:", False, True, "Pickled onions"), ("TOPPINGS:", False, True, "Toppings"), ("2 cups flour:", True, False, "2 cups flour"), ("• For the Sauce", False, True, "Sauce"), (":", False, False, ""), ("flour", False, False, "Flour")],
)
golden("h33_list_unit", "unit string", {"shown": ("string", lambda: readers.list_unit(F.col("unit")))}, [("tbsp", "tablespoon"), ("lb", "lb"), ("fl_oz", None), ("clove", None), (None, None)])
golden(
    "h35_money", "cents long, unknown int", {"shown": ("string", lambda: readers.money(F.col("cents"))), "cost": ("string", lambda: readers.cost_view(F.col("cents"), F.col("unknown")))},
    [(123456, 0, "$1,234.56", "$1,234.56"), (5, 2, "$0.05", "$0.05 known + 2 unpriced"), (0, 3, "$0.00", "unknown — 3 unpriced"), (0, 0, "$0.00", "$0.00"), (None, 0, "unknown", "unknown")],
)
golden(
    "h36_image_type", "first string", {"kind": ("string", lambda: readers.image_type(F.unhex("first")))},
    [("FFD8FFE000", "image/jpeg"), ("89504E470D0A1A0A00", "image/png"), ("474946383961FF", "image/gif"), ("524946460000000057454250", "image/webp"), ("52494646000000005745", None), ("", None), (None, None)],
)
golden(
    "k17_decision_problem", "name string, quantity string, unit string",
    {"problem": ("string", lambda: F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name").when(amounts.parsed_amount(F.col("quantity")).isNull(), "amount").when(units.dimension(F.col("unit")).isNull(), "unit"))},
    [("flour", "1 1/2", "cups", None), ("", "1", "cup", "name"), ("flour", "some", "cup", "amount"), ("garlic", "2", "clove", "unit"), (None, None, None, "name"), ("eggs", "3", "each", None)],
)
golden(
    "h38_sql_scalars", "s string", {"low": ("string", lambda: F.lower("s")), "part": ("string", lambda: F.split_part(F.col("s"), F.lit(","), F.lit(2))), "place": ("int", lambda: F.locate(",", F.col("s"))), "size": ("int", lambda: F.octet_length("s")), "none": ("string", lambda: F.nullif(F.col("s"), F.lit("x"))), "digest": ("string", lambda: F.md5("s"))},
    [("A,b", "a,b", "b", 2, 3, "A,b", "52d3fc9d56dba17df6b05b2bba542c06"), ("x", "x", "", 0, 1, None, "9dd4e461268c8034f5c8564e155c67a6")],
)
