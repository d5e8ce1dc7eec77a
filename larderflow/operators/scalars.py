"""Scalar functions over the driver's tables: texts as people write them are made of each row's values by SQL that both engines read, the functions read
them back, and the SQL says by arithmetic what must come out. Cases by hand are in the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larderflow.functions import amounts, readers, temporal, text, units
from larderflow.functions.ingredient_lines import read_lines
from larderflow.operators.relational import ORACLES, QUERIES

#: Keys, columns and a number for the form of each row's text, by table.
BASES = {
    "line": ("lineitem", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS k, (l_orderkey + l_linenumber) % 8 AS f, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem"),
    "part": ("part", ["p_partkey"], "SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS q, p_partkey % 8 AS f FROM part"),
    "page": ("pages", ["page_id"], "SELECT page_id, url FROM pages"),
    "order": ("orders", ["o_orderkey"], "SELECT o_orderkey, o_orderdate FROM orders"),
    "event": ("events", ["event_id"], "SELECT event_id, ts, event_id % 2 = 0 AS f FROM events"),
    "customer": ("customer", ["c_custkey"], "SELECT c_custkey, c_name FROM customer"),
}


def scalar(name: str, base: str, given: dict[str, str], outputs: dict[str, tuple[Callable[[], Column], str]], doc: str, shared: dict[str, Callable[[], Column]] | None = None) -> None:
    """Registers a query: `given` are columns made of the base's by SQL for both engines, outputs the functions' results and SQL for what they must be. What several
    outputs need is `shared`: read once a row."""
    source, keys, rows = BASES[base]
    made = ", ".join(f"{sql} AS {c}" for c, sql in given.items())

    def run(spark, d):
        df = _rows(spark, d, source, rows)
        for c, sql in given.items():
            df = df.withColumn(c, F.expr(sql))
        for c, f in (shared or {}).items():
            df = df.withColumn(c, f())
        return df.select(*keys, *[f().alias(c) for c, (f, _) in outputs.items()])

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join(keys)}, {', '.join(f'{sql} AS {c}' for c, (_, sql) in outputs.items())} FROM (SELECT *{', ' + made if made else ''} FROM ({rows}))"


def _rows(spark, d, source: str, rows: str):
    """The base's rows from the table's file: its select list is plain SQL."""
    df = spark.read.parquet(f"{d}/{source}.parquet")
    return df.selectExpr(*_select_list(rows))


def _select_list(sql: str) -> list[str]:
    out, depth, start = [], 0, 0
    inner = sql[len("SELECT ") : sql.rindex(" FROM ")]
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(inner[start:i].strip())
            start = i + 1
    return [*out, inner[start:].strip()]


def case(*whens: str, other: str = "NULL") -> str:
    """CASE over the row's form: whens[i] for form i."""
    return "CASE f " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(whens)) + f" ELSE {other} END"


BIG, INT = "CAST({} AS BIGINT)", "CAST({} AS INTEGER)"


def big(sql: str) -> str:
    return BIG.format(sql)


def integer(sql: str) -> str:
    return INT.format(sql)


def decimal_sql(scaled: str, places: int) -> str:
    """DuckDB SQL: plain decimal text of a whole number of 10^-places."""
    return f"(({scaled}) // {10**places} || CASE WHEN ({scaled}) % {10**places} = 0 THEN '' ELSE '.' || rtrim(lpad((({scaled}) % {10**places})::VARCHAR, {places}, '0'), '0') END)"


amount = lambda: F.col("_amount")
scalar(
    "h08_leading_amount", "line", {"t": case("q || ' 3/8 cups'", "q || '/64 cup'", "q || '½ tsp'", "q || ',000 g'", "q || '.50 l'", "'0/' || q", "q || '/0 x'", "'salt ' || q")},
    {
        "status": (lambda: amount()["status"], case(*["'ok'"] * 5, "'invalid'", "'invalid'")),
        "n": (lambda: amount()["n"], big(case("q * 8 + 3", "q // gcd(q, 64)", "q * 2 + 1", "q * 1000", "(q * 10 + 5) // gcd(q * 10 + 5, 10)"))), "d": (lambda: amount()["d"], big(case("8", "64 // gcd(q, 64)", "2", "1", "10 // gcd(q * 10 + 5, 10)"))),
        "used": (lambda: amount()["len"], integer(case("length(t) - 5", "length(t) - 4", "length(t) - 4", "length(t) - 2", "length(t) - 2"))), "was_decimal": (lambda: amount()["decimal"], case("false", "false", "false", "false", "true", "false", "false")),
    },
    "Amounts at the beginning of lines: mixed, fractions, glyphs, thousands, decimals, what is none.", {"_amount": lambda: amounts.leading_amount(F.col("t"))},
)
parsed = lambda: amounts.parsed_amount(F.col("t"))
scalar(
    "h09_parsed_amount", "line", {"t": case("' ' || q || ' 1/3 '", "q || '½'", "q || '.25'", "CAST(q * 300 AS VARCHAR(9))", "q || ' cups'", "'-' || q", "q || '/7'", "''")},
    {"n": (lambda: parsed()["n"], big(case("q * 3 + 1", "q * 2 + 1", "(q * 4 + 1)", "CASE WHEN q * 300 <= 10000 THEN q * 300 END", "NULL", "NULL", "q // gcd(q, 7)"))), "d": (lambda: parsed()["d"], big(case("3", "2", "4", "CASE WHEN q * 300 <= 10000 THEN 1 END", "NULL", "NULL", "7 // gcd(q, 7)")))},
    "Texts that are one amount and nothing else.",
)
scalar(
    "h10_amount_text", "line", {"n": "q * 2 + 1", "d": "CAST(2 AS BIGINT)", "dec": "f % 2 = 0"},
    {"shown": (lambda: amounts.amount_text(F.col("n"), F.col("d"), F.col("dec")), "CASE WHEN dec THEN q || '.5' ELSE q || ' 1/2' END"), "small": (lambda: amounts.amount_text(F.lit(1).cast("long"), F.col("k") + 1, F.col("dec")), f"CASE WHEN dec AND 1000000 % (k + 1) = 0 THEN {decimal_sql('1000000 // (k + 1)', 6)} ELSE '1/' || (k + 1) END")},
    "Amounts as texts: decimals where they are exact and asked for, else mixed fractions.",
)
scalar(
    "h10_kitchen_amount", "line", {"t": case("q || '.333333333333'", "q || '.5'", "q || '.0833'", "q || '.00001'", "q || '.37'", "q || ' 1/2'", "'x' || q", "'0.0625'")},
    {"shown": (lambda: amounts.kitchen_amount(F.col("t")), case("q || ' ⅓'", "q || ' ½'", "q || ' 1/12'", "q || ''", "q || '.37'", "q || ' ½'", "'x' || q", "'1/16'"))},
    "Amounts as a kitchen shows them.",
)
served = lambda: F.col("_served")
serving = {"_served": lambda: amounts.per_serving(F.col("t"), F.col("k"))}
scalar(
    "h11_per_serving", "line", {"t": "q || ''"}, {"value": (lambda: served()["value"], decimal_sql("q * 1000000000000 // k", 12)), "exact": (lambda: served()["exact"], "q * 1000000000000 % k = 0")},
    "One serving of each amount: exact, or twelve places rounded toward zero.", serving,
)
scalar(
    "h12_per_portion", "line", {"t": "CASE WHEN f % 2 = 0 THEN q || ' 1/2' END", "stored": "q || '.7'"},
    {"value": (lambda: F.coalesce(served()["value"], F.col("stored")), f"CASE WHEN f % 2 = 0 THEN {decimal_sql('(q * 2 + 1) * 500000000000 // k', 12)} ELSE stored END")},
    "A portion's amount from the exact one, else the stored one.", serving,
)
scalar(
    "h15_short_day", "order", {"day": "CAST(o_orderdate AS DATE)"},
    {"name": (lambda: temporal.day_name(F.col("day")), "dayname(day)"), "short": (lambda: F.substring(temporal.day_name(F.col("day")), 1, 3), "left(dayname(day), 3)")}, "Names of days.",
)
scalar(
    "h16_next_dinner", "event", {"zone": "CASE WHEN f THEN 'America/New_York' ELSE 'UTC' END"},
    {"day": (lambda: temporal.next_dinner(F.col("ts").cast("timestamp"), F.col("zone")), "CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE zone) + INTERVAL 3 HOUR AS DATE)")}, "The day of the next dinner in each event's zone: tomorrow from nine in the evening on.",
)
scalar(
    "h01_units", "part", {"u": case("' Tbsp. '", "'Pounds'", "'fl oz'", "'OZ'", "'items'", "'Clove'", "'KG'", "'Cups'")},
    {
        "name": (lambda: units.normalize_unit(F.col("u")), "CASE WHEN rtrim(lower(trim(u)), '.') IN ('pounds') THEN 'lb' WHEN lower(u) = 'items' THEN 'each' WHEN lower(u) = 'cups' THEN 'cup' ELSE replace(rtrim(lower(trim(u)), '.'), ' ', '_') END"),
        "dim": (lambda: units.dimension(F.col("u")), "CASE WHEN f IN (1, 3, 6) THEN 'mass' WHEN f IN (0, 2, 7) THEN 'volume' WHEN f = 4 THEN 'count' END"), "base": (lambda: units.base_unit(F.col("u")), "CASE WHEN f IN (1, 3, 6) THEN 'g' WHEN f IN (0, 2, 7) THEN 'ml' WHEN f = 4 THEN 'each' ELSE 'clove' END"),
        "parts": (lambda: units.parts(F.col("u")), big("round(1e11::DECIMAL(13, 0) * " + case("14.78676478125", "453.59237", "29.5735295625", "28.349523125", "1", "NULL", "1000", "236.5882365") + ", 0)")),
    },
    "Units by their spellings: name, dimension, base unit, exact factor.",
)
scalar("h18_slug", "part", {"t": "'  Crème ' || p_name || '--' || q || '! '"}, {"slug": (lambda: text.slug(F.col("t")), "'cre_me_' || replace(p_name, ' ', '_') || '_' || q")}, "Names as keys.")
scalar("h19_decimal_key", "line", {"t": case("'0' || q || '.' || k || '0'", "'00' || q || '.000'", "' ' || q || ' '", "q || '/3'", other="q || '00'")}, {"key": (lambda: readers.decimal_key(F.col("t")), case("q || '.' || k", "q || ''", "q || ''", "q || '/3'", other="q || '00'"))}, "One spelling for each decimal.")
scalar("h20_form", "part", {"t": "CASE f WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' Pan-' || p_name || '  Dry' END"}, {"name": (lambda: readers.normalized_form(F.col("t")), "CASE WHEN f < 2 THEN 'raw' ELSE 'pan_' || replace(p_name, ' ', '_') || '_dry' END")}, "Names of forms.")
scalar("h21_form_hint", "part", {"t": "p_name || " + case("', raw'", "', ROASTED'", "', raw, then fried'", "' rawhide'", other="', boiled'")}, {"hint": (lambda: readers.form_hint(F.col("t")), case("'raw'", "'cooked'", "NULL", "NULL", other="'cooked'"))}, "Whether a description says raw or cooked.")
scalar("h22_decimal_of", "line", {"t": case("q || '.' || k || '0'", "q || 'e2'", "' -' || q || '.25 '", "q || ',5'", "q || '5e-1'", other="''")}, {"value": (lambda: readers.decimal_of(F.col("t")), case("q || '.' || k", "q || '00'", "'-' || q || '.25'", "NULL", "q || '.5'"))}, "Numbers as plain decimals.")
scalar("h23_cents", "line", {"t": case("q || '.' || k || '0'", "q || ''", "q || '.' || k || '99'", "'-' || q", "q || '.0000001'", "q || '.500000'", other="'x'")}, {"cents": (lambda: readers.dollars_to_cents(F.col("t")), big(case("q * 100 + k * 10", "q * 100", "NULL", "NULL", "NULL", "q * 100 + 50")))}, "Whole cents of amounts with two places at most.")
size = lambda: readers.package_size(F.col("t"))
scalar(
    "h24_package_size", "line", {"t": case("q || ' LB'", "q || '/2 Gallon'", "q || ' fl. oz.'", "q || ' oz'", "q || '-' || k || ' lb'", "'about ' || q || ' lb'", "q || ' ct'", "q || '/3 lbs.'")},
    {"quantity": (lambda: size()["quantity"], case("q || ''", decimal_sql("q * 1892705892", 6), "q || ''", "NULL", "NULL", "NULL", "q || ''", "CASE WHEN q % 3 = 0 THEN (q // 3) || '' END")), "unit": (lambda: size()["unit"], case("'lb'", "'ml'", "'fl_oz'", "NULL", "NULL", "NULL", "'each'", "CASE WHEN q % 3 = 0 THEN 'lb' END"))},
    "Sizes on labels; what is ambiguous has none.",
)
scalar("h25_sale_basis", "line", {"t": case("' UNIT '", "'weight'", "NULL", other="'dozen'")}, {"basis": (lambda: readers.sale_basis(F.col("t")), case("'unit'", "'weight'", other="'unknown'"))}, "By what a product is sold.")
scalar(
    "h26_duration", "line", {"t": case("'PT' || q || 'H' || k || 'M'", "'P' || q || 'D'", "'pt' || q || 's'", "q || ' hours'", "'P' || k || 'DT' || q || 'M'", "'PT'", "'PT' || q || '.5S'")},
    {"minutes": (lambda: readers.duration_minutes(F.col("t")), integer(case("q * 60 + k", "CASE WHEN q <= 30 THEN q * 1440 END", "(q + 30) // 60", "NULL", "k * 1440 + q", "NULL", "CASE WHEN q >= 30 THEN 1 ELSE 0 END")))}, "Whole minutes of durations.",
)
scalar(
    "h27_clean_text", "part", {"t": case("'<p>' || p_name || ' &amp; <b>' || p_brand || '</b></p>'", "'1 < ' || q || ' &copy ' || p_name || ' > 2'", "'&lt;i&gt;' || p_name || '<script>x < y</script>'", "' ' || p_name || ' &#8211; &#x41;&frac12;&none; '", other="'<!-- ' || p_name")},
    {"shown": (lambda: text.clean("t"), case("p_name || ' & ' || p_brand", "'1 < ' || q || ' &copy ' || p_name || ' > 2'", "p_name || ''", "p_name || ' – A½&none;'", other="''"))}, "Plain text of markup.",
)
link = lambda: text.link(F.col("t"))
scalar(
    "h28_link_key", "page", {"t": "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://WWW.') || '/' WHEN 2 THEN replace(url, '://', '://u:p@') WHEN 3 THEN 'ftp' || url WHEN 4 THEN url || repeat('x', 2100) ELSE replace(url, '.example.', '.example.local/') END"},
    {
        "ok": (lambda: link()["ok"], "page_id % 6 < 2"), "code": (lambda: link()["code"], "['ok', 'ok', 'credentials_in_url', 'unsupported_scheme', 'too_long', 'invalid_host'][page_id % 6 + 1]"),
        "key": (lambda: link()["key"], "CASE WHEN page_id % 6 < 2 THEN regexp_replace(lower(regexp_extract(t, '://([^/]*)', 1)), '^www[.]', '') || CASE WHEN contains(split_part(t, '#', 1), '?') THEN regexp_extract(t, '://[^/]*([^?#]*)', 1) ELSE rtrim(regexp_extract(t, '://[^/]*([^?#]*)', 1), '/') END || "
        "coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(t, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))), '&'), ''), '') END"),
    },
    "Links of pages and their variants: refused with a code, or with the key that variants share.",
)
scalar("h29_domain_of", "page", {"t": "CASE WHEN page_id % 3 = 0 THEN replace(url, '://', '://user:pw@') WHEN page_id % 3 = 1 THEN url ELSE 'no url' END"}, {"host": (lambda: text.domain(F.col("t")), "CASE WHEN page_id % 3 < 2 THEN regexp_replace(lower(regexp_extract(url, '://([^/:?#]*)', 1)), '^www[.]', '') END")}, "Hosts without user, port and www.")
scalar("h30_title_from_url", "part", {"t": case("'https://a.com/r/' || replace(p_name, ' ', '-') || '/'", "'https://a.com/' || upper(replace(p_name, ' ', '_')) || '.html?x=1'", "'https://a.com/' || p_partkey", other="'https://a.com/' || replace(p_name, ' ', '%20') || '#top'")}, {"title": (lambda: readers.title_from_url(F.col("t")), "CASE WHEN f <> 2 THEN upper(left(p_name, 1)) || lower(substr(p_name, 2)) END")}, "Names from the last part of a link's path.")
scalar(
    "h31_seasoning", "line", {"t": case("'salt'", "'kosher salt, divided'", "'salt (smoked)'", "'freshly ground black pepper'", "'red bell pepper'", "'pepper'", "'black salt'", "'salt and pepper to taste'"), "u": "CASE WHEN k % 2 = 0 THEN 'each' ELSE 'tsp' END", "note": "CASE WHEN k = 7 THEN 'white; for the pasta' WHEN k = 6 THEN 'about ' || q || ' teaspoons' END"},
    {"seasoning": (lambda: readers.is_seasoning(F.col("t"), F.col("u"), F.col("note")), "k <> 7 AND f IN (0, 1, 3, 5, 7) AND NOT (f = 5 AND k % 2 = 0)")}, "Which lines are the salt and pepper that every household has.",
)
scalar(
    "h32_headings", "part", {"t": case("'For the ' || p_name || ':'", "upper(p_name) || ':'", "q || ' ' || p_name || ':'", "'• For the ' || p_name", other="p_name"), "has": "f = 5"},
    {"heading": (lambda: readers.is_heading(F.col("t"), F.col("has")), "f IN (0, 1, 3)"), "name": (lambda: readers.heading_name(F.col("t")), "CASE WHEN f = 2 THEN q || ' ' || p_name ELSE upper(left(p_name, 1)) || substr(p_name, 2) END")}, "Lines that head a group, and the group's name.",
)
scalar("h33_list_unit", "line", {"t": case("'tbsp'", "'lb'", "'fl_oz'", "'clove'", "'cup'", other="'g'")}, {"shown": (lambda: readers.list_unit(F.col("t")), case("'tablespoon'", "t", "NULL", "NULL", "t", other="t"))}, "Units of a delivery service's lists.")
MONEY_SQL = "'$' || format('{{:,}}', {0} // 100) || '.' || lpad(({0} % 100)::VARCHAR, 2, '0')"
scalar(
    "h35_money", "line", {"x": "CASE WHEN f = 7 THEN NULL ELSE c END", "known": "CASE WHEN f = 6 THEN CAST(0 AS BIGINT) ELSE c END", "unknown": "k - 1"},
    {"shown": (lambda: readers.money(F.col("x")), f"CASE WHEN f = 7 THEN 'unknown' ELSE {MONEY_SQL.format('c')} END"), "cost": (lambda: readers.cost_view(F.col("known"), F.col("unknown")), f"CASE WHEN unknown = 0 THEN {MONEY_SQL.format('known')} WHEN known = 0 THEN 'unknown — ' || unknown || ' unpriced' ELSE {MONEY_SQL.format('known')} || ' known + ' || unknown || ' unpriced' END")},
    "Money as text, and what a sum with unknown parts says.",
)
scalar("h36_image_type", "part", {"t": case("'FFD8FFE0'", "'89504E470D0A1A0A00'", "'474946383961FF'", "'524946460000000057454250'", "'52494646'", other="'00'")}, {"kind": (lambda: readers.image_type(F.unhex("t")), case("'image/jpeg'", "'image/png'", "'image/gif'", "'image/webp'"))}, "Kinds of images by their first bytes.")
scalar(
    "k17_decision_problem", "part", {"n": "CASE f WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE p_name END", "a": "CASE f WHEN 2 THEN 'some' ELSE q || ' 1/2' END", "u": "CASE f WHEN 3 THEN 'clove' ELSE 'cups' END"},
    {"problem": (lambda: F.when(F.coalesce(F.trim("n"), F.lit("")) == "", "name").when(amounts.parsed_amount(F.col("a")).isNull(), "amount").when(units.dimension(F.col("u")).isNull(), "unit"), case("'name'", "'name'", "'amount'", "'unit'"))},
    "What is wrong with a reviewed line.",
)
scalar(
    "h38_sql_scalars", "customer", {"s": "c_name"},
    {
        "low": (lambda: F.lower("s"), "lower(s)"), "part": (lambda: F.split_part(F.col("s"), F.lit("#"), F.lit(2)), "split_part(s, '#', 2)"), "place": (lambda: F.locate("#", F.col("s")), integer("position('#' IN s)")), "size": (lambda: F.octet_length("s"), integer("strlen(s)")),
        "none": (lambda: F.nullif(F.substring("s", 1, 1), F.lit("C")), "nullif(left(s, 1), 'C')"), "digest": (lambda: F.md5("s"), "md5(s)"), "most": (lambda: F.greatest(F.col("c_custkey"), F.length("s").cast("long")), "greatest(c_custkey, length(s))"),
    },
    "The scalar functions of SQL that are in use.",
)


LINES = case("q || ' cups ' || p_name || ', sifted'", "q || '-' || (q + 1) || ' ' || p_name", "q || ' (15 oz) cans ' || p_name", "q || ' lb 4 oz ' || p_name", "'a small handful of ' || p_name", "q || ' quarts ' || p_name || ' (warm), strained'", "p_name || ' for garnish'", "q || ' cloves ' || p_name || ' or garlic'")


def j04_ingredient_lines(spark, d):
    """Lines made of every part, taken apart: amount, unit, name, note, and whether a person has to look."""
    rows = _rows(spark, d, "part", BASES["part"][2]).repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # small rows with much work, in few splits
    df = rows.withColumn("line", F.expr(LINES))
    return read_lines(df.select("p_partkey", "line"), "line").select("p_partkey", "quantity", "unit", "name", "note", "status", "reason")


QUERIES["j04_ingredient_lines"] = j04_ingredient_lines
ORACLES["j04_ingredient_lines"] = f"""SELECT p_partkey, {case("q || ''", "NULL", "(q * 15) || ''", "NULL", "NULL", "(q * 4) || ''", "NULL", "q || ''")} AS quantity, {case("'cup'", "'each'", "'oz'", "NULL", "NULL", "'cup'", "NULL", "'each'")} AS unit,
{case("n", "n", "n", "n", "n", "n", "n", "''")} AS name, {case("CASE WHEN big = '' THEN 'sifted' ELSE big || '; sifted' END", "nullif(big, '')", "nullif(big, '')", "nullif(big, '')", "nullif(big, '')", "CASE WHEN big = '' THEN 'warm; strained' ELSE big || '; warm; strained' END", "CASE WHEN big = '' THEN 'for garnish' ELSE big || '; for garnish' END", "nullif(big, '')")} AS note,
{case("'parsed'", "'requires_review'", "'parsed'", "'requires_review'", "'requires_review'", "'parsed'", "'requires_review'", "'requires_review'")} AS status,
{case("NULL", "'The recipe gives a range'", "NULL", "'The amount has two parts'", "'No fixed amount'", "NULL", "'No amount given (for garnish)'", "'Choose one'")} AS reason
FROM (SELECT *, CASE WHEN split_part(p_name, ' ', 1) IN ('small', 'large', 'medium') THEN split_part(p_name, ' ', 1) ELSE '' END AS big, CASE WHEN split_part(p_name, ' ', 1) IN ('small', 'large', 'medium') THEN substr(p_name, position(' ' IN p_name) + 1) ELSE p_name END AS n FROM ({BASES["part"][2]}))"""
