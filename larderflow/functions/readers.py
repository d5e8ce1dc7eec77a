"""Readers of the short texts that shops, recipe pages and nutrition tables use, as column expressions; what is ambiguous is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larderflow.functions.amounts import GLYPHS, let
from larderflow.functions.streams import parts, spoken, tokens

# Units on labels -> (unit, how many of it). A bare "oz" may be weight or volume and is not among them.
LABEL_UNITS = {
    "fl oz": ("fl_oz", "1"), "fl. oz": ("fl_oz", "1"), "fl oz.": ("fl_oz", "1"), "floz": ("fl_oz", "1"), "fluid ounce": ("fl_oz", "1"), "fluid ounces": ("fl_oz", "1"),
    "lb": ("lb", "1"), "lbs": ("lb", "1"), "pound": ("lb", "1"), "pounds": ("lb", "1"), "g": ("g", "1"), "gram": ("g", "1"), "grams": ("g", "1"), "kg": ("kg", "1"),
    "ml": ("ml", "1"), "l": ("l", "1"), "liter": ("l", "1"), "liters": ("l", "1"), "litre": ("l", "1"), "gal": ("ml", "3785.411784"), "gallon": ("ml", "3785.411784"),
    "gallons": ("ml", "3785.411784"), "qt": ("ml", "946.352946"), "quart": ("ml", "946.352946"), "quarts": ("ml", "946.352946"), "pt": ("ml", "473.176473"),
    "pint": ("ml", "473.176473"), "pints": ("ml", "473.176473"), "ct": ("each", "1"), "count": ("each", "1"),
}
# Units of a delivery service's lists; a fluid ounce has none.
LIST_UNITS = {"g": "g", "kg": "kg", "oz": "oz", "lb": "lb", "ml": "ml", "l": "l", "tsp": "tsp", "tbsp": "tablespoon", "cup": "cup", "each": "each"}
# Words that tell a food's form.
COOKED = "cooked|roasted|boiled|baked|grilled|fried|braised|stewed|steamed|broiled|microwaved|sauteed|sautéed|poached|toasted"
# Words that only describe ordinary salt or pepper, that describe nothing, that mark table pepper, and units in which a pepper is bought.
DESCRIBING = "kosher sea fine finely flaky flake table coarse coarsely iodized ground freshly fresh cracked black and & plus or to taste as needed for seasoning season more some a pinch of salt pepper".split()
NEUTRAL = "divided optional about approximately approx adjust if desired extra generous little dash the an i use used tsp tsps teaspoon teaspoons tbsp tbsps tablespoon tablespoons g gram grams pinches dashes diamond crystal morton".split()
TABLE_PEPPER = "black ground cracked freshly salt".split()
BOUGHT = "each g kg oz lb".split()

LONGEST_MINUTES = 30 * 24 * 60
#: What the grammar of ISO 8601 allows from days to seconds.
DURATION = r"^P(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d{1,3})?S)?)?$"


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def plain_decimal(value: Column) -> Column:
    """Decimal text without zeros at the end or an exponent."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def package_size(text: Column) -> Column:
    """struct(quantity, unit) of a label's size, "2 lb" or "1/2 gallon"; null for several numbers, ranges, "about", a bare "oz" and unknown units."""
    t = F.lower(F.array_join(F.split(F.trim(text), r"\s+"), " "))
    unit = F.trim(F.ltrim(t, F.lit("0123456789./ ")))
    figures = F.replace(F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(F.ltrim(t, F.lit("0123456789./ "))))), F.lit(" /"), F.lit("/"))
    return let(F.struct(F.split(F.replace(figures, F.lit("/ "), F.lit("/")), "/").alias("n"), F.rtrim(F.when(t == "each", "each").otherwise(unit), F.lit(". ")).alias("unit"), (t == "each").alias("alone")), _labelled)


def _labelled(x: Column) -> Column:
    whole = F.forall(x["n"], lambda n: n.rlike(r"^\d+$")) & (F.size(x["n"]) == 2)
    top, bottom = F.try_element_at(x["n"], F.lit(1)).try_cast("decimal(24,10)"), F.try_element_at(x["n"], F.lit(2)).try_cast("decimal(10,0)")
    split = F.try_divide(top.cast("decimal(20,6)"), bottom).cast("decimal(26,12)")
    single = (F.size(x["n"]) == 1) & F.try_element_at(x["n"], F.lit(1)).rlike(r"^\d+(\.\d+)?$")
    # a fraction that doesn't end within six places is no size
    q = F.when(x["alone"], F.lit(1).cast("decimal(24,10)")).when(single, top).when(whole & (F.round(split, 6) == split), split.cast("decimal(24,10)"))
    units = LABEL_UNITS | {"each": ("each", "1"), "ea": ("each", "1")}
    one, times = (lookup({k: v[i] for k, v in units.items()}, x["unit"]) for i in (0, 1))
    counted = ~x["unit"].isin("each", "ea") | (q == 1)
    return F.when((q > 0) & one.isNotNull() & counted, F.struct(plain_decimal(q.cast("decimal(20,8)") * times.cast("decimal(10,6)")).alias("quantity"), one.alias("unit")))


def sale_basis(sold_by: Column) -> Column:
    kind = F.lower(F.trim(sold_by))
    return F.when(kind.isin("unit", "weight"), kind).otherwise("unknown")


def duration_minutes(text: Column) -> Column:
    """Whole minutes of an ISO 8601 duration of days to seconds; null if malformed, empty or longer than 30 days."""
    t = F.upper(F.trim(text))
    field = lambda i: F.coalesce(F.rtrim(F.regexp_extract(t, DURATION, i), F.lit("DHMS")).try_cast("decimal(12,3)"), F.lit(0))
    seconds = field(1) * 86400 + field(3) * 3600 + field(4) * 60 + field(5)
    minutes = F.floor(seconds / 60 + F.lit("0.5").cast("decimal(2,1)")).cast("int")
    return F.when((F.length(text) <= 40) & t.rlike(DURATION) & t.rlike(r"\d") & ~t.endswith("T") & (minutes <= LONGEST_MINUTES), minutes)


BULLETS = "•·*#-–\t "
FIGURES = "0123456789" + "".join(GLYPHS)


def heading_words(raw: Column) -> Column:
    """The words of a line without its bullets and stars."""
    return F.filter(F.split(F.trim(F.rtrim(F.ltrim(raw, F.lit(BULLETS)), F.lit("*_"))), r"\s+"), lambda w: w != "")


def is_heading(raw: Column, has_amount: Column) -> Column:
    """Whether a line without any amount heads a group: it ends with a colon or begins with "For the"."""

    def told(words: Column) -> Column:
        text = F.array_join(words, " ")
        ends = F.endswith(text, F.lit(":"))
        named = F.when(ends, F.length(text) > 1).otherwise((F.lower(F.array_join(F.slice(words, 1, 2), " ")) == "for the") & (F.size(words) > 2))
        return (F.length(text).between(1, 80)) & ~has_amount & (F.translate(text, FIGURES, "") == text) & (F.upper(text) != F.lower(text)) & named

    return let(heading_words(raw), told)


def heading_name(raw: Column) -> Column:
    """What a heading names: without its colon and a leading "for" or "for the", capitals only at its start where all were, 60 characters at most."""

    def named(words: Column) -> Column:
        low = F.transform(F.slice(words, 1, 2), F.lower)
        skipped = F.when((F.array_join(low, " ") == "for the") & (F.size(words) > 2), 2).when((F.try_element_at(low, F.lit(1)) == "for") & (F.size(words) > 1), 1).otherwise(0)
        text = F.array_join(F.slice(words, skipped + 1, F.size(words)), " ")
        calm = F.when(F.upper(text) == text, F.lower(text)).otherwise(text)
        return F.substring(F.concat(F.upper(F.substring(calm, 1, 1)), F.substring(calm, F.lit(2), F.lit(80))), 1, 60)

    trimmed = F.transform(F.array(F.rtrim(F.trim(F.array_join(heading_words(raw), " ")), F.lit(": "))), lambda t: F.filter(F.split(t, " "), lambda w: w != ""))[0]
    return let(trimmed, named)


def title_from_url(url: Column) -> Column:
    """A name from the last part of a link's path; null if that says nothing."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1), r"/+$", "")
    last = F.try_url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit(" ")))
    words = F.trim(F.regexp_replace(F.regexp_replace(last, r"(?i)\.(html?|php|aspx?)$", ""), r"[-_+\s]+", " "))
    good = words.rlike(r"(?i)[a-z]{3}") & ~words.rlike(r"^\d+$") & (F.length(words) <= 120)
    return F.when(good, F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, F.lit(2), F.length(words)))))


def form_hint(description: Column) -> Column:
    """raw or cooked, if the description says one of them and not the other."""
    raw, cooked = description.rlike(r"(?i)\braw\b"), description.rlike(rf"(?i)\b({COOKED})\b")
    return F.when(raw & ~cooked, "raw").when(cooked & ~raw, "cooked")


def normalized_form(form: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(form, F.lit("raw")))), r"[\s-]+", "_")
    return F.when(t == "", "raw").otherwise(t)


def decimal_of(text: Column) -> Column:
    """Plain decimal text of a number's text, with or without an exponent; else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), plain_decimal(t.try_cast("decimal(38,18)")))


def decimal_key(text: Column) -> Column:
    """One spelling for each decimal: no zeros before or after; other texts stay."""
    t = F.trim(text)
    key = F.regexp_replace(F.regexp_replace(t, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), F.when(F.contains(t, F.lit(".")), F.regexp_replace(key, r"\.$", "")).otherwise(F.regexp_replace(t, r"^0+(?=\d)", ""))).otherwise(t)


def dollars_to_cents(text: Column) -> Column:
    """Whole cents of a positive amount with at most two places (zeros beyond them don't count); null otherwise. The text decides: nothing is rounded."""
    t = F.trim(text)
    number = t.rlike(r"^\d{1,16}(\.\d+)?([eE][-+]?\d{1,2})?$")
    exact = F.when(number, t.try_cast("decimal(38,18)"))
    fits = F.length(F.regexp_replace(F.substring_index(F.when(t.rlike("[.]"), t), ".", -1), r"0*([eE].*)?$", "")) <= 16
    cents = exact * 100
    return F.when((exact > 0) & F.coalesce(fits, F.lit(True)) & (cents == F.floor(cents)), cents.cast("long"))


def list_unit(unit: Column) -> Column:
    return lookup(LIST_UNITS, unit)


def money(cents: Column) -> Column:
    """Dollars with thousands marked; "unknown" for null."""
    shown = F.format_number(F.abs(cents).cast("decimal(20,0)") / 100, 2)
    return F.when(cents.isNull(), "unknown").otherwise(F.concat(F.when(cents < 0, "-$").otherwise("$"), shown))


def cost_view(known: Column, unknown: Column) -> Column:
    """What a sum with unknown parts says: the sum, nothing, or what is known and how many are not."""
    rest = F.concat(unknown.cast("string"), F.lit(" unpriced"))
    return F.when(unknown == 0, money(known)).when(known == 0, F.concat(F.lit("unknown — "), rest)).otherwise(F.concat(money(known), F.lit(" known + "), rest))


def image_type(data: Column) -> Column:
    """The kind of an image, by its first bytes; null for others."""
    h = F.hex(F.substring(data, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.startswith("52494646") & h.endswith("57454250") & (F.length(h) == 24), "image/webp")
    )


# seasonings: every word of a line has a class


def word_class(word: Column) -> Column:
    """base (salt, pepper), plain (says nothing of which salt or pepper it is), figure, or other."""
    return F.when(word.isin("salt", "pepper"), "base").when(word.isin(*DESCRIBING, *NEUTRAL), "plain").when(F.translate(word, FIGURES + "/.-", "") == "", "figure").otherwise("other")


def said_words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "(),;:.!", "       "), r"\s+"), lambda w: w != "")


def before_for(words: Column) -> Column:
    """What "for ..." says is a purpose, not a kind."""
    at = F.array_position(words, "for").cast("int")
    return F.when(at > 0, F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(words)


def is_seasoning(name: Column, unit: Column, note: Column) -> Column:
    """Whether this is the ordinary salt or pepper that every household has: its name holds no other word, and neither do its asides, what follows its comma, or
    the note beside it, figures aside. A pepper that nothing calls black, ground or the like is a vegetable where it is bought by count or weight."""
    beside = F.split(F.coalesce(note, F.lit("")), "[;,()]")

    def told(p: Column) -> Column:
        own, tail = said_words(spoken(p["name"])), F.split(spoken(p["tail"]), "[;,()]")
        others = F.transform(F.concat(p["asides"], F.array(spoken(p["aside"])), tail, beside), lambda x: before_for(said_words(x)))
        every = F.concat(own, said_words(note), said_words(F.array_join(p["asides"], " ")), said_words(spoken(p["aside"])), said_words(spoken(p["tail"])))
        return let(F.struct(own.alias("own"), F.flatten(others).alias("others"), every.alias("every")), ordinary)

    def ordinary(w: Column) -> Column:
        salt, pepper = F.array_contains(w["own"], "salt"), F.array_contains(w["own"], "pepper")
        only = F.forall(w["own"], lambda x: word_class(x).isin("base", "plain")) & F.forall(w["others"], lambda x: word_class(x) != "other")
        vegetable = pepper & ~F.arrays_overlap(w["every"], F.array(*[F.lit(x) for x in TABLE_PEPPER])) & F.coalesce(unit.isin(*BOUGHT), F.lit(False))
        black_salt = F.array_contains(w["every"], "black") & ~pepper
        return F.size(w["own"]).between(1, 10) & (salt | pepper) & only & ~vegetable & ~black_salt

    return let(parts(tokens(F.coalesce(name, F.lit("")))), told)
