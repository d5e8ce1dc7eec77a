"""Plain text of markup as column expressions: one linear scan each, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named entities that are read, and the characters that they stand for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ",
    "frac12": "½", "frac14": "¼", "frac34": "¾", "frac13": "⅓", "frac23": "⅔", "frac15": "⅕", "frac16": "⅙", "frac18": "⅛", "frac38": "⅜", "frac58": "⅝", "frac78": "⅞",
    "deg": "°", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "times": "×", "divide": "÷", "frasl": "⁄", "middot": "·", "bull": "•", "copy": "©", "reg": "®", "trade": "™", "cent": "¢", "pound": "£", "euro": "€",
    "eacute": "é", "egrave": "è", "ecirc": "ê", "euml": "ë", "aacute": "á", "agrave": "à", "acirc": "â", "auml": "ä", "aring": "å", "iacute": "í", "icirc": "î", "iuml": "ï",
    "oacute": "ó", "ocirc": "ô", "ouml": "ö", "uacute": "ú", "ucirc": "û", "uuml": "ü", "ntilde": "ñ", "ccedil": "ç", "szlig": "ß", "oslash": "ø", "aelig": "æ",
    "Eacute": "É", "Agrave": "À", "Ntilde": "Ñ", "Ccedil": "Ç", "Uuml": "Ü", "Ouml": "Ö", "Auml": "Ä",
}

KNOWN = ["'" + x.replace("'", "\\'") + "'" for pair in ENTITIES.items() for x in pair]

#: A tag opens where a letter, a slash, ! or ? follows; what never closes goes to the end. Scripts and styles go with what they hold.
TAG = r"(?is)<(script|style)(?![a-z])[^>]*+(?:>.*?(?:</\1[^>]*+(?:>|$)|$)|$)|<[a-z/!?][^>]*+(?:>|$)"
#: Control characters, zero-width ones and those that turn the direction of writing.
CONTROL = "[\\u0000-\\u001f\\u007f-\\u009f\\u200b-\\u200f\\u202a-\\u202e\\u2066-\\u2069\\ufeff]"
BLANK = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def without_tags(text: Column) -> Column:
    """Every tag becomes a space; a `<` before anything else stays."""
    return F.regexp_replace(text, TAG, " ")


def code_point(n: Column) -> Column:
    """The character of a code point; the replacement character for one that is none."""
    return F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("�")


def decoded(text: Column) -> Column:
    """Entities that end with a semicolon decoded: decimal, hexadecimal and those of ENTITIES; others stay."""
    names = F.expr(f"map({', '.join(KNOWN)})")

    def one(piece: Column, i: Column) -> Column:
        body = F.regexp_extract(piece, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,31});", 1)
        rest = F.substring(piece, F.length(body) + 2, F.length(piece))
        number = F.when(F.lower(F.substring(body, 2, 1)) == "x", F.conv(F.substring(body, F.lit(3), F.lit(6)), 16, 10)).otherwise(F.substring(body, F.lit(2), F.lit(7))).cast("bigint")
        known = F.when(F.startswith(body, F.lit("#")), code_point(number)).otherwise(F.try_element_at(names, body))
        return F.when(i == 0, piece).when((body == "") | known.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(known, rest))

    return F.array_join(F.transform(F.split(text, "&"), one), "")


def plain(text: Column, cap: int = 500) -> Column:
    """Tags out, entities decoded, tags out again (so that encoded markup doesn't come back), controls and white space to single spaces, `cap` characters at
    most; null where nothing is left. Reads no more than 20 times the cap."""
    # each step names the one before once: an expression in a lambda is evaluated as often as it is written
    bare = F.regexp_replace(F.regexp_replace(without_tags(decoded(without_tags(F.substring(text, 1, cap * 20)))), CONTROL, " "), BLANK, " ")
    return F.nullif(F.rtrim(F.substring(F.trim(bare), 1, cap)), F.lit(""))


def lines(text: Column) -> Column:
    """A text of several lines as an array: cut at line breaks, <br> and the ends of items, paragraphs and blocks."""
    return F.split(F.regexp_replace(text, r"(?i)<br\s*+/?>|</(?:li|p|div)>|(?=<li[\s>])", "\n"), "\r?\n")
