"""Text functions: searches, digests of canonical JSON, slugs, links and plain text of pages."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote, unquote_plus, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderflow.functions.markup import plain


def matching(df: DataFrame, search: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined by spaces, hold every term of the search; terms are cut at white space, case is ignored."""
    hay = F.lower(F.concat_ws(" ", *columns))
    out = df
    for term in search.lower().split():
        out = out.filter(F.contains(hay, F.lit(term)))
    return out


def canonical(fields: dict[str, tuple[Column, str]]) -> Column:
    """Canonical JSON of an object: keys sorted, nulls kept. fields: key -> (column, "string", "number", "boolean" or "json")."""

    def value(column: Column, kind: str) -> Column:
        shown = column.cast("string")
        if kind == "string":
            shown = F.regexp_replace(F.to_json(F.array(column)), r"^\[|\]$", "")
        return F.coalesce(shown, F.lit("null"))

    parts = [F.concat(F.lit(f'"{name}":'), value(*fields[name])) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fingerprint(fields: dict[str, tuple[Column, str]]) -> Column:
    """SHA-256 of canonical()."""
    return F.sha2(canonical(fields), 256)


def domain(url: Column) -> Column:
    """Host in lower case, without `www.`, user or port; null where there is none."""
    host = F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    return F.regexp_replace(host, r"^www\.", "")


@F.pandas_udf(T.StringType())
def slug(text: pd.Series) -> pd.Series:
    """Lower case, decomposed, every other run of characters `_`, 60 at most."""

    def one(t):
        return None if t is None else re.sub(r"[^a-z0-9]+", "_", unicodedata.normalize("NFKD", t.lower())).strip("_")[:60]

    return text.map(one)


# Parameters that only track a visit (and all that begin with utm_), and names that never lead to a public site.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "_ga", "_gl", "yclid", "ref", "ref_src", "ck_subscriber_id", "epik", "si")
PRIVATE = ("local", "localhost", "internal", "home.arpa", "arpa", "test", "invalid", "onion", "lan", "localdomain", "intranet", "corp", "home", "example")
#: Characters of a link at most.
LONGEST = 2048
LABEL = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?")
TOP = re.compile(r"[a-z]{2,63}|xn--[a-z0-9-]{1,59}")


def public(host: str) -> bool:
    """Whether a host name may be one of a public site."""
    *labels, top = host.split(".")
    return bool(labels) and len(host) <= 253 and all(map(LABEL.fullmatch, labels)) and bool(TOP.fullmatch(top)) and not any(host == x or host.endswith("." + x) for x in PRIVATE)


LINK = T.StructType([T.StructField("ok", T.BooleanType()), *[T.StructField(c, T.StringType()) for c in ("code", "url", "key", "domain")]])


def tracks(pair: str) -> bool:
    name = unquote_plus(pair.partition("=")[0]).lower()
    return name.startswith("utm_") or name in TRACKING


def cleaned_link(raw: str | None) -> tuple:
    """(ok, code, url, key, domain) of one link."""
    refused = lambda code: (False, code, None, None, None)
    given = (raw or "").strip()
    if not given or re.search(r"[\x00-\x1f\x7f]", given):
        return refused("too_long" if len(given) > LONGEST else "invalid_url")
    if len(given) > LONGEST:
        return refused("too_long")
    try:
        at = urlsplit(given)
        port = at.port
    except ValueError:
        return refused("invalid_url")
    scheme = at.scheme.lower()
    if not scheme or (scheme in ("http", "https") and not at.netloc):
        return refused("invalid_url")
    if scheme not in ("http", "https"):
        return refused("unsupported_scheme")
    if at.username or at.password:
        return refused("credentials_in_url")
    host = (at.hostname or "").removesuffix(".")
    if not public(host):
        return refused("invalid_host")
    place = host if port in (None, 80 if scheme == "http" else 443) else f"{host}:{port}"
    path = quote(at.path, safe="/%:@!$&'()*+,;=-._~[]|^") or "/"
    pairs = [p for p in at.query.split("&") if p and not tracks(p)]
    query = "?" + quote("&".join(pairs), safe="/%:@!$&()*+,;=-._~?[]|^`{}") if pairs else ""
    url = f"{scheme}://{place}{path}{query}"
    if len(url) > LONGEST:
        return refused("too_long")
    named = sorted(((unquote_plus(n), unquote_plus(v)) for n, _, v in (p.partition("=") for p in pairs)), key=lambda x: x[0])
    key = place.removeprefix("www.") + (path.rstrip("/") or "/") + ("?" + urlencode(named, safe="*") if named else "")
    return True, "ok", url, key, host.removeprefix("www.")


@F.pandas_udf(LINK)
def link(urls: pd.Series) -> pd.DataFrame:
    """A saved link: refused with a code (invalid_url, too_long, unsupported_scheme, credentials_in_url, invalid_host), or without its fragment and its tracking
    parameters, the others as they were; key: what its variants (scheme, www., order of parameters, slashes at the end) have in common."""
    return pd.DataFrame([cleaned_link(u) for u in urls], columns=["ok", "code", "url", "key", "domain"])


def clean(column: Column | str) -> Column:
    """Plain text of markup, 2,000 characters at most; an empty text for one that holds nothing else."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNotNull(), F.coalesce(plain(c, 2_000), F.lit("")))
