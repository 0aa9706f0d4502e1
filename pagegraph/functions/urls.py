"""URLs as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def reversed_host(url: Column) -> Column:
    """scheme://com.example.www./path, by which all pages of a domain sort together."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    turned = F.array_join(F.reverse(F.split(host(url), r"\.")), ".")
    return F.when(scheme != "", F.concat(F.lower(scheme), turned, F.lit("."), rest))


def query_parameters(url: Column) -> Column:
    """(key, value) structs of the query string, in order."""
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("value")))


def parameter(url: Column, name: str) -> Column:
    """The first value of a parameter, or null."""
    got = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(url.rlike(rf"[?&]{name}="), got)


def without_tracking(url: Column) -> Column:
    """Drops utm_*, fbclid, gclid and ref parameters."""
    t = F.regexp_replace(url, r"(?i)([?&])(?:utm_[a-z]+|fbclid|gclid|ref)=[^&#]*", "$1")
    t = F.regexp_replace(t, r"&&+", "&")
    t = F.regexp_replace(t, r"\?&+", "?")
    return F.regexp_replace(t, r"[?&]+(#|$)", "$1")


def repaired_scheme(url: Column) -> Column:
    """http://http://x and http:/x become http://x."""
    t = F.regexp_replace(url, r"(?i)^(?:https?:/*)+(https?):/*", "$1://")
    return F.regexp_replace(t, r"(?i)^(https?):/*(?=[^/])", "$1://")


def percent_encoded(text: Column) -> Column:
    """Every byte but letters, digits and _-.~ as %XX, of the whole text."""
    t = F.url_encode(text)
    for code, char in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return t


def percent_decoded(text: Column) -> Column:
    """%XX as bytes, a plus sign as itself; null where that is no text."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def encoded_title(title: Column) -> Column:
    """Percent-encoded with underscores, keeping : / ( ) and comma."""
    t = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, char in (("%3A", ":"), ("%2F", "/"), ("%28", "("), ("%29", ")"), ("%2C", ",")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return t


def anchor(text: Column) -> Column:
    """A section's anchor: underscores for blanks, and escapes with dots for percent signs."""
    t = F.url_encode(F.replace(text, F.lit(" "), F.lit("_")))
    for code, char in (("+", "%20"), ("*", "%2A"), ("%3A", ":"), ("%", ".")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return t


def unanchor(text: Column) -> Column:
    t = F.try_url_decode(F.regexp_replace(text, r"\.([0-9A-F]{2})", "%$1"))
    return F.replace(F.coalesce(t, text), F.lit("_"), F.lit(" "))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._]", "")


def like_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")
