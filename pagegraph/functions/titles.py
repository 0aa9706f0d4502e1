"""Titles, namespaces and database names as column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Namespace numbers and their English names.
NAMESPACES = {
    -2: "Media", -1: "Special", 0: "", 1: "Talk", 2: "User", 3: "User talk", 4: "Project", 5: "Project talk", 6: "File", 7: "File talk", 8: "MediaWiki", 9: "MediaWiki talk", 10: "Template", 11: "Template talk",
    12: "Help", 13: "Help talk", 14: "Category", 15: "Category talk", 100: "Portal", 101: "Portal talk", 118: "Draft", 119: "Draft talk",
}


def canonical_title(raw: Column, underscores: bool = False) -> Column:
    """Percent-decoded, entities decoded, direction marks dropped, cut at #, blanks collapsed, first letter upper.

    A plus sign is a plus sign.
    """
    t = decode_entities(percent_decoded(raw))
    t = F.regexp_replace(t, "[‎‏]", "")
    t = F.regexp_replace(t, "(?s)#.*$", "")
    t = F.regexp_replace(t, r"[_\s]+", " ")
    t = F.regexp_replace(t, r"^[: ]+|[: ]+$", "")
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))
    return F.replace(t, F.lit(" "), F.lit("_")) if underscores else t


def percent_decoded(raw: Column) -> Column:
    """Escapes as UTF-8, else as Latin-1; a text with a broken escape stays as it is."""
    safe = F.replace(raw, F.lit("+"), F.lit("%2B"))
    utf8 = F.try_url_decode(safe)
    wide = F.regexp_replace(safe, "(?i)%([89AB][0-9A-F])", "#2%$1")
    for high, low in (("C", "8"), ("D", "9"), ("E", "A"), ("F", "B")):
        wide = F.regexp_replace(wide, f"(?i)%{high}([0-9A-F])", f"#3%{low}$1")
    wide = F.regexp_replace(wide, "#([23])(?=%)", "%C$1")
    broken = F.contains(utf8, F.lit("\ufffd")) & ~F.contains(raw, F.lit("\ufffd"))
    return F.coalesce(F.when(broken, F.try_url_decode(wide)).otherwise(utf8), raw)


def decode_entities(t: Column) -> Column:
    """The five markup entities and the no-break space."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def encode_entities(t: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(char), F.lit(name))
    return t


def namespace_name(ns: Column) -> Column:
    """The name, or {ns:N} for unknown numbers."""
    out = F.concat(F.lit("{ns:"), ns.cast("string"), F.lit("}"))
    for n, name in NAMESPACES.items():
        out = F.when(ns == n, F.lit(name)).otherwise(out)
    return out


def full_title(ns: Column, title: Column) -> Column:
    name = namespace_name(ns)
    return F.when(name == "", title).otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit(":"), title))


def split_namespace(title: Column) -> Column:
    """struct(ns, rest): an unknown prefix belongs to the main namespace's title."""
    head = F.lower(F.replace(F.regexp_extract(title, r"^\s*([^:]*?)\s*:", 1), F.lit("_"), F.lit(" ")))
    ns = F.lit(0)
    for n, name in NAMESPACES.items():
        if name:
            ns = F.when(head == name.lower(), n).otherwise(ns)
    rest = F.regexp_replace(title, r"^[^:]*:[\s_]*", "")
    return F.struct(ns.alias("ns"), F.when(ns != 0, rest).otherwise(title).alias("rest"))


def talk_namespace(ns: Column) -> Column:
    """A subject's or talk page's talk namespace."""
    return ns.bitwiseOR(F.lit(1))


def subject_namespace(ns: Column) -> Column:
    return ns.bitwiseOR(F.lit(1)) - 1


def case_variants(title: Column) -> Column:
    """Distinct spellings to look up: as it is, lower, upper, capitalised words, first letter upper or lower."""
    first, rest = F.substring(title, 1, 1), F.substring(title, 2, 1 << 30)
    return F.array_sort(F.array_distinct(F.array(title, F.lower(title), F.upper(title), F.initcap(title), F.concat(F.upper(first), rest), F.concat(F.lower(first), rest))))


def without_qualifier(title: Column) -> Column:
    return F.substring_index(title, "_(", 1)


def title_regex(title: Column) -> Column:
    """A pattern for links to a title: either case of its first letter, spaces or underscores."""
    escaped = F.regexp_replace(title, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    first = F.substring(escaped, 1, 1)
    cls = F.when(first.rlike(r"\p{Alpha}"), F.concat(F.lit("["), F.upper(first), F.lower(first), F.lit("]"), F.substring(escaped, 2, 1 << 30))).otherwise(escaped)
    return F.regexp_replace(cls, "[ _]+", "[ _]+")


def sort_key(title: Column) -> Column:
    """Order by reversed suffix: last characters first, in upper case, years in brackets stripped."""
    return F.reverse(F.upper(F.regexp_replace(title, r"_\([0-9]{4}\)$", "")))


def natural_key(title: Column, width: int = 10) -> Column:
    """A sort key in which numbers compare by value: each is padded with zeros."""
    parts = F.regexp_extract_all(title, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def db_parts(dbname: Column) -> Column:
    """struct(language, family, host) of a database name such as dewiktionary_p."""
    name = F.regexp_replace(dbname, "_p$", "")
    family = F.regexp_extract(name, "(wiktionary|wikibooks|wikinews|wikiquote|wikisource|wikiversity|wikivoyage|wiki)$", 1)
    lang = F.replace(F.left(name, F.length(name) - F.length(family)), F.lit("_"), F.lit("-"))
    site = F.when(family == "wiki", "wikipedia").otherwise(family)
    special = lang.isin("commons", "meta", "species", "incubator")
    host = F.when(special, F.concat(lang, F.lit(".wikimedia.org"))).otherwise(F.concat(lang, F.lit("."), site, F.lit(".org")))
    return F.struct(lang.alias("language"), F.when(special, "wikimedia").otherwise(site).alias("family"), host.alias("host"))


_DIGITS62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def base62(number: Column) -> Column:
    """A positive number in digits 0-9a-zA-Z. Eleven digits hold every long, so they are written out and compiled."""
    n = number.cast("long")
    digits = [F.substring(F.lit(_DIGITS62), (F.call_function("div", n, F.lit(62**i)) % 62 + 1).cast("int"), F.lit(1)) for i in range(10, -1, -1)]
    return F.when(number == 0, "0").when(n > 0, F.ltrim(F.concat(*digits), F.lit("0"))).otherwise("")


def unbase62(text: Column) -> Column:
    """The number of such digits; eleven of them, as base62 writes them, without a loop."""
    digits = F.lit(_DIGITS62)
    padded = F.lpad(text, 11, "0")
    few = sum(((F.position(F.substring(padded, i, 1), digits) - 1).cast("long") * 62 ** (11 - i) for i in range(1, 12)), F.lit(0).cast("long"))
    places = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.position(F.substring(text, i, F.lit(1)), digits))
    return F.when(F.length(text) <= 11, few).otherwise(F.aggregate(places, F.lit(0).cast("long"), lambda a, c: a * 62 + c - 1))


def no_ping(name: Column) -> Column:
    """A name with dots at camel-case humps and for blanks, underscores and dashes, else one in its middle, so that it notifies nobody."""
    dotted = F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])|[ _-]+", ".")
    half = F.floor(F.length(name) / 2).cast("int")
    return F.when(dotted != name, dotted).otherwise(F.concat(F.substring(name, F.lit(1), half), F.lit("."), F.substring(name, half + 1, F.lit(1 << 30))))


#: What a loose comparison of titles ignores.
IGNORED_WORDS, IGNORED_CHARACTERS = (".com", "www.", "the", ".org"), "[]{}\\|'!,."


def loose_key(text: Column) -> Column:
    """A key for comparing titles that ignores case, some words, wherever they stand, and some punctuation."""
    t = F.lower(text)
    for word in IGNORED_WORDS:
        t = F.replace(t, F.lit(word), F.lit(""))
    return F.translate(t, IGNORED_CHARACTERS, "")


def _accents() -> tuple[str, str]:
    """Latin letters with accents, and the letters without."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without accents of Latin letters: equal for what an accent- and case-insensitive collation calls equal."""
    return F.translate(F.lower(text), *_accents())


#: Characters, titles of persons and spellings that title keys take for one another, in this order.
SUBSTITUTIONS = (
    ("−", "-"), ("–", "-"), ("—", "-"), ("…", "..."), ("×", "X"), ("“", '"'), ("”", '"'),
    (" -", "-"), ("- ", "-"), ("--", "-"), ("_", " "), ("`", "'"), ("/", "-"), ("*", "X"),
    (" DR. ", ""), (" MR. ", ""), (" MRS. ", ""), (" MS. ", ""), (" DR ", ""), (" MR ", ""), (" MRS ", ""), (" MS ", ""),
    ("AE", "A"), ("EY", "EI"), ("OH", "O"), ("OU", "O"), ("UU", "U"), (" 'N", " AN"), (" AND ", " & "), (" THE ", " "), (" OF ", " IN "), ("K", "C"),
)


def plain_key(title: Column, qualifier: bool = False) -> Column:
    """A key that spellings of a title share: upper case, no accents, substitutions made, no repeated letters and no punctuation; without its qualifier unless asked for."""
    t = F.replace(title, F.lit("_"), F.lit(" "))
    t = F.concat(F.lit(" "), F.upper(t if qualifier else F.regexp_replace(t, r"(?s) \(.*$", "")), F.lit(" "))
    t = F.translate(t, *_accents())
    for old, new in SUBSTITUTIONS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(t, r"(?s)(.)\1+", "$1"), "[ !\"',.:;?-]", "")


def prefixes(title: Column) -> Column:
    """Distinct prefixes to look a title up by: as it is, without its article, with either article, with `&` for `and` and the other way round."""
    bare = F.regexp_replace(title, "^(?:The|A)_", "")
    return F.array_distinct(F.array(title, bare, F.concat(F.lit("The_"), bare), F.concat(F.lit("A_"), bare), F.replace(bare, F.lit("_&_"), F.lit("_and_")), F.replace(bare, F.lit("_and_"), F.lit("_&_"))))


def calm_title(text: Column) -> Column:
    """Titles of over six letters with over 70 % capitals and no digits get capitalised words instead."""
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]", ""))
    return F.when((F.length(text) > 6) & ~text.rlike(r"\d") & (letters > 0) & (capitals > letters * 0.7), F.initcap(text)).otherwise(text)


def english_list(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    return (
        F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).when(n == 2, F.concat(F.element_at(items, 1), F.lit(" and "), F.element_at(items, 2)))
        .otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))
    )


def lifespan(births: Column, deaths: Column, living: Column, year: int) -> Column:
    """(1900–1980), (born 1950), (died 1980) or (1850–?) after 125 years."""
    b, d = births.cast("string"), deaths.cast("string")
    return (
        F.when(births.isNotNull() & deaths.isNotNull(), F.concat(F.lit("("), b, F.lit("–"), d, F.lit(")")))
        .when(births.isNotNull() & (living | (F.lit(year) - births <= 125)), F.concat(F.lit("(born "), b, F.lit(")")))
        .when(births.isNotNull(), F.concat(F.lit("("), b, F.lit("–?)"))).when(deaths.isNotNull(), F.concat(F.lit("(died "), d, F.lit(")"))).otherwise("")
    )


#: Categories that say something of a birth or a death other than its year; kinds of works whose year category is a debut.
_BIRTH_UNKNOWN = ("Year_of_birth_missing", "Year_of_birth_unknown", "Year_of_birth_uncertain")
_DEATH_UNKNOWN = ("Year_of_death_missing", "Year_of_death_unknown", "Year_of_death_uncertain")
_LIVING = ("Living_people", "Possibly_living_people")
_WORKS = (
    "albums", "architecture", "books", "films", "live_albums", "musicals", "novels", "operas", "plays", "poems", "short_stories", "EPs", "songs", "singles", "soundtracks", "television_episodes", "television_films", "video_games", "works", "manga", "anime",
    "paintings", "sculptures", "ships", "in_spaceflight", "audio_plays",
)


def allowed_title(title: Column, blacklist: list[str]) -> Column:
    """Whether a title is valid (no characters that titles lack, no empty or relative parts, at most 255 bytes) and fits none of some patterns."""
    bad = title.isNull() | (F.trim(title) == "") | title.rlike(r"[#<>\[\]{}|\x00-\x1F\x7F\uFFFD]") | title.rlike(r"^:|^\.{1,2}(?:/|$)|/\.{1,2}(?:/|$)|%[0-9A-Fa-f]{2}|&[#A-Za-z0-9]+;|~~~") | (F.octet_length(title) > 255)
    for pattern in blacklist:
        bad = bad | title.rlike(pattern)
    return ~F.coalesce(bad, F.lit(True))


def category_year(category: Column) -> Column:
    """The year, decade or century that a category begins with: 1867, 1860s, 2nd-century BC; null without one."""
    t = F.replace(category, F.lit("_"), F.lit(" "))
    pattern = r"^(\d+)(s(?= )|)((?:st|nd|rd|th)[ -]century|)( BC|)"
    return F.when(t.rlike(r"^\d"), F.regexp_extract(t, pattern, 0))


def year_range(birth: Column, death: Column) -> Column:
    """Years of a life: 1900–1980, born 1950, died 47 BC, 47 BC–12 AD; early years have an era. Empty is not known, as null is."""

    def part(c):
        return F.regexp_replace(c, "(?s) BC.*$", "")

    def era(c):
        return F.when(F.contains(c, F.lit(" BC")), " BC").when((part(c) == "?") | (F.length(part(c)) >= 3), "").otherwise(" AD")

    b, d = F.nullif(birth, F.lit("")), F.nullif(death, F.lit(""))
    same = (F.contains(b, F.lit(" BC")) == F.contains(d, F.lit(" BC"))) | (b == "?")  # an unknown year has no era of its own
    return (
        F.when(b.isNotNull() & d.isNull(), F.concat(F.lit("born "), part(b), era(b)))
        .when(b.isNotNull() & same, F.concat(part(b), F.lit("–"), part(d), era(d))).when(b.isNotNull(), F.concat(part(b), F.lit(" BC–"), part(d), F.when(d == "?", "").otherwise(" AD")))
        .when(d.isNotNull(), F.concat(F.lit("died "), part(d), era(d))).otherwise("")
    )


def category_lifespans(categorylinks: DataFrame, year: int) -> DataFrame:
    """(cl_from, birth, death, life, debut) of pages whose categories tell of a birth, a death or a work's year, as of a year.

    Of several categories of a kind the last by name counts; the years of debut categories are sorted.
    Births of 126 years ago and more, after 1600, have an unknown death; unknown years are left out
    where nothing known is beside them, and an unknown birth beside a death of over ten years ago.
    """
    c = F.col("cl_to")
    short = F.length(c) <= 12  # as long as 1570s_births
    born = F.when(c.endswith("_births") & short, category_year(c)).when(c.isin(*_BIRTH_UNKNOWN), "?")
    died = F.when(c.endswith("_deaths") & short, category_year(c)).when(c.isin(*_DEATH_UNKNOWN), "?").when(c.isin(*_LIVING), "")
    work = F.when(F.substring_index(c, "_", 1).rlike(r"^\d+$") & F.expr("substring(cl_to, locate('_', cl_to) + 1)").isin(*_WORKS), F.substring_index(c, "_", 1))
    told = categorylinks.select("cl_from", "cl_to", born.alias("b"), died.alias("d"), work.alias("w"), (c == "Missing_people").alias("m")).where("b is not null or d is not null or w is not null or m")
    last = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col("cl_to")))
    page = told.groupBy("cl_from").agg(last("b").alias("b"), last("d").alias("d"), F.bool_or("m").alias("m"), F.array_join(F.array_sort(F.collect_set("w")), " ").alias("debut"))
    page = page.withColumn("d", F.when(F.col("m") & F.col("d").isNull(), "").otherwise(F.col("d")))
    b, d = F.col("b"), F.col("d")
    number = b.try_cast("int")
    page = page.withColumn("d", F.when(b.rlike(r"^\d+$") & (number > 1600) & (number < year - 125) & (F.coalesce(d, F.lit("")) == ""), "?").otherwise(d))
    known = ~F.coalesce(d, F.lit("")).isin("", "?")
    long_ago = F.regexp_extract(d, r"^\d+", 0).try_cast("int") < year - 10
    none = (b == "?") & ~known
    page = page.withColumn("b2", F.when(none | ((b == "?") & known & ~F.contains(d, F.lit("BC")) & F.coalesce(long_ago, F.lit(False))), "").otherwise(b)).withColumn("d2", F.when(none, "").otherwise(d))
    page = page.withColumn("d2", F.when((F.coalesce("b2", F.lit("")) == "") & (F.col("d2") == "?"), "").otherwise(F.col("d2")))
    return page.select("cl_from", b.alias("birth"), d.alias("death"), year_range(F.col("b2"), F.col("d2")).alias("life"), "debut")
