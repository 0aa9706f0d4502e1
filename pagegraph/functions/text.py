"""Wiki markup and HTML as column functions: chains of regular expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISABLED = r"(?is)<!--.*?-->|<(nowiki|pre|source|gallery|math|includeonly)\b[^>]*>.*?</\1\s*>"


def chain(t: Column, *rules: tuple[str, str]) -> Column:
    for pattern, new in rules:
        t = F.regexp_replace(t, pattern, new)
    return t


def strip_disabled(t: Column) -> Column:
    """Without comments and what nowiki, pre, source, gallery, math and includeonly enclose."""
    return F.regexp_replace(t, DISABLED, "")


def wikilinks(t: Column) -> Column:
    """array<struct<target, label, tail>> of [[target|label]]tail."""
    whole = F.regexp_extract_all(t, F.lit(r"\[\[[^\[\]\n]+\]\][a-z]*"), 0)

    def part(x, i):
        return F.regexp_extract(x, r"^\[\[([^|\]]*)\|?([^\]]*)\]\]([a-z]*)$", i)

    return F.transform(whole, lambda x: F.struct(F.trim(part(x, 1)).alias("target"), F.when(part(x, 2) == "", part(x, 1)).otherwise(part(x, 2)).alias("label"), part(x, 3).alias("tail")))


def simplify_links(t: Column) -> Column:
    """[[A|A]] to [[A]], [[A|AB]] to [[A]]B, underscores in targets to spaces."""

    def spaced(piece: Column, i: Column) -> Column:
        target = F.regexp_extract(piece, r"^([^\[\]|\n]*)[|\]]", 1)
        return F.when(i == 0, piece).otherwise(F.concat(F.replace(target, F.lit("_"), F.lit(" ")), F.substring(piece, F.length(target) + 1, F.lit(1 << 30))))

    t = F.array_join(F.transform(F.split(t, r"\[\["), spaced), "[[")
    return F.regexp_replace(t, r"\[\[\s*([^\[\]|\n]+?)\s*\|\s*\1(\p{Alpha}*)\s*\]\]", "[[$1]]$2")


def internal_links(t: Column, site: str = r"[a-z-]+\.wikipedia\.org") -> Column:
    """[https://site/wiki/Title label] to [[Title|label]]."""
    t = F.regexp_replace(t, rf"\[https?://{site}/wiki/([^\s\]?#]+)\s+([^\]\n]+)\]", "[[$1|$2]]")
    return F.regexp_replace(t, rf"\[https?://{site}/wiki/([^\s\]?#]+)\]", "[[$1]]")


def url_repairs(t: Column) -> Column:
    """Double schemes, doubled brackets around links and a bar instead of the blank."""
    return chain(t, (r"(?i)\b(https?)://(?:https?:/*)+", "$1://"), (r"\[\[(https?://[^\s\]]+)([^\]]*)\]\]", "[$1$2]"), (r"\[(https?://[^\s\]|]+)\|", "[$1 "))


def citation_repairs(t: Column) -> Column:
    """Parameter names, access dates and doubled bars in citation templates."""
    return chain(t, (r"(?i)\|\s*access-?date\s*=\s*", "|access-date="), (r"(?i)\|\s*archive-?url\s*=\s*", "|archive-url="), (r"(?i)\|\s*archive-?date\s*=\s*", "|archive-date="), (r"\|\s*(?=\||\}\})", ""), (r"\b(\d{4})-(\d)-(\d{2})\b", "$1-0$2-$3"))


def reference_repairs(t: Column) -> Column:
    """Quoted names, empty references, punctuation before references, blanks before them."""
    return chain(t, (r"<ref\s+name\s*=\s*([^\s\"'>/]+)\s*(/?)>", "<ref name=\"$1\"$2>"), (r"(?is)<ref>\s*</ref>", ""), (r"\s+(<ref\b)", "$1"), (r"(<ref\b[^>]*/>|<ref\b[^>/]*>[^<]*</ref>)([.,;])", "$2$1"))


#: A reference with content, or one by name; what stands in it is no tag of a reference.
_INSIDE = r"[^<]*+(?:<(?!/?ref\b)[^<]*+)*+"
_REFERENCE = rf"(?:<ref\b[^<>]*/>|<ref\b[^<>/]*>{_INSIDE}</ref>)"


def reference_cleanup(t: Column) -> Column:
    """References in one style, and punctuation before them where a text has it there more often than behind.

    Tags and name= in small letters without blanks; no stray punctuation at a template that is all of a
    reference; missing schemes; two links in one reference apart; links in <sup> as references; no empty
    references. Then punctuation goes before a run of references and stands once, references
    have no blanks between them, and one blank before a word or bracket that follows.
    """
    t = chain(
        t, (r"<(?i:ref)\b([^<>]*)>", "<ref$1>"), (r"</(?i:ref)\s*>", "</ref>"), (r"<ref\s+(?i:name)\s*=\s*\"", "<ref name=\""), (r"(<ref\b[^<>/]*>\s*)[,.?:;~!]+\s*(?=\{\{)", "$1"), (r"(\{\{[^{}]{40,}\}\})\s*[,.?:;~!]+(?=\s*</ref>)", "$1"),
        (r"<ref>\s*([a-z0-9\-.]*[a-z0-9\-]\.[a-z.]{2,6}/[^\]\[<>\s\"]+)\s*</ref>", "<ref>http://$1</ref>"), (r"<ref>\s*\[?(?:http://)?([a-z0-9\-.]*[a-z0-9\-]\.[a-z.]{2,6}/[^\]\[<>\s\"|]+) +([^\]\[{|}<>\n/]+?)\]?\s*</ref>", "<ref>[http://$1 $2]</ref>"),
        (r"<ref>\s*(\[\w+://[^\]\[<>\"\s]+\s*\])\s*(\[\w+://[^\]\[<>\"\s]+\s*\])\s*</ref>", "<ref>$1</ref><ref>$2</ref>"), (r"(?i)<sup *>\s*\[(\w+://[^\]\[<>\"\s]+) *\]\s*</sup>", "<ref>$1</ref>"), (r"<ref> *</ref>", ""),
    )
    before, behind = F.regexp_count(t, F.lit(r"[.,;:]\s?<ref")), F.regexp_count(t, F.lit(rf"{_REFERENCE} ?[.,;:]"))
    moved = chain(
        t, (rf"(?<=[\w\")\]]) *(({_REFERENCE}\s?)*{_REFERENCE}) ?([.,;:])(?![.,;:])", "$3$1"), (rf"([.,;:])(\"?(?:{_REFERENCE}\s?)*{_REFERENCE}) ?\1(?![.,;:])", "$1$2"),
        (rf"({_REFERENCE}) +(?=<ref\b)", "$1"), (rf"({_REFERENCE})(?=[\w(\[])", "$1 "),
    )
    return F.when(before > behind, moved).otherwise(t)


def bare_references(t: Column) -> Column:
    """URLs of references that hold a URL only."""
    return F.regexp_extract_all(t, F.lit(r"(?i)<ref(?:\s[^>]*)?>\s*\[?(https?://[^\s\]<]+)\]?\s*</ref>"), 1)


def lacks_references(t: Column) -> Column:
    """References without a place where they are listed."""
    plain = strip_disabled(t)
    return plain.rlike("(?i)<ref[ >]") & ~plain.rlike(r"(?i)<references|\{\{\s*(?:reflist|refs|references)")


def html_title(html: Column) -> Column:
    """The page title outside scripts, styles and comments, blanks collapsed; null where there is none."""
    clean = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    raw = F.regexp_extract(clean, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.when(F.trim(raw) != "", F.trim(F.regexp_replace(raw, r"\s+", " ")))


def bad_title(title: Column) -> Column:
    """Titles of error, login and placeholder pages."""
    return title.isNull() | title.rlike(r"(?i)\b(?:404|not found|untitled|error|log ?in|sign ?in|access denied|page unavailable|under construction|forbidden)\b")


#: Addresses of error pages and of a site's root.
_ERROR_PAGE = r"(?i)\D404(?:\D|\z)|error|errdoc|Not.{0,3}Found|sitedown|eventlog"
_ROOT = r"(?i)^\w+://[^/]+/(?:(?:default|index)\.(?:asp|aspx|cgi|htm|html|phtml|mpx|mspx|php|shtml|var))?$"


def redirect_fault(link: Column, final: Column) -> Column:
    """Why the end of a link's redirects on its own site is not the page meant: error page or root; else null."""

    def site(u):
        return F.regexp_extract(u, r"^(?:\w+)://(?:www\.|)([^/]+)", 1)

    moved = (link != final) & (site(link) == site(final))
    return F.when(moved & final.rlike(_ERROR_PAGE) & ~link.rlike(_ERROR_PAGE), "error page").when(moved & final.rlike(_ROOT) & ~link.rlike(_ROOT), "root")


def meta_fields(html: Column) -> Column:
    """array<struct<name, content>> of meta elements with a name or property."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0)
    parts = F.transform(tags, lambda x: F.struct(F.lower(F.regexp_extract(x, r"(?is)\b(?:name|property)\s*=\s*[\"']([^\"']*)", 1)).alias("name"), F.regexp_extract(x, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)", 1).alias("content")))
    return F.filter(parts, lambda p: p["name"] != "")


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)"), 1)


def headings(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>"), 1)


def images(html: Column) -> Column:
    """array<struct<src, alt, named>>; named: the alternative text is there and not the file's name."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), 0)

    def attribute(x, name):
        return F.regexp_extract(x, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)", 1)

    def one(x):
        src, alt = attribute(x, "src"), attribute(x, "alt")
        return F.struct(src.alias("src"), alt.alias("alt"), ((alt != "") & ~F.lower(src).contains(F.lower(alt))).alias("named"))

    return F.transform(tags, one)


#: Month names and weekdays as pages write them, and the forms of a date with the order of their groups.
_MONTH = "(January|February|March|April|May|June|July|August|September|October|November|December|jan|feb|mar|apr|may|june?|july?|aug|sept?|oct|nov|dec)"
_WEEKDAY = "(?:mon|tues?|wed|thur|fri|sat|sun|thurs?|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
_DAY, _PLAIN_DAY = (rf"({d}) *(?:st|nd|rd|th)?" for d in (r"0?[1-9]|[12]\d|3[01]", r"1?[3-9]|2\d|3[01]"))
_MON, _YEAR = "(0?[1-9]|1[012])", r"(19\d\d|20[0-2]\d)"
_DATES = (
    ("dmy", rf"{_DAY}[/\-.]{_MONTH}[/\-.]{_YEAR}\b"),
    ("dmy", rf"{_WEEKDAY}[.,]? +{_DAY} +{_MONTH}[.]? +{_YEAR}\b"),
    ("dmy", rf"{_DAY} +{_MONTH}[., ]+{_YEAR}\b"),
    ("mdy", rf"{_MONTH}[. ]+{_DAY}[., ]+{_YEAR}\b"),
    ("ydm", rf"(?<!\d){_YEAR}[/\-.]{_PLAIN_DAY}[/\-.]{_MON}\b"),
    ("ymd", rf"(?<!\d){_YEAR}[/\-.]{_MON}[/\-.]{_PLAIN_DAY}\b"),
    ("mdy", rf"(?<!\d){_MON}[/\-.]{_PLAIN_DAY}[/\-.]{_YEAR}\b"),
    ("dmy", rf"(?<!\d){_PLAIN_DAY}[/\-.]{_MON}[/\-.]{_YEAR}\b"),
    ("ymd", rf"(?<!\d){_YEAR}-{_MON}-{_DAY}\b"),
    ("ymd", rf"(?<!\d){_YEAR}{_MON}{_DAY}[01]\d[0-5]\d[0-5]\d\b"),
)


#: Where a text may hold a date: at the start of a word that begins one of the forms, up to six words on, as no form has more.
_SPOT = r"(?i)\b(?=(?:" + "|".join(re.sub(r"\((?!\?)", "(?:", p) for _, p in _DATES) + r"))(?=((?:\w+\W+){0,5}\w+.?))"


def only_date(t: Column, now: Column | None = None) -> Column:
    """The only distinct date of a text in any of ten forms, of 1900 to 2029, else null. Dates under four days old do not count; a day that its month lacks counts, but is no date.

    Texts without a year are passed over; of the others one pass finds the spots where any form
    begins, and the forms are told apart on those few words.
    """
    latest = (F.current_timestamp() if now is None else now) - F.expr("interval 96 hours")

    def one(spot, order, pattern):
        """The date that a spot begins with in one form, else null."""
        own = rf"(?i)^(?:{pattern})"
        y, m, d = (F.regexp_extract(spot, own, order.index(k) + 1) for k in "ymd")
        month = F.when(m.rlike("^[0-9]"), m).otherwise(((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.left(m, F.lit(3)))) + 2) / 3).cast("int").cast("string"))
        day = F.date_add(F.make_date(y.cast("int"), month.cast("int"), F.lit(1)), d.cast("int") - 1)
        found = F.when(day.cast("timestamp") < latest, F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(d, 2, "0")))
        return F.when(spot.rlike(own), found)

    spots = F.when(t.rlike(r"19\d\d|20[0-2]\d"), F.regexp_extract_all(t, F.lit(_SPOT), F.lit(1))).when(t.isNotNull(), F.array().cast("array<string>"))
    every = F.flatten(F.transform(spots, lambda x: F.array(*(one(x, order, pattern) for order, pattern in _DATES))))
    single = F.transform(F.array(every), lambda e: F.array_distinct(F.filter(e, lambda x: x.isNotNull())))  # in an array, so that what follows names it twice and it is found once
    return F.element_at(F.transform(single, lambda e: F.when(F.size(e) == 1, F.try_element_at(e, F.lit(1)).try_cast("date"))), 1)


def byline(t: Column) -> Column:
    """The name after `by` at a line's start, at most four capitalised words; null for staff and agencies."""
    name = F.regexp_extract(t, r"(?m)^\s*[Bb][Yy]:?\s+((?:\p{Lu}[\p{L}.'-]* ?){2,4})", 1)
    return F.when((F.trim(name) != "") & ~name.rlike(r"(?i)\b(?:staff|reporter|editor|admin|press|news|agency|correspondent)\b"), F.trim(name))


def publisher(host: Column, title: Column) -> Column:
    """The part of a title (split at bars and dashes) that shares a word with the host."""
    parts = F.transform(F.split(title, r"\s+[|–—-]\s+"), F.trim)
    fits = F.filter(parts, lambda p: host.contains(F.regexp_replace(F.lower(p), r"[^a-z0-9]", "")) & (F.length(p) > 2))
    return F.try_element_at(fits, F.lit(1))


def citation(url: Column, title: Column, published: Column, accessed: Column) -> Column:
    """A citation template of the fields that are not null."""

    def field(name, c):
        return F.when(c.isNotNull(), F.concat(F.lit(f"|{name}="), c.cast("string")))

    return F.concat(F.lit("{{cite web "), F.concat_ws(" ", field("url", url), field("title", title), field("date", published), field("access-date", accessed)), F.lit("}}"))


def dead_reference(url: Column, checked: Column) -> Column:
    return F.concat(F.lit("<ref>"), url, F.lit(" {{dead link|date="), F.date_format(checked, "MMMM yyyy"), F.lit("}}</ref>"))


def without_dead_links(t: Column) -> Column:
    """Dead-link tags once instead of repeatedly, and gone behind archived citations."""
    return chain(t, (r"(?i)(\{\{\s*dead link[^{}]*\}\})(?:\s*\{\{\s*dead link[^{}]*\}\})+", "$1"), (r"(?i)(archive-?url\s*=[^{}]*\}\})\s*\{\{\s*dead link[^{}]*\}\}", "$1"))


def style_repairs(t: Column) -> Column:
    """Headings without bold, one blank behind bullets, template aliases, trailing blanks."""
    return chain(t, (r"(?m)^(=+)\s*'''(.*?)'''\s*(=+)\s*$", "$1 $2 $3"), (r"(?m)^(=+)\s*([^=\n]+?)\s*=+\s*$", "$1 $2 $1"), (r"(?m)^(\*+)\s*(?=\S)", "$1 "), (r"(?i)\{\{\s*(?:disambig|dab)\s*\}\}", "{{Disambiguation}}"), (r"(?m)[ \t]+$", ""))


def with_section(t: Column, heading: str, body: Column) -> Column:
    """Adds a section before the first category link or at the end, unless the heading is there."""
    block = F.concat(F.lit(f"== {heading} ==\n"), body, F.lit("\n"))
    has = t.rlike(rf"(?m)^==\s*{heading}\s*==")
    split = F.regexp_replace(t, r"(?s)\[\[Category:.*$", "")
    tail = F.substring(t, F.length(split) + 1, F.lit(1 << 30))
    return F.when(has, t).otherwise(F.concat(F.regexp_replace(split, r"\s+$", ""), F.lit("\n\n"), block, tail))


def summary_links(t: Column) -> Column:
    """Edit summaries: /* section */ marks and links in HTML."""
    t = F.regexp_replace(t, r"/\*\s*(.*?)\s*\*/", "<span class=\"autocomment\">→$1</span>")
    t = F.regexp_replace(t, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "<a href=\"/wiki/$1\">$2</a>")
    return F.regexp_replace(t, r"\[\[([^\]|]+)\]\]", "<a href=\"/wiki/$1\">$1</a>")


def context(t: Column) -> Column:
    """Plain text of a line for display: no references, link targets, bold or tags."""
    return chain(t, (r"(?is)<ref\b[^>]*/>|<ref\b.*?</ref>", ""), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"'{2,}", ""), (r"<[^>]*>", ""), (r"\s+", " "))


def reference_rows(pages: DataFrame, key: str, text: str) -> DataFrame:
    """One row per reference with content: key, position, name, content."""
    refs = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<ref(?:\s[^>/]*)?>.*?</ref>"), 0)
    return pages.select(key, F.posexplode(refs).alias("position", "whole")).select(key, "position", F.regexp_extract("whole", r"(?is)<ref[^>]*?\bname\s*=\s*[\"']?([^\"'\s>/]+)", 1).alias("name"), F.trim(F.regexp_extract("whole", r"(?is)<ref[^>]*>(.*?)</ref>", 1)).alias("content"))


def reference_groups(refs: DataFrame, key: str) -> DataFrame:
    """Every reference with the name its content goes by: the first name given, else one made of its number; first: whether it keeps the content."""
    w = Window.partitionBy(key, "content")
    named = F.min(F.when(F.col("name") != "", F.struct("position", "name"))).over(w)["name"]
    first = F.min("position").over(w)
    return refs.select(key, "position", "content", F.coalesce(named, F.concat(F.lit("auto"), first.cast("string"))).alias("name"), F.count("*").over(w).alias("uses"), (F.col("position") == first).alias("first"))


def red_sentence(articles: Column, templates: Column, deletions: Column) -> Column:
    """What is known about a page that does not exist."""

    def count(n, one, many):
        return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))

    base = F.concat(F.lit("linked from "), count(articles, "article", "articles"))
    base = F.when(templates > 0, F.concat(base, F.lit(" and "), count(templates, "template", "templates"))).otherwise(base)
    return F.when(deletions > 0, F.concat(base, F.lit("; deleted "), count(deletions, "time", "times"))).otherwise(base)


def member_action(exists: Column, renamed: Column, edits: Column, blocked: Column, idle_days: Column) -> Column:
    """What a member list should do about a user."""
    return F.when(~exists, "remove").when(renamed.isNotNull(), "rename").when(blocked, "mark blocked").when(edits == 0, "zero edits").when(edits == 1, "single edit").when(idle_days > 365, "mark inactive").otherwise("keep")


def contains_phrase(t: Column, phrase: str) -> Column:
    """Whether the words of a phrase stand consecutively, whatever their case."""
    words = F.array_join(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")
    return F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(f" {' '.join(phrase.lower().split())} "))


def token_hits(docs: DataFrame, key: str, text: str, tokens: list[str]) -> DataFrame:
    """(key, hits): how many of the tokens a text holds; texts without any have no row."""
    wanted = F.array(*[F.lit(x.lower()) for x in tokens])
    own = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return docs.select(key, F.size(F.array_intersect(own, wanted)).cast("long").alias("hits")).where("hits > 0")


def claim_years(json: Column) -> Column:
    """struct(birth, death, description) of an item's JSON: the first claims of P569 and P570, in years."""
    kind = "claims struct<P569: array<struct<time: string>>, P570: array<struct<time: string>>>, description string"
    j = F.from_json(json, kind)

    def year(claims):
        return F.regexp_extract(F.try_element_at(claims, F.lit(1))["time"], r"^[+-]?(\d{4})", 1).try_cast("int")

    return F.struct(year(j["claims"]["P569"]).alias("birth"), year(j["claims"]["P570"]).alias("death"), j["description"].alias("description"))


def time_ago(then: Column, now: Column) -> Column:
    """5 seconds, 3 minutes, 2 hours or 9 days, whole units, at least zero."""
    s = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then))
    n = F.when(s < 60, s).when(s < 3600, F.floor(s / 60)).when(s < 86400, F.floor(s / 3600)).otherwise(F.floor(s / 86400)).cast("long")
    unit = F.when(s < 60, "second").when(s < 3600, "minute").when(s < 86400, "hour").otherwise("day")
    return F.concat(n.cast("string"), F.lit(" "), unit, F.when(n == 1, "").otherwise("s"))


def gradient(share: Column) -> Column:
    """A colour from red (0) over yellow to green (1)."""
    red, green = F.round(255 * F.least(F.lit(1.0), 2 - 2 * share)).cast("int"), F.round(255 * F.least(F.lit(1.0), 2 * share)).cast("int")
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(red)), 2, "0"), F.lpad(F.lower(F.hex(green)), 2, "0"), F.lit("00"))


def quoted(t: Column) -> Column:
    """A string literal for SQL or scripts: backslashes, quotes and line ends escaped."""
    return F.concat(F.lit("'"), chain(t, (r"\\", r"\\\\"), ("'", r"\\'"), ("\n", r"\\n")), F.lit("'"))


def long_comments(t: Column) -> Column:
    """Hidden comments of under 250 characters stay, longer ones go."""
    return F.regexp_replace(t, r"(?s)<!--(?:(?!-->).){250,}?-->", "")


#: Fixed value: how pages write a DOI that is no field.
_DOI = r"(?:doi:|=\s*\"|dx.doi.org/|hdl.handle.net/)(10\.[0-9]{4}/[\w\-.]{10,})(?=[<>\"\s]|[^\w.\-])"


def doi(html: Column) -> Column:
    """The DOI that a page gives in its citation_doi field, else the only one that stands in it; null without one or with several."""
    field = F.try_element_at(F.transform(F.filter(meta_fields(html), lambda p: (p["name"] == "citation_doi") & (p["content"] != "")), lambda p: p["content"]), F.lit(1))
    found = F.regexp_extract_all(html, F.lit(_DOI), F.lit(1))
    return F.coalesce(F.regexp_replace(field, r"^doi:\s*", ""), F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))))


def without_auto_sections(t: Column) -> Column:
    """Edit summaries without their section mark."""
    return F.trim(F.regexp_replace(t, r"/\*.*?\*/", ""))


def bypasses(link: Column, target: Column) -> Column:
    """Whether a redirect may be replaced by its target: equal names but for case, marks, a qualifier or one middle name."""

    def bare(t):
        return F.lower(F.regexp_replace(F.regexp_replace(t, r"[_ ]\([^)]*\)$", ""), r"[^\p{L}\p{N} _]", ""))

    a, b = F.replace(bare(link), F.lit("_"), F.lit(" ")), F.replace(bare(target), F.lit("_"), F.lit(" "))
    middle = F.regexp_replace(b, r"^(\S+) \S+ (\S+)$", "$1 $2")
    return (a == b) | ((a == middle) & (b != middle))
