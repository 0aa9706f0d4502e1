"""Markup queries over whole documents and pages into which markup was put.

The driver's texts hold no wiki markup, so rules put some into every document, in
Spark and in SQL alike; what a query returns differs from document to document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as H
from ..functions import text as T
from ..functions import titles as N
from ..session import table
from .base import Catalogue, rewritten, rewritten_sql

catalogue = Catalogue()
query = catalogue.query

#: Links of several forms, bold words, references with and without names, and bare ones.
LINKS = [
    (r"([ \n])([A-Z][a-z]+)([ ,.])", r"\1[[\2_of_all pages|\2s]]\3"), (r"([ \n])(th[a-z]+)([ ,.\n])", r"\1[[\2|\2]]\3"), (r" (an[a-z]*) ", r" [[\1|\1ly]] "),
    (r" (er[a-z]*) ", r" [[ \1_x_y ]]en "), (r" (o[a-z]*) ", r" '''\1''' "),
]
REFS = [(r", ([a-z])([a-z]*)", r", \1\2<ref>http://example.org/\1</ref>"), (r"\. \[\[([A-Z])", r".<ref name='n\1'>Book \1</ref> [[\1"), (r" (in[a-z]*) ", r" \1<ref>Book I</ref> ")]
MARKED = rewritten_sql("text", LINKS + REFS)


def marked(spark, d):
    """Whole documents with links and references."""
    return table(spark, d, "documents").select("doc_id", rewritten(F.col("text"), LINKS + REFS).alias("wikitext"))


@query(rf"""with l as (select doc_id, unnest(regexp_extract_all({MARKED}, '\[\[[^\[\]\n]+\]\][a-z]*')) as l from documents), p as (select doc_id, split_part(l, ']]', 1)[3:] as inside, split_part(l, ']]', 2) as tail from l)
select doc_id, trim(split_part(inside, '|', 1)) as target, case when contains(inside, '|') then split_part(inside, '|', 2) else inside end as label, tail from p""")
def wikilink_rows(spark, d):
    links = marked(spark, d).select("doc_id", F.explode(T.wikilinks(F.col("wikitext"))).alias("l"))
    return links.select("doc_id", "l.target", "l.label", "l.tail")


@query(rf"""with m as (select doc_id, {MARKED} as t from documents),
p as (select doc_id, string_split_regex(t, '\[\[[^\[\]\n]*\]\]') as parts, list_transform(regexp_extract_all(t, '\[\[[^\[\]\n]*\]\]'), lambda l: l[3:-3]) as links from m),
s as (select doc_id, parts, list_transform(links, lambda l: case when not contains(l, '|') then '[[' || replace(l, '_', ' ') || ']]'
  when starts_with(split_part(l, '|', 2), replace(split_part(l, '|', 1), '_', ' ')) then '[[' || replace(split_part(l, '|', 1), '_', ' ') || ']]' || split_part(l, '|', 2)[length(split_part(l, '|', 1)) + 1:]
  else '[[' || replace(split_part(l, '|', 1), '_', ' ') || '|' || split_part(l, '|', 2) || ']]' end) as links from p)
select doc_id, parts[1] || array_to_string(list_transform(range(1, len(parts)), lambda i: links[i] || parts[i + 1]), '') as simple from s""")
def link_simplify(spark, d):
    """Whole texts with simplified links."""
    return marked(spark, d).select("doc_id", T.simplify_links(F.col("wikitext")).alias("simple"))


@query(rf"""with r as (select doc_id, unnest(regexp_extract_all({MARKED}, '(?i)<ref[^>]*>[^<]*</ref>')) as r from documents), u as (select doc_id, regexp_extract(r, '>(http[^<]*)<', 1) as url from r)
select doc_id, url, cast(count(*) as bigint) as n from u where url <> '' group by doc_id, url""")
def bare_refs(spark, d):
    r = marked(spark, d).select("doc_id", F.explode(T.bare_references(F.col("wikitext"))).alias("url"))
    return r.groupBy("doc_id", "url").agg(F.count("*").alias("n"))


@query(rf"""with m as (select doc_id, regexp_extract_all({MARKED}, '(?i)<ref[^>]*>[^<]*</ref>') as rs from documents),
r as (select doc_id, cast(i - 1 as int) as position, regexp_extract(rs[i], '>([^<]*)<', 1) as content, nullif(regexp_extract(rs[i], 'name=''([^'']*)''', 1), '') as name from m, range(1, len(rs) + 1) as t(i)),
g as (select doc_id, content, min(position) as first, count(*) as uses, arg_min(name, position) filter (name is not null) as named from r group by doc_id, content)
select doc_id, position, content, coalesce(named, 'auto' || g.first) as name, cast(uses as bigint) as uses, position = g.first as first from r join g using (doc_id, content)""")
def ref_dedup(spark, d):
    """References by content; equal ones go by one name."""
    return T.reference_groups(T.reference_rows(marked(spark, d), "doc_id", "wikitext"), "doc_id")


@query()
def merged_references(spark, d):
    """Documents with repeated references merged."""
    return marked(spark, d).select("doc_id", H.merged_references()(F.col("wikitext")).alias("merged"))


#: References that come again and again, each with another source of a name and a number.
NAMED = [
    (r" (in[a-z]*) ", r" \1<ref>{{cite book| last =Whitmore|first=Ann|title=On \1 things|page=12|accessdate=2 May 2009}}</ref> "), (r" (of) ", r" \1<ref>By John Harker, in a long report for year 1987 about it</ref> "), (r" (and) ", r" \1<ref>[http://www.example-news.co.uk/a/b A long enough title], p. 77</ref> "),
    (r" (de) ", r" \1<ref>{{Harvnb|McCannon|1999|p=247|more text to make it long}}</ref> "), (r" (der) ", r" \1<ref>see Encyclopaedias about all things known, vol. xiv or more</ref> "), (r" (the) ", r" \1<ref>short</ref> "),
]


@query()
def named_references(spark, d):
    """Documents whose repeated references are named by what they hold and written once."""
    t = rewritten(F.col("text"), NAMED)
    return table(spark, d, "documents").select("doc_id", H.named_references()(t).alias("named"))


@query(rf"""with t as (select doc_id, {rewritten_sql("text", LINKS + REFS + [(r" (re[a-z]*) ", r" <i>\1</i>  ")])} as t from documents)
select doc_id, regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(t, '<ref[^>]*>[^<]*</ref>', '', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]*)\]\]', '\1', 'g'), '''''''', ''), '''''', ''), '</?i>', '', 'g'), '\s+', ' ', 'g') as shown from t""")
def context_display(spark, d):
    """Whole texts for display, without references, link targets, bold and tags."""
    t = rewritten(F.col("text"), LINKS + REFS + [(r" (re[a-z]*) ", r" <i>\1</i>  ")])
    return table(spark, d, "documents").select("doc_id", T.context(t).alias("shown"))


_PROTECTED = [(r" (of) ", r" <nowiki>\1 it of</nowiki> "), (r"([ \n])([A-Z][a-z]+) ", r"\1[[\2 the]] "), (r", ([a-z]+)", r",<!-- the \1 the --> \1")]


@query(rf"""with t as (select doc_id, {rewritten_sql("text", _PROTECTED)} as t from documents),
p as (select doc_id, string_split_regex(t, '<nowiki>.*?</nowiki>|\[\[[^\]]*\]\]|<!--.*?-->') as parts, regexp_extract_all(t, '<nowiki>.*?</nowiki>|\[\[[^\]]*\]\]|<!--.*?-->') as spans from t),
r as (select doc_id, list_transform(parts, lambda x: replace(x, 'the', 'THE')) as parts, spans from p)
select doc_id, parts[1] || array_to_string(list_transform(range(1, len(parts)), lambda i: spans[i] || parts[i + 1]), '') as replaced from r""")
def protected_replacement(spark, d):
    """A replacement outside protected spans, in whole texts."""
    t = rewritten(F.col("text"), _PROTECTED)
    return table(spark, d, "documents").select("doc_id", H.replace_except("the", "THE", ("nowiki", "link", "comment"))(t).alias("replaced"))


#: References as they are found, and as they should be; punctuation stands before most of them.
_UNTIDY = [
    (r" (la|is) ", r" \1.<Ref>Book A</REF> "), (r" (of) ", r' \1,<ref  Name = "b">c</ref>  <ref name= "b"/>'), (r" (the) ", r" \1<ref>www.example.org/a/b </ref>, k.<ref>x</ref> "), (r" (and) ", r" \1;<ref>example.org/x Some title</ref>; "), (r" (de) ", r" \1,<ref>[http://a.org/x] [http://b.org/y]</ref><ref> </ref> "),
    (r" (by) ", r" \1,<sup>[http://c.org/z ]</sup>("), (r" (en) ", r" \1,<ref>. {{cite web|url=http://example.org/a|title=A long title}}. </ref> "),
]
_TIDY = [
    (r" (la|is) ", r" \1.<ref>Book A</ref> "), (r" (of) ", r' \1,<ref name="b">c</ref><ref name="b"/>'), (r" (the) ", r" \1,<ref>http://www.example.org/a/b</ref> k.<ref>x</ref> "), (r" (and) ", r" \1;<ref>[http://example.org/x Some title]</ref> "), (r" (de) ", r" \1,<ref>[http://a.org/x]</ref><ref>[http://b.org/y]</ref> "),
    (r" (by) ", r" \1,<ref>http://c.org/z</ref> ("), (r" (en) ", r" \1,<ref>{{cite web|url=http://example.org/a|title=A long title}} </ref> "),
]


@query(rf"""with t as (select doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') || ' of x of y of z ' as t from documents) select doc_id, regexp_replace({rewritten_sql("t", _TIDY)}, '/>([A-Za-z])', '/> \1', 'g') as clean from t""")
def reference_cleanup(spark, d):
    """Words of whole texts with untidy references put in and tidied."""
    t = F.concat(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(" of x of y of z "))
    return table(spark, d, "documents").select("doc_id", T.reference_cleanup(rewritten(t, _UNTIDY)).alias("clean"))


_DEAD = [(r"\. ", ". {{dead link|date=May 2001}} {{Dead link}} "), (r", ", ", {{cite|archive-url=z}} {{dead link}} ")]
_LIVE = [(r"\. ", ". {{dead link|date=May 2001}} "), (r", ", ", {{cite|archive-url=z}} ")]


@query(rf"""select doc_id, {rewritten_sql("text", _LIVE)} as clean, '<ref>http://x.org/' || doc_id || ' {{{{dead link|date=' || strftime(date '2001-05-03' + cast(doc_id % 900 as int), '%B %Y') || '}}}}</ref>' as dead from documents""")
def dead_links(spark, d):
    """Dead-link tags once, none behind archived citations, and references for dead URLs."""
    checked = F.date_add(F.lit("2001-05-03").cast("date"), (F.col("doc_id") % 900).cast("int"))
    dead = T.dead_reference(F.concat(F.lit("http://x.org/"), F.col("doc_id").cast("string")), checked)
    return table(spark, d, "documents").select("doc_id", T.without_dead_links(rewritten(F.col("text"), _DEAD)).alias("clean"), dead.alias("dead"))


_CITED = [(r", ([a-z]+)", r", {{cite web|url=\1| accessdate = 2001-5-03||Archive-URL=q|}}"), (r"\. ([A-Z][a-z]+)", r". [[http://http://x.org/\1|\1]]"), (r" (the) ", r" \1 <ref name=a>x</ref>. <ref> </ref>")]
_REPAIRED = [(r", ([a-z]+)", r", {{cite web|url=\1|access-date=2001-05-03|archive-url=q}}"), (r"\. ([A-Z][a-z]+)", r". [http://x.org/\1 \1]"), (r" (the) ", ' \\1.<ref name="a">x</ref> ')]


@query(f"""select doc_id, {rewritten_sql("text", _REPAIRED)} as repaired from documents""")
def citation_cleanup(spark, d):
    """Citation parameters, URL and reference repairs in whole texts."""
    t = T.reference_repairs(T.url_repairs(T.citation_repairs(rewritten(F.col("text"), _CITED))))
    return table(spark, d, "documents").select("doc_id", t.alias("repaired"))


_OUTSIDE = [(r"([ \n])([A-Z][a-z]+) ([a-z]+)", r"\1[https://en.wikipedia.org/wiki/\2 \3]"), (r", ([a-z]+)", r", [https://de.wikipedia.org/wiki/\1]"), (r" (the) ", r" [http://other.org/wiki/\1 \1] ")]
_INSIDE = [(r"([ \n])([A-Z][a-z]+) ([a-z]+)", r"\1[[\2|\3]]"), (r", ([a-z]+)", r", [[\1]]"), (r" (the) ", r" [http://other.org/wiki/\1 \1] ")]


@query(f"select doc_id, {rewritten_sql('text', _INSIDE)} as internal from documents")
def external_to_internal(spark, d):
    return table(spark, d, "documents").select("doc_id", T.internal_links(rewritten(F.col("text"), _OUTSIDE)).alias("internal"))


_UNSTYLED = [(r"[=*{}]", ""), (r"[ \t]+\n", "\n"), (r"\. ([A-Z][a-z]+) ([a-z]+)", ".\n=='''\\1'''==\n*\\2 \t\n{{dab}}")]
_STYLED = [(r"[=*{}]", ""), (r"[ \t]+\n", "\n"), (r"\. ([A-Z][a-z]+) ([a-z]+)", ".\n== \\1 ==\n* \\2\n{{Disambiguation}}"), (r"[ \t]+$", "")]


@query(rf"""with s as (select doc_id, text, {rewritten_sql("text", _STYLED)} as styled from documents)
select doc_id, styled, case when doc_id % 3 = 0 then regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || '== See also ==' || chr(10) || 'X' || doc_id || chr(10) || '[[Category:X]]' when doc_id % 3 = 1 then regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || '== See also ==' || chr(10) || 'X' || doc_id || chr(10) else text || chr(10) || '== See also ==' || chr(10) || 'old' end as section from s""")
def style_and_sections(spark, d):
    """Headings, bullets and templates repaired, and a section put before the categories, at the end, or not where it is."""
    k = F.col("doc_id") % 3
    body = F.concat("text", F.when(k == 0, "\n[[Category:X]]").when(k == 1, "").otherwise("\n== See also ==\nold"))
    section = T.with_section(body, "See also", F.concat(F.lit("X"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", T.style_repairs(rewritten(F.col("text"), _UNSTYLED)).alias("styled"), section.alias("section"))


@query(rf"""with m as (select doc_id, {MARKED} || case doc_id % 4 when 0 then '{{{{ Reflist }}}}' when 1 then '<!-- {{{{reflist}}}} -->' when 2 then '<nowiki><references /></nowiki>' else '' end as t from documents)
select doc_id, contains(t, '</ref>') and doc_id % 4 > 0 as lacks from m""")
def lacks_references(spark, d):
    """Documents with references that are listed, listed in a comment or in nowiki only, or nowhere, and documents without."""
    k = F.col("doc_id") % 4
    ends = F.when(k == 0, "{{ Reflist }}").when(k == 1, "<!-- {{reflist}} -->").when(k == 2, "<nowiki><references /></nowiki>").otherwise("")
    return marked(spark, d).select("doc_id", T.lacks_references(F.concat("wikitext", ends)).alias("lacks"))


_TAKEN = "([ \n])([A-Z][a-z]+) "


def _acted(new: str) -> str:
    return rewritten_sql("text", [(_TAKEN, new)])


@query(rf"""select doc_id, {_acted(r"\1[http://x.org/a \2] {{dead link|date=May 2001}} ")} as tagged, text as unlinked, {_acted(r"\1[http://a.org/z \2] ")} as archived, {_acted(r"\1[http://x.org/b \2] ")} as replaced, {_acted(r"\1[http://x.org/a \2] (old) ")} as appended from documents""")
def edit_actions(spark, d):
    """Edits of all links of a URL in whole texts."""
    t = rewritten(F.col("text"), [(_TAKEN, r"\1[http://x.org/a \2] ")])

    def act(kind, value):
        return H.apply_action(t, F.lit(kind), F.lit("http://x.org/a"), F.lit(value)).alias({"tag": "tagged", "unlink": "unlinked", "archive": "archived", "replace": "replaced", "append": "appended"}[kind])

    return table(spark, d, "documents").select("doc_id", act("tag", "May 2001"), act("unlink", ""), act("archive", "http://a.org/z"), act("replace", "http://x.org/b"), act("append", "(old)"))


_TABLES = [
    (r"([A-Za-z]+) ([a-z]+) ([a-z]+)\.", r"<table class='x'><caption>\1</caption><tr><th>\1</th><th scope='col'>\2</th></tr><tr align='left'><td>\3</td></tr></table>"),
    (r"([a-z]+), ([a-z]+)", r"<!-- <table> --><table><tr><td><table><tr><td>\1</td></tr></table></td></tr></table>\2"),
]
_WIKI = [
    (r"([A-Za-z]+) ([a-z]+) ([a-z]+)\.", "{| class='x'\n|+ \\1\n|-\n! \\1\n! scope='col' | \\2\n|- align='left'\n| \\3\n|}"),
    (r"([a-z]+), ([a-z]+)", "<!-- <table> -->{|\n|-\n| \n{|\n|-\n| \\1\n|}\n|}\\2"),
]


@query(rf"""select doc_id, {rewritten_sql("text", _WIKI)} as wiki, cast(len(regexp_extract_all(text, '{_TABLES[0][0]}')) + len(regexp_extract_all({rewritten_sql("text", _TABLES[:1])}, '{_TABLES[1][0]}')) as bigint) as tables, 0 as warnings from documents""")
def table_to_wiki(spark, d):
    """HTML tables, some nested, put into documents, in wiki markup."""
    rows = table(spark, d, "documents").select("doc_id", H.tables_to_wiki(rewritten(F.col("text"), _TABLES)).alias("t"))
    return rows.select("doc_id", F.col("t.text").alias("wiki"), F.col("t.tables").cast("long").alias("tables"), "t.warnings")


@query(r"""with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[^A-Za-z0-9 .,\n]', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from documents)
select doc_id, '<h2>' || doc_id || '</h2><ul><li><b>x</b> ' || len(lines) || '</li></ul>' || case when len(lines) > 0 then '<p>' || lines[1] || '<sup><a href="#cite1">[1]</a></sup></p>' else '' end || array_to_string(list_transform(lines[2:], lambda x: '<p>' || x || '</p>'), '')
  || '<p><a href="/wiki/A_b">c</a></p>' || case when len(lines) > 0 then '<ol><li id="cite1">note</li></ol>' else '' end as html from p""")
def wiki_to_html(spark, d):
    """Whole documents, their first line with a reference, behind a heading and a list."""
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "[^A-Za-z0-9 .,\n]", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.transform(F.slice(lines, 1, 1), lambda x: F.concat(x, F.lit("<ref>note</ref>")))
    k = F.col("doc_id").cast("string")
    t = F.concat(F.lit("== "), k, F.lit(" ==\n* '''x''' "), F.size(lines).cast("string"), F.lit("\n"), F.array_join(F.concat(first, F.slice(lines, 2, 1 << 30)), "\n"), F.lit("\n[[A b|c]]"))
    return table(spark, d, "documents").select("doc_id", H.wiki_to_html(t).alias("html"))


@query(r"""with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[^A-Za-z0-9 .,\n]', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from documents)
select doc_id, '<p>before</p><table class="a" id="' || doc_id || '"><caption>' || len(lines) || ' lines</caption><tr><th>n</th><th scope="col"><b>text</b></th></tr>' || array_to_string(list_transform(lines, lambda x, i: '<tr style="x"><td>' || i || '</td><td class="c"><a href="/wiki/A">' || x || '</a>' || chr(10) || 'more' || case when i % 5 = 0 then '<table><tr><td>' || x || '</td></tr></table>' else '' end || '</td></tr>'), '') || '</table><p>behind</p>' as html from p""")
def wiki_tables(spark, d):
    """Whole documents as tables, a line a row, with attributes, links and tables in cells."""
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "[^A-Za-z0-9 .,\n]", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    inner = lambda x, i: F.when((i + 1) % 5 == 0, F.concat(F.lit("\n{|\n|"), x, F.lit("\n|}"))).otherwise("")
    rows = F.transform(lines, lambda x, i: F.concat(F.lit("|- style='x' onclick=y\n| "), (i + 1).cast("string"), F.lit(" || class=c | [[A|"), x, F.lit("]]\nmore"), inner(x, i)))
    t = F.concat(F.lit('before\n{| class=a id="'), F.col("doc_id").cast("string"), F.lit('"\n|+ '), F.size(lines).cast("string"), F.lit(" lines\n! n !! scope=col | '''text'''\n"), F.array_join(rows, "\n"), F.lit("\n|} behind"))
    return table(spark, d, "documents").select("doc_id", H.wiki_to_html(t).alias("html"))


@query(r"""with m as (select doc_id, regexp_replace(text, '\s+', ' ', 'g') as t from documents)
select doc_id, case when doc_id % 4 < 3 then 'dab' || doc_id end as subject, case doc_id % 4 when 0 then 'dab' || doc_id when 1 then 'the dab' when 2 then 'dab' || doc_id end as label, case when doc_id % 4 < 3 then trim(t) end as description from m""")
def dab_line_parts(spark, d):
    """Lines of four shapes, the last of them none of a disambiguation page, with whole texts as descriptions."""
    k, t = F.col("doc_id").cast("string"), F.regexp_replace("text", r"\s+", " ")
    shapes = [("* [[dab", "]] – "), ("** [[ dab", "|the dab]], "), ('# "[[dab', ']]": ')]
    line = F.concat(t, F.lit(" [[dab]]"))
    for i, (a, b) in enumerate(shapes):
        line = F.when(F.col("doc_id") % 4 == i, F.concat(F.lit(a), k, F.lit(b), t)).otherwise(line)
    return table(spark, d, "documents").select("doc_id", H.dab_line(line).alias("p")).select("doc_id", "p.subject", "p.label", "p.description")


# ----------------------------------------------------------------- pages

_META = [("<p>", "<p><META property='og:word' content=\"A\">"), ("<h1>([A-Za-z]+)", r"<h1><meta name=" + '"author"' + r" content='By \1'>\1"), ("<li>", "<meta content='x'><li>")]


@query(rf"""with m as (select page_id, unnest(regexp_extract_all({rewritten_sql("html", _META)}, '(?is)<meta\b[^>]*>')) as tag from pages),
f as (select page_id, lower(regexp_extract(tag, '(?is)\b(?:name|property)\s*=\s*["'']([^"'']*)', 1)) as name, regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']([^"'']*)', 1) as content from m) select * from f where name <> ''""")
def meta_fields(spark, d):
    """Named meta elements of pages into which some were put."""
    m = table(spark, d, "pages").select("page_id", F.explode(T.meta_fields(rewritten(F.col("html"), _META))).alias("m"))
    return m.select("page_id", "m.name", "m.content")


_IMAGES = [("<p>([A-Za-z]+) ([a-z]+)", r"<p><img src='/\1.jpg' alt='\2'>\1 \2"), ("</p>", '<img alt="" src="/dot.png"></p>'), ('<li><a href="/([a-z]+)', r"<li><IMG SRC='/\1.gif' ALT='\1'>" + r'<a href="/\1')]


@query(rf"""with i as (select page_id, unnest(regexp_extract_all({rewritten_sql("html", _IMAGES)}, '(?is)<img\b[^>]*>')) as tag from pages),
p as (select page_id, regexp_extract(tag, '(?is)\bsrc\s*=\s*["'']([^"'']*)', 1) as src, regexp_extract(tag, '(?is)\balt\s*=\s*["'']([^"'']*)', 1) as alt from i)
select page_id, src, alt, alt <> '' and not contains(lower(src), lower(alt)) as named from p""")
def image_alts(spark, d):
    """Images put into pages, with alternative texts that say something, nothing or only the file's name."""
    rows = table(spark, d, "pages").select("page_id", F.explode(T.images(rewritten(F.col("html"), _IMAGES))).alias("i"))
    return rows.select("page_id", "i.src", "i.alt", "i.named")


# ----------------------------------------------------------------- titles and citations


@query("""with n as (select p_partkey, case p_partkey % 4 when 0 then upper(p_name) || ' LTD' when 1 then upper(p_name) || ' no 5' when 2 then upper(p_name) || ' (and others)' else p_name end as shout from part),
l as (select *, length(regexp_replace(shout, '[^A-Za-z]', '', 'g')) as letters, length(regexp_replace(shout, '[^A-Z]', '', 'g')) as capitals from n)
select p_partkey, shout, case when length(shout) > 6 and not regexp_matches(shout, '[0-9]') and capitals > letters * 0.7 then array_to_string(list_transform(string_split(shout, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') else shout end as calm from l""")
def title_case_fix(spark, d):
    """Titles in capitals, with a number, with few capitals and as they are."""
    up, k = F.upper("p_name"), F.col("p_partkey") % 4
    shout = F.when(k == 0, F.concat(up, F.lit(" LTD"))).when(k == 1, F.concat(up, F.lit(" no 5"))).when(k == 2, F.concat(up, F.lit(" (and others)"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", shout.alias("shout"), N.calm_title(shout).alias("calm"))


@query("""select o_orderkey, '{{cite web |url=http://x.org/' || o_orderkey || case when o_orderstatus = 'F' then '' else ' |title=' || o_orderpriority end || case when o_custkey % 3 = 0 then '' else ' |date=' || strftime(o_orderdate, '%Y-%m-%d') end || case when o_custkey % 2 = 0 then '' else ' |access-date=' || strftime(o_orderdate + interval 40 day, '%Y-%m-%d') end || '}}' as cite from orders""")
def citation_text(spark, d):
    """Citations with some of the fields missing."""
    o, day = table(spark, d, "orders"), F.to_date("o_orderdate")
    title, accessed = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")), F.when(F.col("o_custkey") % 2 != 0, F.date_add(day, 40))
    return o.select("o_orderkey", T.citation(F.concat(F.lit("http://x.org/"), F.col("o_orderkey").cast("string")), title, F.when(F.col("o_custkey") % 3 != 0, day), accessed).alias("cite"))


@query("""with w as (select p_partkey, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part)
select p_partkey, case p_partkey % 3 when 0 then upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] when 1 then 'Ann ' || upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] end as author, case when p_partkey % 2 = 0 then a || ' ' || b when length(a) > 2 then a end as publisher from w""")
def byline_and_publisher(spark, d):
    """Bylines of people and of staff; publishers whose name is the host's, one word of it, or nothing."""
    n, a, b = F.initcap("p_name"), F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("Lead\n  By: "), n, F.lit("\nToday"))).when(k == 1, F.concat(F.lit("by Ann "), n, F.lit("\nToday"))).otherwise(F.concat(F.lit("By "), n, F.lit(" Staff\n")))
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("A story about it | "), F.col("p_name"))).otherwise(F.concat(F.lit("Others - "), a))
    return table(spark, d, "part").select("p_partkey", T.byline(line).alias("author"), T.publisher(F.concat(F.lit("www."), a, b, F.lit(".com")), title).alias("publisher"))


_BARE = r"replace(lower(regexp_replace(regexp_replace(%s, '[_ ]\([^)]*\)$', ''), '[^\p{L}\p{N} _]', '', 'g')), '_', ' ')"


@query(rf"""with x as (select p_partkey, case p_partkey % 5 when 0 then upper(p_name) when 1 then split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2) || '_(thing)' when 2 then split_part(p_name, ' ', 1) || ' old ' || split_part(p_name, ' ', 2) when 3 then p_name || ' old' else reverse(p_name) end as target, p_name as link from part),
y as (select *, {_BARE % "link"} as a, {_BARE % "target"} as b from x)
select p_partkey, a = b or (len(string_split(b, ' ')) = 3 and a = split_part(b, ' ', 1) || ' ' || split_part(b, ' ', 3)) as bypass from y""")
def redirect_bypass(spark, d):
    """Redirects and targets that differ by case, by marks and a qualifier, by a middle name, by a last one, or wholly."""
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    a, b = F.substring_index(n, " ", 1), F.substring_index(n, " ", -1)
    target = F.when(k == 0, F.upper(n)).when(k == 1, F.concat(a, F.lit(", "), b, F.lit("_(thing)"))).when(k == 2, F.concat(a, F.lit(" old "), b)).when(k == 3, F.concat(n, F.lit(" old"))).otherwise(F.reverse(n))
    return table(spark, d, "part").select("p_partkey", T.bypasses(n, target).alias("bypass"))
