"""Every query of the catalogue against its SQL."""

import datetime

import pytest
from conftest import DATA

from pagegraph import catalog
from pagegraph.catalog import wikitext
from pagegraph.session import table

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows_of(rows):
    return sorted(repr(tuple(map(plain, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()]
    assert rows_of(got) == rows_of(want)


def test_every_query_is_compared():
    """What has no SQL has a test of its own here."""
    assert all(f"test_{name}" in globals() for name in set(QUERIES) - set(SQL))


# ------------------------------------------------------------------ queries that SQL cannot express


def test_soup_nodes(spark):
    """Rows of the parsed trees against a stack over the tags of these pages, which leave p, b and br open only."""
    import html
    import json
    import re

    got = {}
    for r in QUERIES["soup_nodes"](spark, DATA).orderBy("page_id", "node").collect():
        got.setdefault(r.page_id, []).append((r.parent, r.depth, r.tag, json.loads(r.attributes), r.text))
    for page in table(spark, DATA, "pages").collect():
        rows, stack = [], [(-1, "")]
        for m in re.finditer(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style)>(.*?)</\1>|<(/?)([a-z0-9]+)([^>]*)>|[^<]+", page.html):
            def add(tag, attributes, text, rows=rows, stack=stack):
                rows.append((stack[-1][0], len(stack) - 1, tag, attributes, text))
                return len(rows) - 1

            if m[1]:
                stack.append((add(m[1], {}, ""), m[1]))
                add("#text", {}, m[2])
                stack.pop()
            elif m[4]:
                if m[3]:
                    if m[4] in [t for _, t in stack]:
                        while stack.pop()[1] != m[4]:
                            pass
                    continue
                if m[4] in ("p", "li"):  # ends an open one of its kind, up to the next block around it
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][1] == m[4]:
                            del stack[i:]
                            break
                        if stack[i][1] in ("ul", "ol", "dl", "table", "body", "html", "div", "select"):
                            break
                at = add(m[4], dict(re.findall(r'([a-z-]+)="([^"]*)"', m[5])), "")
                if m[4] not in ("br", "meta"):
                    stack.append((at, m[4]))
            elif not m[0].startswith("<!") and m[0].strip():
                add("#text", {}, html.unescape(m[0]))
        assert [(p, dp, t, a, x.strip()) for p, dp, t, a, x in got[page.page_id]] == [(p, dp, t, a, x.strip()) for p, dp, t, a, x in rows]


def test_fuzzy_anchor(spark):
    import collections
    from difflib import SequenceMatcher

    parts = collections.Counter((r.p_brand, r.p_name) for r in table(spark, DATA, "part").collect())
    want = {}
    for (brand, a), n in parts.items():
        for (other, b), m in parts.items():
            if brand == other and a < b and (ratio := SequenceMatcher(None, a, b).ratio()) >= 0.5:
                want[brand, a, b] = (round(ratio, 6), n, m)
    assert {(r.p_brand, r.a, r.b): (r.ratio, r.n_a, r.n_b) for r in QUERIES["fuzzy_anchor"](spark, DATA).collect()} == want and want


def test_merged_references(spark):
    """Each content stands once; with names written back as their contents, the text is the one before."""
    import re

    before = {r.doc_id: r.wikitext for r in wikitext.marked(spark, DATA).collect()}
    several = 0
    for r in QUERIES["merged_references"](spark, DATA).collect():
        old = re.findall(r"<ref(?: name='([^']*)')?>([^<]*)</ref>", before[r.doc_id])
        uses = [c for _, c in old]
        full = re.findall(r'<ref(?: name=["\']([^"\']*)["\'])?>([^<]*)</ref>', r.merged)
        assert sorted(c for _, c in full) == sorted(set(uses))
        names = {n: c for n, c in full if n}
        assert len(names) == len([n for n, _ in full if n])
        for c in {c for c in uses if uses.count(c) > 1}:
            given = next((n for n, x in old if x == c and n), None)
            assert next(n for n, x in names.items() if x == c) == given if given else True
            several += 1
        whole = re.sub(r'<ref name="([^"]*)" />', lambda m, names=names: f"<ref>{names[m[1]]}</ref>", r.merged)
        plain = [re.sub(r"<ref[^>]*>", "<ref>", t) for t in (whole, before[r.doc_id])]
        assert plain[0] == plain[1]
    assert several > 100


def test_html_text_diff(spark):
    """The lines that a clean-up takes away and adds, in order, turn the page into the clean one."""
    import re

    pages = {r.page_id: r.html for r in table(spark, DATA, "pages").collect()}
    for r in QUERIES["html_text_diff"](spark, DATA).collect():
        clean = pages[r.page_id]
        for tag, mark in (("b|strong", "'''"), ("i|em", "''")):
            clean = re.sub(rf"(?is)<(?:{tag})>(.*?)</(?:{tag})>", rf"{mark}\1{mark}", clean)
        clean = re.sub(r"(?i)<br\s*>", "<br />", clean)
        old, new, at = pages[r.page_id].splitlines(), [], 0
        for line in r.diff.split("\n") if r.diff else []:
            if m := re.match(r"@@ -(\d+)(?:,(\d+))? ", line):
                start = int(m[1]) - (m[2] != "0")
                new += old[at:start]
                at = start
            elif line.startswith("-"):
                assert old[at] == line[1:]
                at += 1
            else:
                new.append(line[1:])
        assert new + old[at:] == clean.splitlines()


def test_first_sentences(spark):
    """Whole sentences from the first paragraph's start; one more would pass 250 characters."""
    import html
    import re

    for page, got in zip(table(spark, DATA, "pages").orderBy("page_id").collect(), QUERIES["first_sentences"](spark, DATA).orderBy("page_id").collect(), strict=True):
        first = page.html.split("<p>", 1)[1]
        first = re.split("</p>|<p>", first, maxsplit=1)[0]
        text = " ".join(html.unescape(re.sub("<[^>]*>", "", first)).split())
        ends = [m.end() for m in re.finditer(r"[.!?](?= )", text)] + [len(text)]
        fitting = [e for e in ends if e <= 250] or ends[:1]
        assert got.description == text[: fitting[-1]]


def test_blame_words(spark):
    import collections

    from test_search import plain_blame

    rows = [(r.conv_id, r.turn, r.text) for r in table(spark, DATA, "conversations").collect()]
    got = collections.Counter((r.conv_id, r.place, r.word, r.revision) for r in QUERIES["blame_words"](spark, DATA).collect())
    assert got == plain_blame(rows)


def test_protected_spans(spark):
    from test_spans import plain_spans

    from pagegraph.catalog import spans as S

    kinds = [k for k in S.P.KINDS if k not in ("header", "inputbox")]
    want = [(r.doc_id, n, k, a, b - a) for r in S.marked(spark, DATA, S.KINDS).collect() for n, (k, a, b) in enumerate(plain_spans(r.wikitext, kinds)) if len(r.wikitext) < 20_000]
    short = {r.doc_id for r in S.marked(spark, DATA, S.KINDS).collect() if len(r.wikitext) < 20_000}
    got = [tuple(r) for r in QUERIES["protected_spans"](spark, DATA).collect() if r.doc_id in short]
    assert len(kinds) == 15 and sorted(got) == sorted(want) and {k for _, _, k, _, _ in want} == set(kinds)


def test_masked_edit(spark):
    from pagegraph.catalog import spans as S

    texts = {r.doc_id: r.wikitext for r in S.marked(spark, DATA, S.KINDS).collect()}
    for r in QUERIES["masked_edit"](spark, DATA).collect():
        t, out, at = texts[r.doc_id], [], 0
        found = S.P.spans(t, ("nowiki", "comment", "template", "table", "link", "ref"))
        for _, a, b in found:
            out += [t[at:a].upper(), t[a:b]]
            at = b
        assert r.edited == "".join([*out, t[at:].upper()]) and r.parts == len(found)


def test_named_references(spark):
    """Contents written back for names give the text before; what is worth it stands once, and names are those of the sources."""
    import re

    from pagegraph.catalog.base import rewritten

    before = {r.doc_id: r.t for r in table(spark, DATA, "documents").select("doc_id", rewritten(wikitext.F.col("text"), wikitext.NAMED).alias("t")).collect()}
    names = set()
    for r in QUERIES["named_references"](spark, DATA).collect():
        full = {m[1]: m[2] for m in re.finditer(r'<ref name="([^"]*)">(.*?)</ref>', r.named)}
        assert len(full) == len(re.findall('<ref name="[^"]*">', r.named))
        back = re.sub(r'<ref name="([^"]*)"/>', lambda m, full=full: f"<ref>{full[m[1]]}</ref>", r.named)
        assert re.sub(r'<ref name="[^"]*">', "<ref>", back) == before[r.doc_id]
        uses = re.findall("<ref>(.*?)</ref>", before[r.doc_id])
        left = re.findall("<ref>(.*?)</ref>", r.named)
        assert all(left.count(c) == (0 if uses.count(c) > 1 and c in full.values() else uses.count(c)) for c in set(uses))
        assert "short" not in full.values()
        names |= {re.sub("[0-9]+$", "", n) for n in full}
    assert {"whitmore", "harker", "example-news", "mccannon", "encyclopaediasxiv"} <= names
