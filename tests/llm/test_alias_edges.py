"""Edges between pages against a plain reader of their tags and the standard's resolution of links; verdicts against a plain walk over them."""

import collections
import html as h
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from pagegraph.llm import url_filter
from pagegraph.session import table

BASE = "http://Site.org/x/y?a=1#f"


@pytest.mark.parametrize("target", ["/z", "z", "z/", "./z", "../z", "../../../z", "?q=2", "#top", "", "//o.org/p", "https://o.org/../p", "a/./b/../c", "a/..", ".", "..", "/a/../..", "z?u=../v#w", "./?q", "/", "/?q=1", "z&amp;w=1", "z?a&amp;b&#38;c", "&#x2F;z", "..;/z", "z/.."])
def test_targets_are_resolved_as_the_standard_says(spark, target):
    got = spark.createDataFrame([(target, BASE)], "t string, b string").select(url_filter.resolve(F.col("t"), F.col("b")).alias("u")).first().u
    assert got == urljoin(BASE, h.unescape(target)) or (target in ("", "#top") and got == BASE)


def test_empty_segments_stay(spark):
    """As the standard has it; the library's urljoin drops them."""
    got = spark.createDataFrame([("a//b", BASE)], "t string, b string").select(url_filter.resolve(F.col("t"), F.col("b")).alias("u")).first().u
    assert got == "http://Site.org/x/a//b"


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attributes):
        a = {k: v or "" for k, v in attributes}
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
            self.found.append(a["href"].strip())
        if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh" and (m := re.search(r"(?i)url\s*=\s*['\"]?\s*([^'\"\s>]+)", a.get("content", ""))):
            self.found.append(m[1])


def node(url):
    m = re.match(r"(?s)(.*?://[^/?#]*)([^#]*)", url)
    return m and m[1].translate({c: c + 32 for c in range(65, 91)}) + (m[2] or "/")


def plain_edges(pages):
    out = collections.Counter()
    for url, source in pages:
        if url and source and "://" in url:
            r = Reader()
            r.feed(source)
            for t in r.found:
                if (v := node(urljoin(url, t))) and node(url):
                    out[node(url), v] += 1
    return out


def linked_pages(spark, n=400):
    """Pages of the table into which links between them were put, in all ways and some that do not count."""
    rng = random.Random(9)
    rows = [(r.page_id, r.url, r.html) for r in table(spark, DATA, "pages").collect()]
    rows += [(1000 + i, f"http://{rng.choice('abc')}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{i}?s={i % 3}", "<html><head></head><body>x</body></html>") for i in range(n)]
    urls = [r[1] for r in rows if r[1]]
    out = []
    for i, url, source in rows:
        to = rng.choice(urls)
        path = re.sub(r"^[^:]*://[^/?#]*", "", to)
        tag = rng.choice(
            ["", f'<link rel="canonical" href="{h.escape(to)}">', f"<LINK href='{path}' REL=canonical>", f'<link rel="alternate canonical" href="../{path.strip("/")}">', f'<meta http-equiv="refresh" content="0; url={path}">', f'<link rel=canonical href="?page={i % 7}">',
             f'<!-- <link rel="canonical" href="{to}"> -->', f"<script>var s = '<link rel=\"canonical\" href=\"{to}\">';</script>", f'<link rel="stylesheet" href="{to}">', "<!-- open", f"<link rel=canonical href=//b.example.org{path}#part>"]
        )
        out.append((i, url, (source or "").replace("</head>", tag + "</head>", 1)))
    return out


def test_edges_are_those_of_a_plain_reader(spark):
    rows = linked_pages(spark)
    got = collections.Counter((r.u, r.v) for r in url_filter.alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == plain_edges([r[1:] for r in rows]) and sum(got.values()) > 150


def test_verdicts_are_those_of_a_plain_walk(spark):
    rows = linked_pages(spark)
    near = collections.defaultdict(set)
    for u, v in plain_edges([r[1:] for r in rows]):
        near[u].add(v)
        near[v].add(u)

    def own(url):
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
        host = host.lower()
        fits = [(len(b + p), v) for v, b, p in url_filter.RULES if (host == b or host.endswith("." + b)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    want, by_alias = {}, 0
    for i, url, _ in rows:
        verdict = own(url) if url and "://" in url else None
        if verdict is None and url and "://" in url:
            seen, work = {node(url)}, [node(url)]
            while work:
                for v in near[work.pop()] - seen:
                    seen.add(v)
                    work.append(v)
            fits = {own(x) for x in seen}
            verdict = "block" if "block" in fits and "allow" not in fits else "allow"
            by_alias += verdict == "block"
        want[i] = verdict or "allow"
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and by_alias > 10
