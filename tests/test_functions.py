"""Golden cases of text, title, URL and coordinate functions."""

import pytest
from pyspark.sql import functions as F

from pagegraph.functions import geo, markup, text, titles, urls


def one(spark, make, *values):
    names = [f"v{i}" for i in range(len(values))]
    kinds = {int: "long", float: "double", str: "string", bytes: "binary", type(None): "string", list: "array<string>"}
    df = spark.createDataFrame([values], ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, values, strict=True)))
    return df.select(make(*[F.col(n) for n in names]).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "want"),
    [("foo_bar", "Foo bar"), ("%46oo%20bar#part", "Foo bar"), ("  :foo__bar ", "Foo bar"), ("a&amp;b", "A&b"), ("C+%2B", "C++"), ("100%", "100%"), ("", ""), ("‎x", "X"), ("%E9t%E9", "Été"), ("%41%E9", "Aé")],
)
def test_canonical_title(spark, raw, want):
    assert one(spark, titles.canonical_title, raw) == want


def test_namespaces(spark):
    assert one(spark, lambda t: titles.split_namespace(t)["ns"], "User talk:Foo") == 3
    assert one(spark, lambda t: titles.split_namespace(t)["rest"], "Nonsense:Foo") == "Nonsense:Foo"
    assert one(spark, lambda n: titles.full_title(n, F.lit("Foo")), 99) == "{ns:99}:Foo"
    assert one(spark, titles.subject_namespace, 3) == 2


@pytest.mark.parametrize("n", [0, 1, 61, 62, 3843, 3844, 1_700_000_000_000_000])
def test_base62(spark, n):
    assert one(spark, lambda c: titles.unbase62(titles.base62(c)), n) == n


def test_title_helpers(spark):
    assert one(spark, titles.calm_title, "BREAKING NEWS TODAY") == "Breaking News Today"
    assert one(spark, titles.calm_title, "ABC 123 DEF GHI") == "ABC 123 DEF GHI"
    assert one(spark, titles.natural_key, "Part 10") > one(spark, titles.natural_key, "Part 9")
    assert one(spark, titles.english_list, ["a", "b", "c"]) == "a, b, and c"
    assert one(spark, lambda t: titles.db_parts(t)["host"], "commonswiki_p") == "commons.wikimedia.org"
    assert one(spark, lambda t: titles.db_parts(t)["host"], "zh_min_nanwiki") == "zh-min-nan.wikipedia.org"
    assert one(spark, lambda t: F.rlike(F.lit("links to Foo_bar here"), titles.title_regex(t)), "foo bar") is True


def test_urls(spark):
    assert one(spark, urls.reversed_host, "http://www.Example.com/a?b=c") == "http://com.example.www./a?b=c"
    assert one(spark, urls.without_tracking, "http://x.org/?utm_source=a&id=1&ref=b") == "http://x.org/?id=1"
    assert one(spark, urls.repaired_scheme, "http://https://x.org/a") == "https://x.org/a"
    assert one(spark, lambda t: urls.unanchor(urls.anchor(t)), "Früher & später") == "Früher & später"
    assert one(spark, lambda t: urls.parameter(t, "id"), "http://x.org/?a=1&id=7#z") == "7"


@pytest.mark.parametrize(
    ("params", "lat", "lon"),
    [("47.66143_N_16.17678_E_type:camera_AT-3", 47.66143, 16.17678), ("10_30_S_20_W", -10.5, -20.0), ("1_2_3_N_4_5_6_E", 1 + 2 / 60 + 3 / 3600, 4 + 5 / 60 + 6 / 3600), ("12.5;-7.25_type:city", 12.5, -7.25), ("91_N_0_E", None, None), ("1_61_N_0_E", None, None), ("1;2_3_4_source:sc", 1.0, 2.0), ("rubbish", None, None)],
)
def test_coordinates(spark, params, lat, lon):
    got = one(spark, geo.latlon, params)
    assert (got.lat, got.lon) == (pytest.approx(lat) if lat is not None else None, pytest.approx(lon) if lon is not None else None)


def test_geolink(spark):
    url = "http://x.org/geohack.php?params=47.66143_N_16.17678_E_type:camera_region:AT-3_dim:2km_heading:NE&language=en"
    g = one(spark, geo.geolink, url)
    assert (g.type, g.region, g.dim, g.heading, g.scale, g.digits, g.warnings) == ("camera", "AT-3", 2000.0, 45.0, 10_000, 5, [])
    assert "unknown globe" in one(spark, geo.geolink, "http://x/?params=1_N_2_E_globe:nowhere").warnings


def test_markup_rules(spark):
    assert one(spark, text.simplify_links, "[[A|AB]]") == "[[A]]B"
    assert one(spark, text.simplify_links, "[[cat|cats]]") == "[[cat]]s"
    assert one(spark, text.simplify_links, "a_b [[c_d_e_f|x_y]] [[g_h]] [[no_end\nz_]] [[") == "a_b [[c d e f|x_y]] [[g h]] [[no_end\nz_]] [["
    assert one(spark, text.strip_disabled, "a<!-- x -->b<nowiki>[[c]]</nowiki>d") == "abd"
    assert one(spark, text.reference_repairs, "text <ref name=a>x</ref>.") == 'text.<ref name="a">x</ref>'
    assert one(spark, text.lacks_references, "x<ref>a</ref>") is True
    assert one(spark, text.only_date, "On 3 May 2001, that is 2001-05-03.").isoformat() == "2001-05-03"
    assert one(spark, text.only_date, "2001-05-03 and 2001-05-04") is None
    assert one(spark, text.byline, "By Jane Q. Doe\nText") == "Jane Q. Doe"
    assert one(spark, text.byline, "By Staff Reporter\n") is None
    assert one(spark, lambda t: text.with_section(t, "See also", F.lit("* x")), "a\n[[Category:B]]").startswith("a\n\n== See also ==")
    for f in (text.style_repairs, text.citation_repairs, text.url_repairs, text.reference_repairs, text.simplify_links):
        sample = "== '''A''' ==\n*b\n{{dab}} <ref name=x>y</ref>. [[Foo_bar|foo bar]] {{cite web|accessdate=2001-5-03|}}"
        assert one(spark, lambda c, f=f: f(f(c)), sample) == one(spark, f, sample)


def test_udfs(spark):
    wiki = one(spark, markup.tables_to_wiki, "<table class=a><tr><td>1<table><tr><td>2</td></tr></table></td></tr></table>")
    assert wiki.tables == 1 and wiki.text.startswith("{| class=a") and wiki.text.count("{|") == 2
    assert one(spark, markup.wiki_to_html, "* [[A|b]]") == '<ul><li><a href="/wiki/A">b</a></li></ul>'
    assert one(spark, markup.merged_references(), "a<ref>x</ref> b<ref>x</ref>") == 'a<ref name="auto">x</ref> b<ref name="auto" />'
    assert one(spark, markup.with_references_section, "a<ref>x</ref>\n[[Category:B]]").index("<references />") < 60
    assert one(spark, markup.replace_except("a", "b", ("nowiki",)), "a<nowiki>a</nowiki>a") == "b<nowiki>a</nowiki>b"
    assert one(spark, titles.plain_key, "Čelovce") == one(spark, titles.plain_key, "celovce") == "CELOVCE"
    assert one(spark, titles.plain_key, "Dr. Kappa_and the Müllers (band)") == one(spark, titles.plain_key, "Capa & Mulers")
    assert one(spark, lambda a, b: markup.detected_text(a, b), "é".encode("latin-1"), None) == "é"
    assert one(spark, markup.prettify, "<p>Para1<p>Para2").split("\n") == ["<p>", " Para1", "</p>", "<p>", " Para2", "</p>"]
    assert one(spark, markup.html_cleanup, "<b>a</b><i>b</i>") == "'''a'''''b''"
    assert one(spark, markup.first_sentences, "<p>One. Two.</p><p>Three.</p>") == "One. Two."


def test_tree_navigation(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td class=x>Blah<tr><td>Bleh</table><p>z")], "page_id long, html string")
    nodes = markup.node_rows(pages).cache()
    assert markup.find_all(nodes, tag="tr").count() == 2
    cell = markup.find_all(nodes, attribute="class", value="x")
    assert markup.parents(nodes, cell).first().tag == "tr"
    assert markup.children(nodes, cell).first().text == "Blah"
    assert markup.siblings(nodes, markup.find_all(nodes, tag="p")).count() == 2
    assert markup.without_nodes(pages, ["table"]).first().html == "<p>z"


def test_percent_coding_of_whole_texts(spark):
    from urllib.parse import quote

    for text in ("", "a b_c+d*e~f%20", "é世🙂 " * 500 + "end", "".join(map(chr, range(1, 300)))):
        assert one(spark, urls.percent_encoded, text) == quote(text, safe="")
        assert one(spark, lambda c: urls.percent_decoded(urls.percent_encoded(c)), text) == text
    assert one(spark, urls.percent_decoded, "1+1%3D2") == "1+1=2"


def test_percent_decode_keeps_all_of_a_document(spark):
    from conftest import DATA

    from pagegraph import catalog

    got = catalog.queries()["percent_decode"](spark, DATA)
    assert got.where("length(back) > 60").count() > 0
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text")
    assert got.select("doc_id", "source", "back").exceptAll(texts).count() == 0 and got.count() == texts.count()


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("25-Sep-2008", "2008-09-25"), ("3/march/2008", "2008-03-03"), ("Friday, 7 Nov. 2008", "2008-11-07"), ("Sun 7 dec 2008", "2008-12-07"), ("3rd March 2008", "2008-03-03"), ("21 Sept, 2008", "2008-09-21"), ("Sept. 1st, 2008", "2008-09-01"), ("June 30 2008", "2008-06-30"),
        ("2008/25/09", "2008-09-25"), ("2008.25.12", "2008-12-25"), ("2008/09/25", "2008-09-25"), ("2008.9.25", "2008-09-25"), ("09/25/2008", "2008-09-25"), ("25.09.2008", "2008-09-25"), ("2008-09-02", "2008-09-02"), ("20080925103059", "2008-09-25"),
        ("2008-05-03, changed 3rd March 2008", None), ("2008-05-03, changed 25-Sep-2008", None), ("2008-09-25, that is 25/09/2008 or Thursday 25 September 2008", "2008-09-25"), ("2008/5/6", None), ("31 Feb 2008", None), ("31 Feb 2008 or 2008-03-01", None), ("120080925103059", None), ("1850-01-25", None), ("no date", None), ("", None), (None, None),
        ("2020-06-14", "2020-06-14"), ("2020-06-16", None), ("2008-09-25, seen on 19 June 2020", "2008-09-25"), ("2025-01-01", None),
    ],
)
def test_only_date(spark, raw, want):
    got = one(spark, lambda c: text.only_date(c, F.lit("2020-06-19 12:00:00").cast("timestamp")), raw)
    assert (got and got.isoformat()) == want


def test_only_date_drops_dates_of_these_days(spark):
    import datetime

    today = datetime.date.today()
    assert one(spark, text.only_date, f"{today}, first on 3rd March 2008").isoformat() == "2008-03-03"


@pytest.mark.parametrize("box", ["disambigbox", "setindexbox"])
def test_no_description_of_lists_of_meanings(spark, box):
    assert one(spark, markup.first_sentences, f'<p>Foo may refer to:</p><table class="x" id="{box}"></table>') == ""
    assert one(spark, markup.first_sentences, f"<p>A {box} is a box. It is small.</p>") == f"A {box} is a box. It is small."
