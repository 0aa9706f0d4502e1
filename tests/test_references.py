"""Names of merged references: every source of a word and of a number, and texts in which names are taken."""

import pytest

from pagegraph.functions import markup


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("{{cite book| last =Whitmore|title=x|page=12}}", "whitmore12"),
        ("{{cite book| last =Whitmore|year=1999}}", "whitmore1999"),
        ("{{cite news|title=a|accessdate=3 May 2004| last=Longman}}", "longman1"),
        ("by Mary Sheldon, The Paper", "sheldon1"),
        ("By John Harker. 1987", "harker1987"),
        ("http://www.example-site.co.uk/page title", "example-site1"),
        ("[https://news.somepaper.com/a A title] page: 34", "somepaper34"),
        ("[[A. Baxterly| Baxterly]], p. 25 of 1975", "autogenerated25"),
        ("[[A. Baxterly|(Baxterly, 1975)]], p. 25", "autogenerated25"),
        ("{{Harvnb|McCannon|1999|p=247}}", "mccannon247"),
        ("{{sfn|May|2001}}", "autogenerated2001"),
        ("some Encyclopaedias and Interdisciplinary studies", "interdisciplinary1"),
        ("Title of it, pp 100-120", "autogenerated100"),
        ("{{cite web|url=x|title=y|pages = 5}}", "autogenerated5"),
        ("vol. xiv of it", "autogeneratedxiv"),
        ("from the year 2003", "autogenerated2003"),
        ("nothing Retrieved 2 May 2001", "autogenerated1"),
        ("", "autogenerated1"),
    ],
)
def test_names(content, want):
    assert markup.reference_name(content, "") == want


def test_names_that_are_taken():
    content = "By John Harker, page 12, of 1987"
    assert markup.reference_name(content, "") == "harker12"
    assert markup.reference_name(content, "harker12") == "harker1987"
    assert markup.reference_name(content, "harker12 harker1987 harker1") == "harker2"


LONG = "By John Harker, a long description of a report, page 12"


def test_only_what_gets_much_shorter_is_merged():
    ref = f"<ref>{LONG}</ref>"
    assert markup.with_named_references(f"a{ref} b{ref} c{ref}") == f'a<ref name="harker12">{LONG}</ref> b<ref name="harker12"/> c<ref name="harker12"/>'
    for same in (f"a{ref} b", "a<ref>By John Harker, p. 1</ref><ref>By John Harker, p. 1</ref>", f'a<ref name="x">{LONG}</ref> b<ref name="x">{LONG}</ref>', "", "<ref>open"):
        assert markup.with_named_references(same) == same
    other = ref.replace("description", "account")
    assert markup.with_named_references(ref + other + ref + other).count('"harker12"') == 2
    assert markup.with_named_references(markup.with_named_references(ref * 3)) == markup.with_named_references(ref * 3)


def test_a_column(spark):
    ref = f"<ref>{LONG}</ref>"
    got = spark.createDataFrame([(1, ref * 2), (2, None)], "k int, t string").select(markup.named_references()("t").alias("n")).collect()
    assert [r.n for r in got] == [f'<ref name="harker12">{LONG}</ref><ref name="harker12"/>', None]


def clean(spark, raw):
    from pyspark.sql import functions as F

    from pagegraph.functions import text

    return spark.createDataFrame([(raw,)], "t string").select(text.reference_cleanup(F.col("t")).alias("c")).first().c


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a.<REF>x</Ref> b", "a.<ref>x</ref> b"), ('a.<ref  name ="n">x</ref> b', 'a.<ref name="n">x</ref> b'), ("a.<ref> </ref> b", "a. b"), ("a.<ref>example.org/x</ref> b", "a.<ref>http://example.org/x</ref> b"), ("a.<ref>[http://example.org/x T t]</ref> b", "a.<ref>[http://example.org/x T t]</ref> b"),
        ("a.<sup>[http://x.org/y]</sup> b", "a.<ref>http://x.org/y</ref> b"), ("a.<ref>x</ref><ref>y</ref>, c<ref>z</ref> d", "a.<ref>x</ref><ref>y</ref>, c<ref>z</ref> d"), ("a.<ref>x</ref> b.<ref>y</ref> c<ref>z</ref>, d", "a.<ref>x</ref> b.<ref>y</ref> c,<ref>z</ref> d"),
        ("a.<ref>x</ref> b.<ref>y</ref>. c", "a.<ref>x</ref> b.<ref>y</ref> c"), ("a.<ref>x</ref> <ref name=q/>b", "a.<ref>x</ref><ref name=q/> b"), ("a.<ref>x <i>y</i></ref>b.<ref>x</ref> c <ref>z</ref>; d", "a.<ref>x <i>y</i></ref> b.<ref>x</ref> c;<ref>z</ref> d"),
        ("a<ref>x</ref>, b<ref>y</ref>. c.<ref>z</ref>", "a<ref>x</ref>, b<ref>y</ref>. c.<ref>z</ref>"), ("<references /> a", "<references /> a"), ("", ""), (None, None), ("a.<ref>open", "a.<ref>open"),
    ],
)
def test_cleanup(spark, raw, want):
    assert clean(spark, raw) == want


def test_cleanup_twice_and_of_long_texts(spark):
    raw = "a.<ref>x</ref> b<ref>y</ref>, c;<REF name =\"q\">z <b>q</b></REF>; d" * 400 + "<ref>" + "<b>x</b> " * 5000 + "</ref>" + "<ref>" * 2000
    once = clean(spark, raw)
    assert clean(spark, once) == once and once.count("</ref>") == 1201
