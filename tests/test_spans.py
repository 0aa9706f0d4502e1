"""Protected spans against a search kind by kind, masks against the spans, brackets against a stack; hostile texts."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagegraph.functions import spans as P

PARTS = ["{{", "}}", "{|", "|}", "\n{|", "\n|}", "[[", "]]", "[", "]", "<!--", "-->", "<nowiki>", "</nowiki>", "<ref name=a>", "<ref name=a/>", "</ref>", "<math>", "</MATH>", "<table>", "</table >", "<pre>", "</pre>", "\n ", "\n", " x", "http://a.b/c.", "''", "|", "<", ">", "=", "\n==h==\n", "é😀", "\ue000", "\ue0011\ue001", "<gallery a>", "</gallery>", "<source x>", "</source>", "<timeline>", "</timeline>", "<includeonly>", "</includeonly>", "<noinclude>", "</noinclude>"]
ALL = tuple(P.KINDS)


def nested_end(t, begin, end, at):
    """Where the bracket that opens at a place is closed, by counting on."""
    depth = 0
    for m in re.finditer(f"(?P<b>{begin})|{end}", t, re.I | re.M):
        if m.start() >= at:
            depth += 1 if m["b"] is not None else -1
            if depth == 0:
                return m.end()
    return None


def first_from(t, kind, at):
    """The first span of one kind from a place on, tried at every beginning."""
    begin, end = P.KINDS[kind]
    for m in re.compile(begin, re.I | re.M).finditer(t):
        if m.start() < at:
            continue
        if kind == "link":
            if found := re.compile(r"\[\[[^\]]*\]\]").match(t, m.start()):
                return m.start(), found.end()
        elif end is None:
            return m.start(), m.end()
        elif end == "nested":
            for b, e in P.NESTED[kind]:
                if re.compile(b, re.I | re.M).match(t, m.start()) and (stop := nested_end(t, b, e, m.start())):
                    return m.start(), stop
        elif found := re.compile(end, re.I).search(t, m.end()):
            return m.start(), found.end()
    return None


def plain_spans(t, kinds):
    out, at = [], 0
    while True:
        found = [(s[0], i, k, s[1]) for i, k in enumerate(kinds) if (s := first_from(t, k, at))]
        if not found:
            return out
        start, _, kind, end = min(found)
        out.append((kind, start, end))
        at = max(end, start + 1)


@given(st.lists(st.sampled_from(PARTS), max_size=25), st.lists(st.sampled_from(ALL), unique=True, max_size=17))
@settings(max_examples=600, deadline=None)
def test_spans_are_found_from_the_left(parts, kinds):
    t = "".join(parts)
    assert P.spans(t, tuple(kinds)) == plain_spans(t, kinds)


def test_nested_spans():
    t = "a {{b|{{c}} [[d]]}} }} {{e {{f}}\n{|\n{|\n|}\n|}\n<table><table></table></table> {{open"
    got = [(k, t[a:b]) for k, a, b in P.spans(t, ("template", "table"))]
    assert got == [("template", "{{b|{{c}} [[d]]}}"), ("template", "{{f}}"), ("table", "{|\n{|\n|}\n|}"), ("table", "<table><table></table></table>")]


@pytest.mark.parametrize("unit", ["{{", "}}", "[[", "[[a]", "<!--", "<ref>", "<ref ", "\n{|", "<table>", "<math ", "{{}}", "\n=", "=", "\n ", "http://a ", "{{[[<!--<ref><nowiki>"])
def test_time_grows_with_length(unit):
    def seconds(n):
        best = 1e9
        for _ in range(3):
            start = time.process_time()
            P.spans(unit * n, ALL)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(16_000) < 9 * max(seconds(4_000), 0.01)


def test_masks_and_rows(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(150)] + [None, "", "\ue000\ue001", "{{a}}" * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("m", P.mask()(F.col("t")))
    back = P.unmask(F.col("m.masked"), F.col("m.parts"))
    twice = P.unmask(F.concat("m.masked", "m.masked"), F.col("m.parts"))
    for r in frame.select("id", "m", back.alias("back"), twice.alias("twice")).collect():
        t = texts[r.id]
        assert r.back == t and r.twice == (None if t is None else t * 2)
        if t is not None:
            outside, at = [], 0
            for _, a, b in P.spans(t, ALL):
                outside.append(t[at:a])
                at = b
            outside = "".join([*outside, t[at:]])
            assert re.sub("\ue000\\d+\ue001", "", r.m.masked) == re.sub("[\ue000\ue001]", "", outside)
    rows = P.span_rows(frame.select("id", "t"), "id", "t").collect()
    want = {(k, i, kind, a, b - a, t[a:b]) for k, t in enumerate(texts) if t for i, (kind, a, b) in enumerate(P.spans(t, ALL))}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_brackets_as_rows(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["{{", "}}", "a", "{", "}", "é😀", "\n"]) for _ in range(rng.randrange(40))) for _ in range(120)] + [None, "", "{{" * 50 + "}}" * 70 + "{{x}}"]
    got = {tuple(r) for r in P.bracket_spans(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()}
    want = set()
    for k, t in enumerate(texts):
        open_ = []
        for m in re.finditer(r"\{\{|\}\}", t or ""):
            if m[0] == "{{":
                open_.append(m.start())
            elif open_:
                want.add((k, len(open_), start := open_.pop(), m.end() - start))
    assert got == want and want


def test_unknown_kinds_are_errors():
    with pytest.raises(ValueError, match="no such kinds"):
        P.protected("nothing")
