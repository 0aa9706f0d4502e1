"""Full-text clauses, scores and edge cases; alignments and chains of revisions against plain loops."""

import collections
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagegraph.operators import blame, fulltext


def plain_search(docs, text, natural=False):
    """docs: id -> text. Every clause looked for in every text."""
    asked = fulltext.clauses(text, natural)
    ws = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs.items()}

    def count(c, w):
        if c.prefix:
            return sum(x.startswith(c.words[0]) for x in w)
        k = len(c.words)
        return sum(tuple(w[i : i + k]) == c.words for i in range(len(w) - k + 1))

    n = {i: [count(c, w) for c in asked] for i, w in ws.items()}
    idf = [math.log10(len(docs) / f) ** 2 if (f := sum(v[k] > 0 for v in n.values())) else 0 for k in range(len(asked))]
    out = {}
    for i, v in n.items():
        must = [v[k] for k, c in enumerate(asked) if c.sign == "+"]
        may = [v[k] for k, c in enumerate(asked) if c.sign == ""]
        if (all(must) if must else any(may)) and not any(v[k] for k, c in enumerate(asked) if c.sign == "-"):
            counted = [k for k, c in enumerate(asked) if c.sign != "-"]
            out[i] = sum(v[k] for k in counted), sum((-1 if asked[k].sign == "~" else 1) * v[k] * idf[k] for k in counted)
    return out


TEXTS = ["The cat saw the CAT", "the the the cat", "cat: the catalogue of 7 cats", None, "", "dog, the cat's dog", "über den Straßen", "dog dog", "a_b the cat saw", "cat " * 50]


@pytest.mark.parametrize(
    "text",
    ["cat", "+cat -dog", "+cat ~dog the", '"the cat"', '+"the the" cat', "cat*", "+cat* -catalogue", "-cat", "~cat", "", "+", '""', "nowhere", "+nowhere cat", "ÜBER dog", "cat cat", '"the cat saw the cat"', "a_b", '-"cat saw" the', "+the +saw +cat"],
)
def test_clauses_find_what_a_loop_finds(spark, tmp_path, text):
    docs = dict(enumerate(TEXTS))
    frame = spark.createDataFrame([(i, t, "w", 3) for i, t in docs.items()], "doc_id long, text string, word string, place int").repartition(3)
    fulltext.write_index(frame, "doc_id", "text", str(tmp_path / "index"))
    for natural in (False, True):
        got = {r.doc: (r.occurrences, r.relevance) for r in fulltext.search(fulltext.read_index(spark, str(tmp_path / "index")), len(docs), text, natural).collect()}
        want = plain_search(docs, text, natural)
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_an_empty_index(spark, tmp_path):
    fulltext.write_index(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", str(tmp_path / "index"))
    index = spark.read.schema("word string, doc long, place int").parquet(str(tmp_path / "index"))
    assert fulltext.search(index, 0, "cat").collect() == []


def test_the_index_skips_other_words(spark, tmp_path):
    """Words are pushed to the scan, and no text is shuffled to build the index."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    fulltext.write_index(frame, "doc_id", "text", str(tmp_path / "index"))
    lists = fulltext.postings(fulltext.read_index(spark, str(tmp_path / "index")), fulltext.Clause("+", ("cat",)))
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,cat)]" in lists._jdf.queryExecution().toString()


# ------------------------------------------------------------------ blame


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


WORDS = st.lists(st.integers(0, 4), max_size=14)


@given(WORDS, WORDS, st.sampled_from([0, 6, 1 << 22]))
@settings(max_examples=400, deadline=None)
def test_alignments_are_longest(a, b, cells):
    pairs = blame.align(a, b, cells)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    if cells > len(a) * len(b):
        assert len(pairs) == longest_common(a, b)


@given(WORDS, WORDS)
@settings(max_examples=100, deadline=None)
def test_halves_find_a_longest_too(a, b):
    whole, blame.CELLS = blame.CELLS, 4
    try:
        assert len(blame._common(a, b)) == longest_common(a, b)
    finally:
        blame.CELLS = whole


def test_long_texts_are_cut_at_anchors():
    rng = random.Random(1)
    old = [rng.randrange(10**6) for _ in range(30_000)]
    new = old[:10_000] + [-1] * 50 + old[10_000:20_000] + old[25_000:]
    assert len(blame.align(old, new)) == 25_000


@given(st.lists(WORDS, min_size=2, max_size=6))
@settings(max_examples=200, deadline=None)
def test_composed_runs_are_the_steps_one_by_one(texts):
    runs = [blame.runs_of([], len(texts[0]), 0)] + [blame.runs_of(blame.align(a, b), len(b), k + 1) for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False))]
    owner = [0] * len(texts[0])
    for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False)):
        came = {j: i for i, j in blame.align(a, b)}
        owner = [owner[came[j]] if j in came else k + 1 for j in range(len(b))]
    left = runs[0]
    for r in runs[1:]:
        left = blame.composed(left, r)
    right = runs[-1]
    for r in reversed(runs[:-1]):
        right = blame.composed(r, right)
    assert [r for n, s, r in left for _ in range(n)] == [r for n, s, r in right for _ in range(n)] == owner


def plain_blame(rows):
    """rows: (page, order, text). The chain of each page step by step."""
    pages, out = collections.defaultdict(set), collections.Counter()
    for page, at, text in rows:
        pages[page].add((at, text or ""))
    import hashlib

    for page, revisions in pages.items():
        chain = sorted(revisions, key=lambda r: (r[0] is not None, r[0], hashlib.sha256(r[1].encode()).hexdigest()))
        words, owner = [], []
        for at, text in chain:
            new = re.findall(r"[^ \t\n\x0b\f\r]+", text)
            number = {}
            a, b = ([number.setdefault(w, len(number)) for w in x] for x in (words, new))
            came = {j: i for i, j in blame.align(a, b)}
            words, owner = new, [owner[came[j]] if j in came else at for j in range(len(new))]
        out.update((page, j, w, o) for j, (w, o) in enumerate(zip(words, owner, strict=True)))
    return out


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_blame_of_long_and_odd_chains(spark, fan):
    rng = random.Random(4)
    words, rows = [], []
    for turn in range(70):  # one page that is edited seventy times
        for _ in range(3):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(3)] = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(4))]
        rows.append((1, turn * 10, " ".join(words)))
    rows += [(2, 1, None), (2, 2, "a b"), (2, 3, ""), (2, 4, "b a"), (None, 5, "x y"), (None, 6, "y\tx y\n"), (3, 1, "same"), (3, 1, "same"), (3, 1, "other same"), (4, None, "p q"), (4, 0, "q p q"), (5, 7, None)]
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, at long, text string, mark string, rev int")
    got = blame.blame_words(frame, "page_id", "at", "text", fan).collect()
    assert collections.Counter((r.page_id, r.place, r.word, r.revision) for r in got) == plain_blame(rows)
    none = spark.createDataFrame([], "page_id long, at long, text string")
    assert blame.blame_words(none, "page_id", "at", "text").collect() == []
