"""Window packing, fill-in-middle and whitening against brute force, with their edge cases."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagegraph.llm import fill_middle, queries, whitening, window_packing
from pagegraph.session import table

DOC = "doc_id long, text string, lang string, n_chars long, id string, key string, part int, ids binary, n long"
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", None, "x", "y", 3, b"z", 9) for i, t in rows], DOC)


def odd_texts():
    """Empty, blank, long, repeated, astral, composed and undecided texts."""
    long = "word " * 3000 + "\n\t " + "x" * 700 + " end  "
    return [None, "", " ", "\t\n " * 400, long, "Ünïcödé 😀🤦🏼‍♂️ " * 40, "a<P>b", "<S>", "tail  ", "  head", "é 각 Σας \x1cq", "a<|endoftext|>b", "It's we'll '' 'S"]


def vocabulary():
    return queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(exact, text):
    return [*exact.encode(text or "", add_special_tokens=False).ids, 1]


# ------------------------------------------------------------------ op11


@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["It's ", "́", "ᅡ", "ᆨ", "İ", "Σ", "Å", "²", "\x1f", "\u0085", "<|endoftext|>", "😀", "1٢", "n't'll", "_-"])), max_size=8))
@settings(max_examples=500, deadline=None)
def test_ids_are_the_tokenizer_s(exact, parts):
    text = "".join(parts)
    encode = window_packing.text_encoder(vocabulary())
    want = np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encode(text) == want
    assert encode(text, slice_chars=3) == want or window_packing.re.search("[\x1c-\x1f]", text)


def test_words_are_forgotten_beyond_a_bound(exact):
    w = window_packing.Words(exact, most=3)
    text = "one two three four five one " + "x" * 70
    assert w.ids(text) == np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes() and len(w) <= 3


def naive_best_fit_decreasing(lengths, size):
    free = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, x)
        gap = free.pop(at) if at < len(free) else size
        bisect.insort(free, gap - x)
    return free


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12), st.sampled_from([40, 64, 41]))
@settings(max_examples=300, deadline=None)
def test_best_fit_decreasing_is_the_plain_one(histogram, size):
    windows = window_packing.best_fit_decreasing(histogram, size)
    pieces = [x for x, n in histogram.items() for _ in range(n)]
    assert sorted(size - sum(w) for w, n in windows.items() for _ in range(n)) == naive_best_fit_decreasing(pieces, size)
    assert collections.Counter(x for w, n in windows.items() for _ in range(n) for x in w) == collections.Counter(pieces)


@given(st.sets(st.integers(0, 40)), st.integers(1, 40))
def test_tightest_capacity(open_, length):
    tree = window_packing.Capacities(40)
    for c in [*range(41)]:
        tree.set(c, True)
    for c in range(41):
        tree.set(c, c in open_)
    assert tree.tightest(length) == min((c for c in open_ if c >= length), default=None)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=12))
@settings(max_examples=300, deadline=None)
def test_plan_fills_windows_without_padding(histogram):
    size = 64
    plan = window_packing.Plan(histogram, size)
    spans, cut = collections.defaultdict(list), 0
    for length, n in histogram.items():
        window, offset = plan.find(length, np.arange(n))
        for w, o in zip(window.tolist(), offset.tolist(), strict=True):
            parts = [(0, length, w, o)] if w >= 0 else plan.cut(o, length)
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) == length
            cut += len(parts) > 1
            for _, k, w, o in parts:
                spans[w].append((o, k))
    assert sorted(spans) == list(range(plan.windows))
    fills = []
    for s in spans.values():
        at = 0
        for o, k in sorted(s):
            assert o == at
            at += k
        fills.append(at)
    assert all(window_packing.whole(f, size) and f <= size for f in fills)
    assert sum(f < size for f in fills) <= sum(window_packing.whole(sum(w), size) and sum(w) < size for w in window_packing.best_fit_decreasing(histogram, size)) * max(histogram.values()) + 6


def check_windows(rows, want, size):
    """want: Counter of (id, ids as a tuple)."""
    spans, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for s in spans.values():
        at = 0
        for o, k in sorted(s):
            assert o == at and k > 0
            at += k
        assert at <= size and window_packing.whole(at, size)
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    mine = collections.defaultdict(list)
    for (i, ids), n in want.items():
        mine[i, len(ids)] += [ids] * n
    assert set(pieces) == set(mine)
    for key, got in pieces.items():
        texts = mine[key]
        at = collections.Counter()
        for start, length, crc in got:
            assert any(zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc for ids in texts)
            at.update(range(start, start + length))
        assert at == collections.Counter({k: len(texts) for k in range(key[1])})


@pytest.mark.parametrize("size", [2048, 64])
def test_documents_lie_in_windows_without_padding(spark, exact, size):
    rows = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()] + [(900 + i, t) for i, t in enumerate(odd_texts())] + [(0, "again"), (0, "again"), (None, "no id"), (None, None)]
    got = window_packing.pack_windows(docs_of(spark, rows).repartition(5), vocabulary(), size=size).collect()
    check_windows(got, collections.Counter((i, tuple(ids_of(exact, t))) for i, t in rows), size)
    assert set(got[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_windows_that_nothing_fits_are_cut(spark, exact):
    """Documents of 1,500 tokens each leave windows half empty unless some are cut."""
    rows = [(i, "cat " * 1499) for i in range(40)]
    got = window_packing.pack_windows(docs_of(spark, rows), vocabulary()).collect()
    check_windows(got, collections.Counter((i, tuple(ids_of(exact, t))) for i, t in rows), 2048)
    assert sum(collections.Counter(r.doc_id for r in got)[i] == 1 for i in range(40)) >= 29  # those of the fullest windows stay whole


def test_windows_of_no_documents_and_of_text_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert window_packing.pack_windows(none, vocabulary()).collect() == []
    few = spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in window_packing.pack_windows(few, vocabulary()).collect()) == [(i, 0, 1, zlib.crc32(b"\x01\0\0\0"), 1) for i in "ab"]


# ------------------------------------------------------------------ op12


def brute_middle(doc_id, text):
    t = text or ""
    units = UNIT.findall(t)
    assert "".join(units) == t
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t, t
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", t


@pytest.mark.parametrize("block", [256, 7, 1])
def test_middles_are_cut_at_units(spark, block):
    rows = [(i, t) for i in (*range(12), None) for t in odd_texts()] + [(3, "same text"), (3, "same text"), (4, "a <b <P b> <S")] * 2
    rows += [(r.doc_id, r.text) for r in table(spark, DATA, "documents").limit(60).collect()]
    got = fill_middle.fill_in_middle(docs_of(spark, rows), block=block).withColumn("again", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    want = collections.Counter((i, *brute_middle(i, t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middle_of_each_ordinal(spark):
    """Ends of text and half sentinels beside the cuts."""
    for t in ("<", "S> <P <", "<S <M", "  ", "a  ", "<P\t>"):
        rows = [(i, t) for i in range(60)]
        got = fill_middle.fill_in_middle(docs_of(spark, rows), block=2, share=100).withColumn("again", fill_middle.restored(F.col("form"), F.col("output"))).collect()
        assert len(got) == 60 and all(r.again == t and r.form != "plain" for r in got)


def test_middle_is_native_and_empty(spark):
    none = docs_of(spark, [])
    assert fill_middle.fill_in_middle(none).collect() == []
    plan = queries.op12_fill_in_middle(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_middle_against_sql(spark, duck):
    got = queries.op12_fill_in_middle(spark, DATA)
    want = duck.execute(queries.OP12_SQL)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


# ------------------------------------------------------------------ op13


VEC = "vec_id long, embedding array<float>, label int, id string, x long, n long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VEC)


def brute_whitening(rows, most=16):
    """rows: (id, list of floats) that count."""
    x = {i: None for i in ()}
    x = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for _, v in rows]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    y = np.array([[(n * v[j] - s[j]) / n for j in range(d)] for v in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    deviation = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x]
    mine = np.array([[(n * v[j] - s[j]) / n for j in range(d)] for v in x])
    return n, deviation, mine @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n)


def check_whitening(got, rows, most=16):
    n, deviation, whitened, explained = brute_whitening(rows, most)
    k = whitened.shape[1]
    by = collections.defaultdict(dict)
    want = collections.defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        by[r.component].setdefault((r.vec_id, r.deviation), []).append(r)
    for j in range(k):
        sign = None
        want = collections.defaultdict(list)
        for i, (vec, _) in enumerate(rows):
            want[vec, deviation[i]].append(whitened[i, j])
        assert {key: len(v) for key, v in want.items()} == {key: len(v) for key, v in by[j + 1].items()}
        a = np.array([w for key in sorted(want, key=repr) for w in sorted(want[key])])
        b = np.array([w for key in sorted(want, key=repr) for w in sorted(r.whitened for r in by[j + 1][key])])
        sign = 1 if np.abs(a - b).max() <= np.abs(a + b).max() else -1
        c = a if sign == 1 else np.array([-w for key in sorted(want, key=repr) for w in sorted(want[key], reverse=True)])
        assert np.abs(c - b).max() < 1e-6
        assert abs(by[j + 1][next(iter(want))][0].explained / explained[j] - 1) < 1e-9
    assert set(by) == set(range(1, k + 1))


def test_whitening_is_the_plain_one(spark):
    rng = np.random.default_rng(5)
    base = [(i, (rng.normal(size=20) * np.linspace(0.5, 3, 20)).tolist()) for i in range(300)]
    rows = base + [base[0], (999, base[1][1]), (None, base[2][1])]
    out = [(1000, None), (1001, [1.0] * 19 + [None]), (1002, [float("nan")] * 20), (1003, [float("inf")] + [0.0] * 19), (1004, []), (1005, [1.0] * 7), (1006, [1e30] * 20)]
    got = whitening.whiten(vectors_of(spark, rows + out).repartition(4)).collect()
    check_whitening(got, rows)
    assert len(got) == 16 * len(rows)


def test_whitening_of_a_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, DATA, "embeddings").collect()]
    check_whitening(queries.op13_embedding_whitening(spark, DATA).collect(), rows)


def test_whitening_without_variance(spark):
    kind = lambda rows: whitening.whiten(vectors_of(spark, rows)).orderBy("vec_id", "component").collect()
    assert kind([]) == [] and kind([(1, None)]) == []
    one = kind([(1, [2.0, 3.0]), (2, [2.0, 3.0])])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    flat = kind([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [2.0, 5.0])])  # the second dimension is constant
    assert [r.whitened is None for r in flat] == [False, True] * 3 and all(r.identity_error < 1e-9 for r in flat)
    assert sorted(round(abs(r.whitened), 6) for r in flat if r.component == 1) == [0.0, 1.224745, 1.224745]
    assert [round(r.explained, 9) for r in flat[:2]] == [1.0, 0.0]


def test_whitening_deviations_beyond_a_long_are_null(spark):
    got = whitening.whiten(vectors_of(spark, [(1, [0.0]), (2, [1e12]), (3, [5e7])])).orderBy("vec_id").collect()
    xs = [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in (0.0, 1e12, 5e7)]
    want = [(3 * x - sum(xs)) ** 2 for x in xs]
    assert [r.deviation for r in got] == [v if v < 1 << 63 else None for v in want]
    assert whitening.Model(3, [0]).deviation(np.array([[7], [-5]])) == [441, 225]


def test_exact_sums_beyond_doubles(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(-(1 << 57), 1 << 57) for _ in range(3)],) for _ in range(500)]
    got = whitening.exact_sums(spark.createDataFrame(rows, "x array<long>").repartition(7))
    assert got == (500, [sum(r[0][j] for r in rows) for j in range(3)])
