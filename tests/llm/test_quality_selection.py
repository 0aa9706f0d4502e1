"""Co-training against a plain loop over all rows, and repeated rows that differ in their metadata."""

import collections

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from pagegraph.llm import quality
from pagegraph.session import table


def test_repeated_rows_with_and_without_size(spark):
    """Each row twice, once without n_chars: equal ids, texts and hashes, vectors that differ in a null."""
    docs = table(spark, DATA.replace("sf0.001", "sf0.01"), "documents")
    twice = docs.unionByName(docs.withColumn("n_chars", F.lit(None).cast("long")))
    rows = quality.classify_quality(twice, table(spark, DATA.replace("sf0.001", "sf0.01"), "labels")).collect()
    assert collections.Counter(r.doc_id for r in rows) == {r.doc_id: 2 for r in docs.collect()}


def test_surest_of_repeated_ids(spark):
    """Ties beyond probability and hash are settled by the vectors, nulls among them, whatever the partitions."""
    model = quality.Model(quality.TextView({b"fine": 0}, np.zeros(1), np.ones(1), np.array([4.0, 0.0, 0.0])), quality.MetaView({}, np.array([0.0, 0.0, 0.0, 0.0])))
    rows = [(i % 3, 5, [0], [0.0], [i % 2], None if i % 5 else 1.0) for i in range(40)]
    frame = spark.createDataFrame(rows, f"id long, tie long, {quality._VECTOR}")
    got = [sorted(map(repr, quality._surest(frame.repartition(n), "bigint", model, 0.9, 7))) for n in (1, 6)]
    assert got[0] == got[1] and len(got[0]) == 7


def plain_fit(docs, labels, known, give=300, sure=0.97, rounds=3):
    """The model of the docstring by loops over all rows. docs: (id, text, marks, size, hash); known: id -> (good, held)."""
    n = collections.Counter(good for good, held in known.values() if not held)
    counts = collections.defaultdict(lambda: [0, 0])
    for i, text, *_ in docs:
        if i in known and not known[i][1]:
            for w in set(quality.words(text)):
                counts[w][0] += 1
                counts[w][1] += known[i][0]
    total, good = sum(n.values()), n[1]
    chi = {}
    for w, (a, g) in counts.items():
        if 3 <= a < total:
            d = float(g * (total - good) - (a - g) * good)
            x = total * d * d / (a * (total - a) * good * (total - good))
            if x >= 15:
                chi[w] = x
    view = quality.TextView({w: k for k, w in enumerate(sorted(chi, key=lambda w: (-chi[w], w))[:400])})
    vectors = {}
    for i, text, marks, size, tie in docs:
        kinds, stats = quality.features(text)
        vectors[i] = (view.places(kinds), stats, marks, size), tie
    fit, held = ([i for i in sorted(known) if known[i][1] == h] for h in (False, True))
    stats = np.array([vectors[i][0][1] for i in fit])
    view.mean, view.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    seen = collections.Counter(m for i in fit for m in vectors[i][0][2])
    model = quality.Model(view, quality.MetaView({m: k for k, (m, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:200])}))

    def surest(m):
        out = []
        fresh = [(i, v, tie) for i, (v, tie) in vectors.items() if i not in labels]
        for k, z in enumerate(m.logits([v for _, v, _ in fresh])):
            p = quality.probability(z)
            for label, q in ((0, 1 - p), (1, p)):
                ranked = sorted(((-x, -tie, i, v) for x, (i, v, tie) in zip(q, fresh, strict=True) if x >= sure), key=lambda e: e[:3])
                out += [(i, k, label, v) for *_, i, v in ranked[:give]]
        return out

    y = [np.array([known[i][0] for i in x], float) for x in (fit, held)]
    model = quality.co_train(model, [vectors[i][0] for i in fit], y[0], [vectors[i][0] for i in held], y[1], surest, rounds)
    return {i: model.score([v])[2][0] for i, (v, _) in vectors.items()}


def test_whole_selection_is_the_plain_one(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit("lang"), "lang"), F.xxhash64(F.lit("source"), "source"), F.col("n_chars").cast("double"), F.xxhash64("doc_id")).collect()
    judged = {r.doc_id: int(r.quality == 1 and (r.toxic or 0) == 0) for r in labels.where("quality is not null").collect()}
    held = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).collect()}
    want = plain_fit([(i, (t or "").encode(), [a, b], n, h) for i, t, a, b, n, h in rows], judged, {i: (g, held[i]) for i, g in judged.items() if i in held})
    got = {r.doc_id: r.score for r in quality.classify_quality(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6
