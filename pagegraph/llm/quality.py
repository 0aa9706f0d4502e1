"""Quality classification by co-training.

Two views of a document each have a logistic classifier: text content (shares
of character classes, repetition, and the words that tell labelled classes
apart) and page metadata (language, source, length). In each round a view hands
its confident decisions on unlabelled documents to the other view's training
set. In the end both are calibrated on a fold of labels they never saw, a
second logistic step combines them, and every document is scored.

A good document has quality 1 and is not toxic. The fit uses at most `labelled`
labelled rows, the least by a hash of the id. Words are chosen by counts that are
made where the documents are. One pass reduces every document to its vector (the
chosen words it has, some shares, hashes of its metadata); each round scores the
vectors of all unlabelled documents and draws from them, for each view and class,
the `give` surest. Only those and the labelled rows' vectors, which have a bounded
size whatever the texts' lengths, reach the driver. All documents are scored,
without a shuffle.

Defined results: null and empty texts are scored by their empty features; null
metadata is a category of its own; of several labels for an id the worst
counts, null labels none; with fewer than 20 labels, or one class only, all
documents score 1 and are kept; repeated rows stay and have equal scores (of an
id's different rows one is learned from); an empty table gives no rows; other
columns are ignored or kept as they are.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, ready_checkpoints
from .words import texts, words

_CLASSES = [bytes(range(65, 91)), b"0123456789", b"!", b"|", b"%#$*&@~^", b".,;:?'\"()-", b"\n", b" \t\r", b"<>{}[]=/\\_`+"]


def text_stats(text: bytes, ws: list[bytes], kinds: set[bytes]) -> list[float]:
    """Shares of character classes, lengths and repetition."""
    n, k = len(text) or 1, len(ws) or 1
    shares = [(len(text) - len(text.translate(None, c))) / n for c in _CLASSES]
    lines = text.split(b"\n")
    return [*shares, math.log1p(len(ws)), sum(map(len, ws)) / k, len(kinds) / k, len(kinds) / math.sqrt(k), 1 - len(set(lines)) / len(lines), float(not ws)]


def features(text: bytes) -> tuple[set[bytes], list[float]]:
    ws = words(text)
    kinds = set(ws)
    return kinds, text_stats(text, ws, kinds)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25, center: float = 0.0) -> np.ndarray:
    """Weights, shrunk towards a centre, and the intercept, which is not, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.full(x.shape[1], float(center))
    w[-1] = 0.0
    to = w.copy()
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + shrink * (w - to)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class TextView:
    chosen: dict[bytes, int]
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: np.ndarray | None = None

    def places(self, kinds: set[bytes]) -> list[int]:
        """Numbers of the chosen words among some."""
        return sorted(self.chosen[k] for k in kinds & self.chosen.keys())

    def matrix(self, places: list[list[int]], stats: np.ndarray) -> np.ndarray:
        m = len(self.chosen)
        x = np.zeros((len(places), m + stats.shape[1]))
        for i, at in enumerate(places):
            x[i, at] = 1.0
        x[:, m:] = np.clip((stats - self.mean) / self.scale, -6, 6)
        return x


@dataclass
class MetaView:
    codes: dict[int, int] = field(default_factory=dict)
    w: np.ndarray | None = None

    def matrix(self, marks: list[list[int]], sizes: list[float | None]) -> np.ndarray:
        x = np.zeros((len(marks), len(self.codes) + 3))
        for i, (own, v) in enumerate(zip(marks, sizes, strict=True)):
            x[i, [self.codes[k] for k in own if k in self.codes]] = 1.0
            x[i, -3:] = (0, 0, 1) if v is None else (math.log1p(max(0, v)) / 10, (math.log1p(max(0, v)) / 10) ** 2, 0)
        return x


#: A document's vector: chosen words, shares, hashes of its metadata, characters.
Vector = tuple[list[int], list[float], list[int], float | None]


@dataclass
class Model:
    text: TextView
    meta: MetaView
    calibrate: tuple[np.ndarray, np.ndarray] | None = None
    combine: np.ndarray | None = None

    def matrices(self, rows: list[Vector]) -> tuple[np.ndarray, np.ndarray]:
        return self.text.matrix([r[0] for r in rows], np.array([r[1] for r in rows])), self.meta.matrix([r[2] for r in rows], [r[3] for r in rows])

    def logits(self, rows: list[Vector]) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ v.w[:-1] + v.w[-1] for x, v in zip(self.matrices(rows), (self.text, self.meta), strict=True))

    def score(self, rows: list[Vector]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (z * c[0] + c[1] for z, c in zip(self.logits(rows), self.calibrate, strict=True))
        return probability(a), probability(b), probability(a * self.combine[0] + b * self.combine[1] + self.combine[2])


def co_train(model: Model, fit: list[Vector], y: np.ndarray, held: list[Vector], t: np.ndarray, surest, rounds: int = 3) -> Model:
    """Fits both views on labelled vectors and, round by round, on what surest(model) gives: (id, view that is sure, its label, vector)."""
    data = model.matrices(fit)
    given: list[dict] = [{}, {}]  # what the text view and the metadata view are taught: id -> (label, vector)
    for turn in range(rounds + 1):
        for k, view in enumerate((model.text, model.meta)):
            got = [given[k][i] for i in sorted(given[k])]
            x = np.concatenate([data[k], model.matrices([v for _, v in got])[k]]) if got else data[k]
            view.w = logistic(x, np.concatenate([y, [label for label, _ in got]]), np.concatenate([np.ones(len(y)), np.full(len(got), 0.3)]))
        if turn == rounds:
            break
        fresh: list[dict] = [{}, {}]
        for i, view, label, vector in surest(model):
            fresh[1 - view].setdefault(i, (label, vector))  # of an id's different rows the surest
        for k in (0, 1):
            given[k] |= fresh[k]
    z = model.logits(held)
    # Few held-out labels leave slopes near one; a view is never turned round.
    model.calibrate = tuple(np.maximum(logistic(a[:, None], t, ridge=5.0, center=1.0), [0.0, -np.inf]) for a in z)
    both = np.stack([a * c[0] + c[1] for a, c in zip(z, model.calibrate, strict=True)], axis=1)
    model.combine = np.maximum(logistic(both, t, ridge=5.0, center=1.0), [0.0, 0.0, -np.inf])
    return model


# ----------------------------------------------------------------- the job


def _inputs(docs: DataFrame, text_col: str, meta_cols: tuple[str, ...]) -> list:
    """Columns text, marks (a hash for each column of metadata and its value) and size."""
    marks = [F.xxhash64(F.lit(c), F.col(c).cast("string")) for c in meta_cols if c in docs.columns and c != "n_chars"]
    size = F.col("n_chars").cast("double") if "n_chars" in meta_cols and "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.col(text_col).cast("string").alias("text"), F.array(*marks).cast("array<long>").alias("marks"), size.alias("size")]


def _chosen_words(fit: DataFrame, most: int) -> dict[bytes, int]:
    """Words whose presence depends on the class by a chi-square of 15 or more, the strongest first. fit: (text, good)."""

    def count(batches):
        totals: dict[bytes, list[int]] = {}
        for b in batches:
            for t, good in zip(texts(b), b.column(1).to_pylist(), strict=True):
                for w in set(words(t)):
                    got = totals.setdefault(w, [0, 0])
                    got[0] += 1
                    got[1] += good
            if len(totals) > 200_000:
                yield rows(totals)
                totals.clear()
        yield rows(totals)

    def rows(totals):
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()), pa.array([v[0] for v in totals.values()], pa.int64()), pa.array([v[1] for v in totals.values()], pa.int64())], names=["word", "a", "g"])

    n, good = fit.agg(F.count("*"), F.sum("good")).first()
    a, g = F.col("a"), F.col("g")
    d = (g * (n - good) - (a - g) * good).cast("double")
    chi = n * d * d / (a * (n - a) * good * (n - good))
    counts = fit.select("text", "good").mapInArrow(count, "word binary, a long, g long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("g").alias("g"))
    best = counts.where((a >= 3) & (a < n)).withColumn("chi", chi).where("chi >= 15").orderBy(F.desc("chi"), "word").limit(most).collect()
    return {bytes(r.word): i for i, r in enumerate(best)}


def _vectors(batch: pa.RecordBatch, text: TextView) -> list[Vector]:
    got = []
    for t in texts(batch):
        ws = words(t)
        kinds = set(ws)
        got.append((text.places(kinds), text_stats(t, ws, kinds)))
    marks, sizes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("marks", "size"))
    return [(*g, m, v) for g, m, v in zip(got, marks, sizes, strict=True)]


_VECTOR = "places array<int>, stats array<double>, marks array<long>, size double"


def _vector_arrays(rows: list[Vector]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.float64()))]


def _read_vectors(b: pa.RecordBatch) -> list[Vector]:
    return list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("places", "stats", "marks", "size")), strict=True))


def _rank(entry: tuple) -> tuple:
    """The surest first, then by the hash of the id; repeated ids by all that their vectors hold, nulls included."""
    q, tie, i, (places, stats, marks, size) = entry
    return -q, -tie, places, stats, repr((marks, size)), i


def _surest(fresh: DataFrame, kind: str, model: Model, sure: float, give: int) -> list[tuple]:
    """(id, view, label, vector): of all unlabelled vectors the `give` surest of each view and class, by probability, then by a hash of the id.

    Tasks keep `give` of each, and a tree of merges keeps `give` of any two of them.
    """
    shared = fresh.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        best: dict[tuple[int, int], list] = {}
        for b in batches:
            rows = _read_vectors(b)
            if not rows:
                continue
            ids, ties = b.column(0).to_pylist(), b.column(1).to_pylist()
            for view, z in enumerate(shared.value.logits(rows)):
                p = probability(z)
                for label, q in ((1, p), (0, 1 - p)):
                    got = best.get((view, label), [])
                    least = got[-1][0] if len(got) == give else sure  # the surest come first
                    new = [(float(q[i]), ties[i], ids[i], rows[i]) for i in np.flatnonzero(q >= least)]
                    best[view, label] = heapq.nsmallest(give, got + new, key=_rank)
        out = [(view, label, *e) for (view, label), got in best.items() for e in got]
        names = ["view", "label", "q", "tie", "id", "places", "stats", "marks", "size"]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.float64()), pa.array([r[3] for r in out], pa.int64()), pa.array([r[4] for r in out], kind_of), *_vector_arrays([r[5] for r in out])], names=names)

    def add(best, r):
        got = best.setdefault((r.view, r.label), [])
        got.append((r.q, r.tie, r.id, (r.places, r.stats, r.marks, r.size)))
        if len(got) > 4 * give:
            got[:] = heapq.nsmallest(give, got, key=_rank)
        return best

    def merge(a, b):
        return {k: heapq.nsmallest(give, a.get(k, []) + b.get(k, []), key=_rank) for k in a.keys() | b.keys()}

    kind_of = pa.int64() if kind == "bigint" else pa.string()
    some = fresh.mapInArrow(judge, f"view int, label int, q double, tie long, id {kind}, {_VECTOR}")
    best = some.rdd.treeAggregate({}, add, merge, depth=2)
    return [(i, view, label, vector) for (view, label), got in sorted(best.items()) for _, _, i, vector in heapq.nsmallest(give, got, key=_rank)]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), labelled: int = 6000, rounds: int = 3, sure: float = 0.97, give: int = 300, most_words: int = 400, most_marks: int = 200) -> Model | None:
    """The model, from at most `labelled` labelled rows and all unlabelled ones; None with fewer than 20 labels or one class only."""
    ready_checkpoints(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    # Ids travel as integers or as text; every fifth, by a hash, is held out.
    kind = "bigint" if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    own = F.col(id_col).cast(kind)
    judged = labels.select(own.alias("id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int").alias("good")).where("good is not null and id is not null").groupBy("id").agg(F.min("good").alias("good"))
    tie = F.xxhash64("id")
    known = docs.select(own.alias("id")).join(judged, "id").distinct().orderBy(tie, "id").limit(labelled).withColumn("held", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).checkpoint()  # at most `labelled` rows
    n = {(r.good, r.held): r.n for r in known.groupBy("good", "held").agg(F.count("*").alias("n")).collect()}
    if sum(n.values()) < 20 or len(n) < 4:
        return None
    every = docs.select(own.alias("id"), *_inputs(docs, text_col, meta_cols)).where("id is not null")
    text = TextView(_chosen_words(every.join(F.broadcast(known.where("not held")), "id").select("text", "good"), most_words))

    def reduce(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("tie")), *_vector_arrays(_vectors(b, text))], names=["id", "tie", "places", "stats", "marks", "size"])

    vectors = every.withColumn("tie", tie).mapInArrow(reduce, f"id {kind}, tie long, {_VECTOR}").checkpoint()
    # One row an id, by aggregation, however often an id is repeated.
    rows = vectors.join(F.broadcast(known), "id").groupBy("id", "good", "held").agg(F.max(F.struct("places", "stats", "marks", "size")).alias("v")).select("id", "good", "held", "v.*").collect()
    rows.sort(key=lambda r: r.id)
    fresh = vectors.join(judged.select("id"), "id", "left_anti").checkpoint()  # each round reads it
    fit, held = ([r for r in rows if r.held == h] for h in (False, True))
    as_vector = lambda r: (r.places, r.stats, r.marks, r.size)
    stats = np.array([r.stats for r in fit])
    text.mean, text.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    seen = Counter(m for r in fit for m in r.marks)
    model = Model(text, MetaView({m: i for i, (m, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most_marks])}))
    marks = [np.array([r.good for r in x], float) for x in (fit, held)]
    return co_train(model, [as_vector(r) for r in fit], marks[0], [as_vector(r) for r in held], marks[1], lambda m: _surest(fresh, kind, m, sure, give), rounds)


def _scored(docs: DataFrame, model: Model | None, text_col: str, meta_cols: tuple[str, ...], least: float) -> DataFrame:
    """docs' columns by place as c0, c1, ... (so that any names may occur) with p_text, p_meta, score and keep."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    if model is None:
        return docs.toDF(*[f"c{i}" for i in range(len(names))]).select("*", *[F.lit(1.0).alias(c) for c in ("p_text", "p_meta", "score")], F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Texts that are strings already go to the workers once.
    text = next((i for i, f in enumerate(docs.schema) if f.name == text_col and f.dataType.simpleString() == "string"), None)
    inputs = _inputs(docs, text_col, meta_cols)
    inner = docs.select(*[F.col(f"`{c}`").alias("text" if i == text else f"c{i}") for i, c in enumerate(names)], *(inputs if text is None else inputs[1:]))

    def run(batches):
        m = shared.value
        for b in batches:
            if b.num_rows:
                p = m.score(_vectors(b, m.text))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *[pa.array(x) for x in p], pa.array(p[2] >= least)], names=out)

    out = [*[f"c{i}" for i in range(len(names))], "p_text", "p_meta", "score", "keep"]
    kind = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return inner.mapInArrow(run, f"{kind}, p_text double, p_meta double, score double, keep boolean")


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), least: float = 0.5) -> DataFrame:
    """One row per document: id, p_text, p_meta, score, keep."""
    few = docs.select(id_col, text_col, *[c for c in meta_cols if c in docs.columns])
    return _scored(few, fit_quality(few, labels, id_col, text_col, meta_cols), text_col, meta_cols, least).select(F.col("c0").alias(id_col), "p_text", "p_meta", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), least: float = 0.5) -> DataFrame:
    """docs, all columns, without the documents the classifier rejects."""
    scored = _scored(docs, fit_quality(docs, labels, id_col, text_col, meta_cols), text_col, meta_cols, least)
    return scored.where("keep").select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
