"""Benchmark decontamination: a prefix-filtered set join with positional checks.

An item's windows are its runs of `window` consecutive words (the whole item if
it is shorter). Of each window's word shingles the rarest, by a count over all
documents, is its prefix token: as a window must be contained whole, one token
is a sufficient prefix. Documents are joined to windows on that token; each
joined pair fixes where the window would start, length and position bounds drop
starts outside the document, and the rest is compared word by word.

The benchmark is cut into blocks of at most `block_bytes` of text by a hash of
the item; each block is collected, indexed and broadcast by itself, and workers
hold one block's index at a time beyond the first, so a benchmark of any size
meets every document without a cross join and with bounded memory.

Defined results: null and empty documents have no words and no hits; items that
are null or have no words have no windows; repeated rows (documents or items)
give repeated rows and one item; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, ready_checkpoints
from .words import FOLD, texts

SHINGLE = 3
CODES = 1 << 63


class Index:
    """Windows of a block of items by their prefix tokens. Arrays only, so that it pickles small."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        split = [(item, text.translate(FOLD).split()) for item, text in items]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.base = len(self.vocabulary) + 1
        self.most = SHINGLE if self.base**SHINGLE < CODES else 2  # words of a shingle: codes of more would not fit
        seen: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, ws in split:
            ids = [self.vocabulary[w] for w in ws]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                seen[tuple(ids[i : i + window])].add(item)
        self.windows = sorted(seen)
        self.items = [sorted(seen[w]) for w in self.windows]
        self.size = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.matrix = np.zeros((len(self.windows), window), dtype=np.int64)
        for i, w in enumerate(self.windows):
            self.matrix[i, : len(w)] = w
        self.codes = {k: np.unique(np.concatenate([self.shingles(self.matrix[i, : self.size[i]], k) for i in np.flatnonzero(np.minimum(self.size, self.most) == k)] or [np.empty(0, np.int64)])) for k in range(1, self.most + 1)}
        self.anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def shingles(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Exact codes of k consecutive word ids (no hash)."""
        code = ids[: len(ids) - k + 1].astype(np.int64)
        for j in range(1, k):
            code = code * self.base + ids[j : len(ids) - k + 1 + j]
        return code

    def occurrences(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ids, place in codes[k]) of each known shingle of k known words."""
        if len(ids) < k or not len(self.codes[k]):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids > 0
        whole = known[: len(ids) - k + 1].copy()
        for j in range(1, k):
            whole &= known[j : len(ids) - k + 1 + j]
        at = np.flatnonzero(whole)
        code = ids[at].astype(np.int64)
        for j in range(1, k):
            code = code * self.base + ids[at + j]
        place = np.minimum(np.searchsorted(self.codes[k], code), len(self.codes[k]) - 1)
        same = self.codes[k][place] == code
        return at[same], place[same]

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Chooses each window's rarest shingle (ties: the first)."""
        chosen = defaultdict(list)
        for i, n in enumerate(self.size.tolist()):
            k = min(n, self.most)
            place = np.searchsorted(self.codes[k], self.shingles(self.matrix[i, :n], k))
            rare = min(range(len(place)), key=lambda j: (counts.get((k, int(place[j])), 0), j))
            chosen[k].append((int(place[rare]), i, rare))
        for k, rows in chosen.items():
            rows.sort()
            code, window, offset = np.array(rows, dtype=np.int64).T
            first = np.searchsorted(code, np.arange(len(self.codes[k]) + 1))
            self.anchors[k] = (first, window, offset, np.diff(first))

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def find(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence. doc: the document of each place; places between documents have id 0."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for k, (first, window, offset, many) in self.anchors.items():
            at, place = self.occurrences(ids, k)
            n = many[place]
            at, place, n = at[n > 0], place[n > 0], n[n > 0]
            row = np.repeat(first[place] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
            w, start = window[row], np.repeat(at, n) - offset[row]
            size = self.size[w]
            fits = (start >= 0) & (start + size <= len(ids))
            w, start, size = w[fits], start[fits], size[fits]
            fits = doc[start] == doc[start + size - 1]
            w, start, size = w[fits], start[fits], size[fits]
            for j in range(self.matrix.shape[1]):
                fits = (j >= size) | (ids[np.minimum(start + j, len(ids) - 1)] == self.matrix[w, j])
                w, start, size = w[fits], start[fits], size[fits]
            found.append((w, start))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """A broadcast index of each block. A block's text is bounded by block_bytes, give or take the hash's spread and one item; the driver holds one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("item is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)))
    return [sc.broadcast(Index([(r.item, r.text.encode()) for r in part.where(F.col("block") == i).collect()], window)) for i in range(n)]


def _load(shared, n: int, i: int):
    """Block i of n: the only one is kept; of several each is read when needed, by a twin of the broadcast that is forgotten with its value."""
    if n == 1:
        return shared[i].value
    twin = object.__new__(type(shared[i]))
    twin.__dict__.update(vars(shared[i]))
    return twin.value


def _split(batch) -> tuple[list[bytes], np.ndarray]:
    """All words of a batch, with b'' after each document, and each document's number of words."""
    words: list[bytes] = []
    sizes = []
    for t in texts(batch):
        ws = t.translate(FOLD).split()
        sizes.append(len(ws))
        words += ws
        words.append(b"")
    return words, np.array(sizes, dtype=np.int64)


def _indexes(few: DataFrame, benchmark: DataFrame, item_col: str, window: int, block_bytes: int) -> list:
    """Broadcasts of the benchmark's blocks, their windows' prefix tokens chosen by counts over all documents (column text)."""
    spark = few.sparkSession
    bounded_batches(spark)
    ready_checkpoints(spark)
    raw = _blocks(benchmark, item_col, "text", window, block_bytes)
    n = len(raw)

    def count(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            words, _ = _split(b)
            for i in range(n):
                index = _load(raw, n, i)
                ids = index.word_ids(words)
                for k, codes in index.codes.items():
                    if len(codes):
                        got = np.bincount(index.occurrences(ids, k)[1], minlength=len(codes))
                        totals[i, k] = totals.get((i, k), 0) + got
        for (i, k), got in totals.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(np.full(len(at), k)), pa.array(at), pa.array(got[at])], names=["block", "k", "code", "n"])

    counts = few.select("text").mapInArrow(count, "block long, k long, code long, n long").groupBy("block", "k", "code").agg(F.sum("n").alias("n")).checkpoint()
    shared = []
    for i in range(n):
        index = _load(raw, 2, i)
        index.order({(r.k, r.code): r.n for r in counts.where(F.col("block") == i).toLocalIterator()})  # at most one row for each shingle of the block
        shared.append(spark.sparkContext.broadcast(index))
    return shared


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _found(few: DataFrame, shared: list) -> DataFrame:
    """few with the columns FOUND."""
    n = len(shared)

    def join(batches):
        for b in batches:
            words, sizes = _split(b)
            doc = np.repeat(np.arange(len(sizes)), sizes + 1)
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            items: list[set[str]] = [set() for _ in sizes]
            for i in range(n):
                index = _load(shared, n, i)
                w, start = index.find(index.word_ids(words), doc)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + index.size[w], -1)
                if len(w):
                    for d, x in np.unique(np.stack([doc[start], w]), axis=1).T.tolist():
                        items[d].update(index.items[x])
            hits = np.bincount(doc, weights=np.cumsum(cover)[:-1] > 0, minlength=len(sizes)).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), pa.array(hits), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(hits > 0)], names=[*b.schema.names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema)
    return few.mapInArrow(join, f"{kind}, {FOUND}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    few = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return _found(few, _indexes(few.select("text"), benchmark, item_col, window, block_bytes)).drop("text").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """docs, all columns, without the contaminated documents."""
    names = docs.columns
    inner = docs.toDF(*["text" if c == text_col else f"c{i}" for i, c in enumerate(names)])
    found = _found(inner, _indexes(inner.select("text"), benchmark, item_col, window, block_bytes))
    return found.where("not contaminated").select(*inner.columns).toDF(*names)
