"""Blame: which revision brought each word of a page's last text.

Consecutive revisions are aligned word by word, each pair in a task of its own:
equal beginnings and ends are set apart; what is left is aligned by a longest
common subsequence, and if it is large it is first cut at anchors (words that both
sides hold once, in the longest order that both share). An alignment is a list of
runs: words that stay, from where, and words that are new.

Runs of consecutive pairs are composed by levels: up to `fan` neighbours become
one, then up to `fan` of those, until a chain is one row. So a chain of any length
takes few levels, no task holds more than `fan` alignments, and none of them is
longer than the text of its last revision.

Defined results: words are runs without white space; null and empty texts have
none, and what comes back after them is new; revisions of equal place are taken in
order of their text; a null page is a page of its own.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_batches, ready_checkpoints

#: Beyond so many cells of a table the texts are cut at anchors first.
CELLS = 1 << 22

_words = re.compile(r"[^ \t\n\x0B\f\r]+").findall

Pairs = list[tuple[int, int]]


def _table_rows(a: list[int], b: list[int]) -> Iterator[np.ndarray]:
    """Row by row, the lengths of longest common subsequences of a prefix of a and all prefixes of b."""
    other = np.array(b, np.int64)
    row = np.zeros(len(b) + 1, np.int32)
    yield row
    for x in a:
        new = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (other == x)), out=new[1:])
        row = new
        yield row


def _common(a: list[int], b: list[int]) -> Pairs:
    """A longest common subsequence; halves of a where the table would be large, so that memory grows with the texts only."""
    out: Pairs = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i0, i1, j0, j1 = work.pop()
        if i0 == i1 or j0 == j1:
            continue
        if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > CELLS:
            mid = (i0 + i1) // 2
            for above in _table_rows(a[i0:mid], b[j0:j1]):
                pass
            for below in _table_rows(a[mid:i1][::-1], b[j0:j1][::-1]):
                pass
            cut = j0 + int(np.argmax(above + below[::-1]))
            work += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
            continue
        rows = list(_table_rows(a[i0:i1], b[j0:j1]))
        i, j = i1 - i0, j1 - j0
        while i and j:
            if rows[i - 1][j] == rows[i][j]:
                i -= 1
            elif rows[i][j - 1] == rows[i][j]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i0 + i, j0 + j))
    return out


def _anchors(a: list[int], b: list[int]) -> Pairs:
    """Words that both sides hold once, in a longest order that both share."""
    once_a, once_b = ({w for w, n in Counter(x).items() if n == 1} for x in (a, b))
    where = {w: j for j, w in enumerate(b) if w in once_b and w in once_a}
    pairs = [(i, where[w]) for i, w in enumerate(a) if w in where]
    ends: list[int] = []  # the last places in b of the best rising runs of each length
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(ends, j)
        ends[at : at + 1] = [j]
        last[at : at + 1] = [k]
        before.append(last[at - 1] if at else -1)
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(old: list[int], new: list[int], cells: int | None = None) -> Pairs:
    """Pairs of places of words that stay, rising in both."""
    cells = CELLS if cells is None else cells
    out: Pairs = []
    work = [(0, len(old), 0, len(new), True)]
    while work:
        i0, i1, j0, j1, cut = work.pop()
        while i0 < i1 and j0 < j1 and old[i0] == new[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and old[i1 - 1] == new[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        a, b = old[i0:i1], new[j0:j1]
        anchors = _anchors(a, b) if cut and len(a) * len(b) > cells else []
        if anchors:
            i, j = 0, 0
            for p, q in [*anchors, (len(a), len(b))]:
                work.append((i0 + i, i0 + p, j0 + j, j0 + q, True))
                i, j = p, q  # the anchor is the equal beginning of the next part
        else:
            out += [(i0 + p, j0 + q) for p, q in _common(a, b)]
    return sorted(out)


Runs = list[tuple[int, int, int]]  # (length, first place in the older text or -1, revision that brought it or -1)


def runs_of(pairs: Pairs, words: int, revision: int) -> Runs:
    """An alignment as runs over the newer text's words."""
    out: list[list[int]] = []
    came = dict((j, i) for i, j in pairs)
    for j in range(words):
        i = came.get(j, -1)
        if out and (out[-1][1] + out[-1][0] == i if i >= 0 and out[-1][1] >= 0 else i < 0 and out[-1][1] < 0):
            out[-1][0] += 1
        else:
            out.append([1, i, -1 if i >= 0 else revision])
    return [tuple(r) for r in out]


def composed(older: Runs, newer: Runs) -> Runs:
    """Runs from the oldest to the newest text through the one between."""
    starts = [0]
    for n, _, _ in older:
        starts.append(starts[-1] + n)
    out: list[list[int]] = []
    for n, at, revision in newer:
        parts = [[n, -1, revision]] if at < 0 else []
        while at >= 0 and n:
            k = bisect.bisect_right(starts, at) - 1
            m, source, brought = older[k]
            inside = at - starts[k]
            take = min(n, m - inside)
            parts.append([take, source + inside if source >= 0 else -1, brought])
            at, n = at + take, n - take
        for p in parts:
            if out and out[-1][2] == p[2] and (p[1] < 0 if out[-1][1] < 0 else out[-1][1] + out[-1][0] == p[1]):
                out[-1][0] += p[0]
            else:
                out.append(p)
    return [tuple(r) for r in out]


_RUNS = "array<struct<n: int, source: int, revision: int>>"
_RUNS_ARROW = pa.list_(pa.struct([("n", pa.int32()), ("source", pa.int32()), ("revision", pa.int32())]))


def _runs_column(rows: list[Runs]) -> pa.Array:
    return pa.array([[{"n": n, "source": s, "revision": r} for n, s, r in runs] for runs in rows], _RUNS_ARROW)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, rev, rev's text, the text before) -> (page, rev, runs)."""
    for b in batches:
        out = []
        for rev, text, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            new, old = _words(text), _words(before or "")
            number: dict[str, int] = {}
            a, c = ([number.setdefault(w, len(number)) for w in x] for x in (old, new))
            out.append(runs_of(align(a, c), len(c), rev))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _runs_column(out)], names=["page", "rev", "runs"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, rev, up to `fan` runs in order) -> (page, rev, their composition)."""
    for b in batches:
        out = []
        for parts in b.column(2).to_pylist():
            chain = [[(x["n"], x["source"], x["revision"]) for x in p["runs"]] for p in parts]
            runs = chain[-1]
            for older in reversed(chain[:-1]):
                runs = composed(older, runs)
            out.append(runs)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _runs_column(out)], names=["page", "rev", "runs"])


def blame_words(revisions: DataFrame, page_col: str, order_col: str, text_col: str, fan: int = 32) -> DataFrame:
    """(page, place, word, revision): each word of each page's last text, with the order of the revision that brought it."""
    spark = revisions.sparkSession
    ready_checkpoints(spark)
    bounded_batches(spark)
    page = F.struct(F.col(page_col).alias("p"))  # a struct is never null, so a null page meets itself
    rows = revisions.select(page.alias("page"), F.col(order_col).alias("at"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.sha2("text", 256))
    # Only keys are numbered in order; texts meet their predecessors by number.
    w = Window.partitionBy("page").orderBy("at", "mark")
    keys = rows.select("page", "at", "mark").distinct().select("page", "at", "mark", (F.row_number().over(w) - 1).alias("rev")).checkpoint()
    same = (F.col("page") == F.col("k_page")) & F.col("at").eqNullSafe(F.col("k_at")) & (F.col("mark") == F.col("k_mark"))
    texts = rows.dropDuplicates(["page", "at", "mark"]).join(keys.toDF("k_page", "k_at", "k_mark", "rev"), same).select("page", "rev", "at", "text").checkpoint()
    before = texts.select(F.col("page").alias("b_page"), (F.col("rev") + 1).alias("b_rev"), F.col("text").alias("before"))
    pairs = texts.join(before, (F.col("page") == F.col("b_page")) & (F.col("rev") == F.col("b_rev")), "left").select("page", "rev", "text", "before")
    kind = rows.schema["page"].dataType.simpleString()
    runs = pairs.mapInArrow(_aligned, f"page {kind}, rev int, runs {_RUNS}").checkpoint()
    longest = (keys.agg(F.max("rev")).first()[0] or 0) + 1
    while longest > 1:
        block = F.floor(F.col("rev") / fan).cast("int")
        parts = runs.groupBy("page", block.alias("rev")).agg(F.array_sort(F.collect_list(F.struct("rev", "runs"))).alias("parts"))  # at most `fan`
        runs = parts.mapInArrow(_joined, f"page {kind}, rev int, runs {_RUNS}").checkpoint()
        longest = -(-longest // fan)
    last = keys.groupBy("page").agg(F.max("rev").alias("rev"))
    final = texts.join(last, ["page", "rev"]).select("page", F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)).alias("words"))
    brought = runs.select(F.col("page").alias("r_page"), F.flatten(F.transform("runs", lambda r: F.array_repeat(r["revision"], r["n"]))).alias("by"))
    placed = final.join(brought, F.col("page") == F.col("r_page")).select("page", F.posexplode(F.arrays_zip("words", "by")).alias("place", "x")).select("page", "place", F.col("x.words").alias("word"), F.col("x.by").alias("rev"))
    names = texts.select(F.col("page").alias("n_page"), F.col("rev").alias("n_rev"), "at")
    return placed.join(names, (F.col("page") == F.col("n_page")) & (F.col("rev") == F.col("n_rev"))).select(F.col("page.p").alias(page_col), "place", "word", F.col("at").alias("revision"))
