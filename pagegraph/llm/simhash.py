"""SimHash near-duplicates by pigeonring filtering.

Fingerprints: a 64-bit majority vote over the XXH64 values of word shingles.

Candidates: the 64 bits lie on a ring of five segments (13, 13, 13, 13, 12).
Two fingerprints that differ in at most 4 bits have a segment from which every
chain of l segments, l = 1..5, differs in at most 4 l / 5 bits: 0 in the first,
1 in the first two, 2 in three, 3 in four. Each distinct fingerprint is filed
under its first two segments for each start (26 bits), and once more with each
set bit of the second cleared; an equal key is then just the first two chain
conditions. In a task, rows of a key are compared: first the longer chains,
then the full distance. Only links of a spanning forest leave the task.

Equal fingerprints are one class before the search. Keys held by more than
`block` fingerprints are dealt out as pairs of blocks, over as many tasks, so
no key is capped and none fills a task.

Defined results: null and empty texts have no shingles and fingerprint zero,
which links like any other; repeated rows and ties share a fingerprint; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, ready_checkpoints
from .components import connected_components
from .words import spaced, texts

SEGMENTS = (13, 13, 13, 13, 12)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, or of all words where there are fewer; repeats stay."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n + 1) - 1
    start = end - n
    h = xxhash.xxh64_intdigest
    last = end[size - 1 :].tolist() or [len(line)]
    return np.array([h(line[a:b], 42) for a, b in zip(start.tolist(), last, strict=False)], dtype=np.uint64)


def fingerprint(words: list[bytes], size: int = 4) -> int:
    h = shingle_hashes(words, size)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            known: dict[bytes, int] = {}
            out = []
            for t in texts(b):
                if t not in known:
                    known[t] = fingerprint(spaced(t), size)
                out.append(known[t])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    few = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return few.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _rotated(fp: np.ndarray, i: int) -> np.ndarray:
    """The ring read from segment i on, that segment's bits on top."""
    by = np.uint64(sum(SEGMENTS[:i]))
    return (fp << by) | (fp >> np.uint64((64 - int(by)) % 64)) if by else fp


def chain_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, own) rows: own keys and those with one set bit of the second segment cleared."""
    keys, whose, own = [], [], []
    for i in range(5):
        a, b = SEGMENTS[i], SEGMENTS[(i + 1) % 5]
        base = _rotated(fp, i) >> np.uint64(64 - a - b)
        top = np.uint64(i << 32)
        keys.append(base | top)
        whose.append(fp)
        own.append(np.ones(len(fp), bool))
        for bit in range(b):
            m = np.uint64(1 << bit)
            has = (base & m) > 0
            keys.append((base[has] ^ m) | top)
            whose.append(fp[has])
            own.append(np.zeros(int(has.sum()), bool))
    return np.concatenate(keys), np.concatenate(whose), np.concatenate(own)


def _close(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of XORs under their keys: longer chains within budget, then all bits."""
    start = (key >> np.uint64(32)).astype(np.int64)
    keep = np.zeros(len(x), bool)
    for i in range(5):
        at = np.flatnonzero(start == i)
        if not len(at):
            continue
        r = _rotated(x[at], i)
        for chain, budget in ((3, 2), (4, 3), (5, 4)):
            bits = sum(SEGMENTS[(i + j) % 5] for j in range(chain))
            fits = np.bitwise_count(r >> np.uint64(64 - bits)) <= budget
            at, r = at[fits], r[fits]
        keep[at] = True
    return keep


class Forest:
    """Union-find that keeps the links that joined something."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (u := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[u]
            x = self.up[u]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))


def spanning_links(key: np.ndarray, fp: np.ndarray, own: np.ndarray, side: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Links that join what lies within 4 bits under a common key.

    Rows of a key are compared in pairs with an own row at least. side: -1, all rows of the key; else rows of
    block pair (a, b), of which those of side 0 meet those of side 1.
    """
    forest = Forest()
    by = np.lexsort((~own, key))
    key, fp, own, side = key[by], fp[by], own[by], side[by]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    stop = np.append(first[1:], len(key))
    many = stop - first
    small = (many > 1) & (many <= 64) & (side[first] < 0) if len(first) else np.zeros(0, bool)
    # small groups: row against the rows d places on, all groups at once
    group = np.repeat(np.arange(len(first)), many)
    at = np.arange(len(key))
    here = small[group] if len(first) else np.zeros(0, bool)
    for d in range(1, int(many[small].max()) if small.any() else 1):
        a = at[here & (at + d < stop[group])]
        a = a[own[a]]
        if not len(a):
            continue
        x = fp[a] ^ fp[a + d]
        ok = (x != 0) & _close(x, key[a])
        forest.join(fp[a[ok]], fp[a[ok] + d])
    for g in np.flatnonzero((many > 1) & ~small):
        rows = slice(first[g], stop[g])
        f, o, s = fp[rows], own[rows], side[rows]
        left = np.flatnonzero(o if s[0] < 0 else s == 0)
        right = np.arange(len(f)) if s[0] < 0 else np.flatnonzero(s == 1)
        step = max(1, most // max(1, len(right)))
        for i in range(0, len(left), step):
            a = left[i : i + step]
            x = f[a][:, None] ^ f[right][None, :]
            u, v = np.nonzero(np.bitwise_count(x) <= 4)
            useful = (x[u, v] != 0) & (o[a[u]] | o[right[v]])
            u, v = u[useful], v[useful]
            ok = _close(x[u, v], np.full(len(u), key[first[g]]))
            forest.join(f[a[u[ok]]], f[right[v[ok]]])
    return forest.links


def near_links(distinct: DataFrame, block: int = 8192) -> DataFrame:
    """(u, v): links that span the components of fingerprints (column fp, distinct) at up to 4 differing bits."""
    spark = distinct.sparkSession

    def emit(batches):
        for b in batches:
            key, whose, own = chain_keys(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whose.view(np.int64)), pa.array(own)], names=["key", "fp", "own"])

    rows = distinct.select("fp").mapInArrow(emit, "key long, fp long, own boolean")
    total = distinct.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 40 // 1_000_000))
    # A key's bucket is its leading segment's; how many rows a bucket gets is known from 5 x 8192 counters.
    tops = [F.expr(f"shiftrightunsigned(shiftleft(fp, {sum(SEGMENTS[:i])}), {64 - SEGMENTS[i]})") for i in range(5)]
    counters = distinct.select(F.posexplode(F.array(*tops)).alias("i", "top"))
    heavy = counters.groupBy("i", "top").count().where(F.col("count") > block).count() if total > block else 0  # at most 5 x 8192 rows
    rows = rows.withColumn("side", F.lit(-1).cast("byte")).withColumn("task", F.lit(0).cast("long"))
    if heavy:
        n = rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks"))
        marked = rows.drop("side", "task").join(n, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        grid = F.explode(F.expr("transform(sequence(0L, blocks - 1), x -> named_struct('a', least(x, mine), 'b', greatest(x, mine)))"))
        cold = marked.where("blocks is null").select("key", "fp", "own", F.lit(-1).cast("byte").alias("side"), F.lit(0).cast("long").alias("task"))
        hot = marked.where("blocks is not null").withColumn("mine", own).withColumn("cell", grid)
        hot = hot.select("key", "fp", "own", F.when(F.col("cell.a") == F.col("cell.b"), -1).otherwise((F.col("cell.b") == F.col("mine")).cast("int")).cast("byte").alias("side"), (F.lit(1) + F.col("cell.a") * 1048576 + F.col("cell.b")).alias("task"))
        rows = cold.unionAll(hot)

    def link(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, fp, own, side, task = (t.column(c).to_numpy() for c in ("key", "fp", "own", "side", "task"))
        links = []
        for k in np.unique(task):
            m = task == k
            links += spanning_links(key[m].view(np.uint64), fp[m].view(np.uint64), own[m], side[m])
        a = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])

    return rows.repartition(parts, "key", "task").mapInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id reachable), n_links of its fingerprint in the spanning forest."""
    spark = docs.sparkSession
    ready_checkpoints(spark)
    fps = fingerprints(docs, id_col, text_col, size).checkpoint()
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    links = near_links(classes.select("fp")).checkpoint()
    members = connected_components(links)
    ends = links.select("u").unionAll(links.select("v")).groupBy("u").agg(F.count("*").alias("n_links")).withColumnRenamed("u", "node")
    # Only fingerprints with links need their component's least id. Both sides of the join are cut off
    # from what made them, so that a component that holds many of them can be split.
    linked = members.join(ends, "node").withColumnRenamed("node", "fp").join(classes, "fp").checkpoint()
    first = linked.groupBy("component").agg(F.min("least").alias("first")).checkpoint()
    linked = linked.join(first, "component").select("fp", "first", "n_links")
    names = classes.join(linked, "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).checkpoint()
    out = fps.join(names, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """docs, all columns, with one document of each component: the one of least id (of equal ids: of least text digest; null ids last)."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = F.col(f"c{names.index(id_col)}"), F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
    key = F.struct(own.isNull().alias("last"), own.alias("id"), F.md5(text.cast("binary")).alias("digest"))
    keyed = inner.withColumn("key", key)
    kept = near_duplicates(keyed.select("key", text.alias("text")), "key", "text", size).where("key <=> component_id").select(F.col("key").alias("kept")).distinct()
    return keyed.join(kept, F.col("key").eqNullSafe(F.col("kept")), "left_semi").dropDuplicates(["key"]).drop("key").toDF(*names)
