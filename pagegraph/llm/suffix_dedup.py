"""Exact substring de-duplication by hash-compared suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts in a
document with a smaller id. Such strings are windows. Every window has an
anchor, its 16-byte gram of least hash (ties: the first), so equal windows have
equal anchors and only windows whose anchor's hash occurs in two documents can
be equal. The rest never leaves its document.

1. Documents are put into blobs of about a megabyte, and these into packs
   (compressed rows, checkpointed once).
2. Each pack sends its blobs' distinct anchor hashes to buckets; a bucket answers
   with one bit a hash: seen in two documents or not.
3. Runs of windows with such an anchor are pieces of at most 84 bytes. Each pack
   sends its blobs' distinct pieces, with the least id that has them, to buckets.
4. A bucket sorts the windows of its pieces as suffixes: mergesort, in which two
   suffixes are compared by prefix polynomial hashes and a binary search for
   their common extension. The order of all neighbours is verified by their bytes.
   It answers with one bit a window: does a smaller id than the blob's own have it?
5. Each pack applies the answers to its documents.

An anchor that very many documents have can have as many different pieces, all in
one bucket. Such heavy anchors' windows are asked for one by one, as anchors are
in step 2, and only those that two documents have are sent, each as a piece of its
own, to buckets by the hash of the whole window.

A row goes from a pack to a bucket, for all of the pack's blobs, and buckets are
sized by what they get, so rows stay few: packs times buckets, and never more
than one a hash or piece. What a blob sends is distinct within it; where packs are
many, buckets answer in two steps, first within groups of `fan` packs, so that a
passage that every document has never comes together in one task.

Equal pieces, and documents whose whole text a smaller id has, are found by hashes
verified byte by byte, before the sort; the sort decides what different pieces share.

Defined results: null is the empty text; texts shorter than a window keep
everything; ids of any type that can be ordered; documents of equal id do not
count against each other, repeated rows stay; a null id is larger than all others
and removes nothing from anyone; an empty table gives no rows; other columns are
ignored or kept as they are. A long text is worked on in parts, with a few bytes
of memory for each of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..session import bounded_batches, ready_checkpoints
from .words import texts

GRAM = 16
SLICE = 1 << 15  # windows whose anchors are found at a time: arrays stay in the processor's cache
PART = 1 << 16  # runs worked on at a time
PAD = 256  # bytes behind a text, so that words can be read up to its end
FLUSH = 24 << 20  # bytes that a pack holds before it sends them
NO_ID = np.iinfo(np.int64).max
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


# ----------------------------------------------------------------- anchors


def words_at(text: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on, as a view."""
    return np.ndarray((max(0, len(text) - 7),), f"{order}u8", text, strides=(1,))


def gram_hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of 16 bytes."""
    h = (low * MIX[0]) ^ (high * MIX[1] + (low >> np.uint64(31)))
    h ^= h >> np.uint64(29)
    h *= MIX[2]
    return h


def anchor_places(text: np.ndarray, length: int) -> np.ndarray:
    """The place of the anchor of the window at each place of a text of less than 2^24 bytes; hashes count by their upper 40 bits."""
    w = words_at(text)
    span = length - GRAM + 1
    low = gram_hashes(w[:-8].astype(np.uint64), w[8:].astype(np.uint64))
    low &= ~np.uint64((1 << 24) - 1)
    low |= np.arange(len(low), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)


class Blob:
    """Documents' texts one behind the other, and the runs of windows of a document that have one anchor: hash, document, first window, window after the last."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, text: bytes, length: int):
        self.ids, self.ends, self.length = ids, ends, length
        self.size = len(text) - PAD
        self.text = np.frombuffer(text, np.uint8)
        self.words = words_at(self.text)
        self.starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
        n = max(0, self.size - length + 1)
        edges = np.concatenate((self.starts, ends - length + 1))  # where windows begin or cease to lie in one document
        edges = np.unique(edges[(edges >= 0) & (edges < n)])
        firsts, places, last = [np.empty(0, np.int64)], [np.empty(0, np.int64)], -1
        for a in range(0, n, SLICE):
            place = anchor_places(self.text[a : min(a + SLICE + length - 1, self.size)], length) + a
            new = np.empty(len(place), bool)
            new[0] = place[0] != last
            np.not_equal(place[1:], place[:-1], out=new[1:])
            new[edges[np.searchsorted(edges, a) : np.searchsorted(edges, a + len(place))] - a] = True
            at = np.flatnonzero(new)
            firsts.append(at + a)
            places.append(place[at])
            last = place[-1]
        first, place = np.concatenate(firsts), np.concatenate(places)
        stop = np.append(first[1:], n)
        doc = np.searchsorted(ends, first, side="right")
        whole = first + length <= ends[np.minimum(doc, len(ends) - 1)] if len(first) else np.zeros(0, bool)
        self.first, self.stop, self.doc, place = first[whole], stop[whole], doc[whole], place[whole]
        self.hash = gram_hashes(self.words[place].astype(np.uint64), self.words[place + 8].astype(np.uint64))

    def parts(self):
        """The runs in slices."""
        for a in range(0, len(self.first), PART):
            yield slice(a, a + PART)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, document, hash) of each window of some runs."""
        n = self.stop[runs] - self.first[runs]
        start = stretch(self.first[runs], n)
        return start, np.repeat(self.doc[runs], n), piece_hashes(self.words, start, np.full(len(start), self.length))


def asked(h: np.ndarray, who: np.ndarray, buckets: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """The stretch of each bucket, and in order of bucket the distinct hashes, whether different ids have one here, and how often it occurs."""
    by = np.argsort(h, kind="stable")
    h, who = h[by], who[by]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    many = np.minimum.reduceat(who, start) != np.maximum.reduceat(who, start) if len(h) else np.zeros(0, bool)
    h, n = h[start], np.diff(np.append(start, len(h)))
    stretches, order = in_buckets(h, buckets)
    return stretches, h[order], many[order], n[order]


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether hashes are among some, sorted."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def in_buckets(h: np.ndarray, buckets: int, then: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """((bucket, from, to), order): places of h in order of bucket, then of `then` or of h's places."""
    b = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable") if then is None else np.lexsort((then, b))
    b = b[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    return [(int(b[i]), i, j) for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(b)], strict=True)] if len(b) else [], order


# ----------------------------------------------------------------- equal pieces


class CollisionError(Exception):
    """Two different texts had equal hashes."""


def piece_hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64) * MIX[1]
    for j in range(0, int(size.max(initial=0)), 8):
        h = (h ^ (words[start + j] & MASK[np.clip(size - j, 0, 8)])) * MIX[0]
        h ^= h >> np.uint64(29)
    return h * MIX[2]


def distinct(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): pieces in an order that puts equal ones together and does not depend on the given one, and where a new one begins."""
    words = words_at(text)
    h = piece_hashes(words, start, size)
    by = np.argsort(h, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = h[by][1:] != h[by][:-1]
    rest = np.flatnonzero(~new)
    own, other = by[rest], by[new][np.cumsum(new)[rest] - 1]
    same = size[own] == size[other]
    for j in range(0, int(size.max(initial=0)), 8):
        mask = MASK[np.clip(size[own] - j, 0, 8)]
        same &= (words[start[own] + j] & mask) == (words[start[other] + j] & mask)
    if same.all():
        return by, new
    plain = [text[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)]  # hashes collide
    by = np.array(sorted(range(len(plain)), key=plain.__getitem__))
    new[1:] = [plain[a] != plain[b] for a, b in zip(by[1:], by[:-1], strict=True)]
    return by, new


def stretch(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of stretches, one behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


# ----------------------------------------------------------------- suffix sort


class Suffixes:
    """Suffixes of a text, compared up to `length` bytes by prefix polynomial hashes."""

    BASE = np.uint64(0x5851F42D4C957F2D)

    def __init__(self, text: np.ndarray, length: int):
        self.text, self.length, n = text, length, len(text)
        power = np.full(n + 1, self.BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.up = power[::-1]
        self.prefix = np.zeros(n + 1, np.uint64)
        terms = text.astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[:n]
        np.cumsum(terms, out=self.prefix[1:])
        del terms
        self.word = words_at(np.concatenate((text, np.zeros(7, np.uint8))), ">").astype(np.uint64)

    def hash(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hash of n bytes from each place on, shifted to the same power wherever they stand."""
        return (self.prefix[at + n] - self.prefix[at]) * self.up[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at a and b, at most `length`."""
        whole = self.hash(a, self.length) == self.hash(b, self.length)
        out = np.full(len(a), self.length)
        rest = np.flatnonzero(~whole)
        low, high = np.zeros(len(rest), np.int64), np.full(len(rest), self.length - 1)
        x, y = a[rest], b[rest]
        for _ in range(int(self.length).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hash(x, mid) == self.hash(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[rest] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        at = np.minimum(n, self.length - 1)
        return (n < self.length) & (self.text[a + at] < self.text[b + at])

    def sort(self, at: np.ndarray) -> np.ndarray:
        """The places in suffix order: by the leading 24 bytes, then mergesort within equal ones, all runs of a level at once."""
        if not len(at):
            return at
        lead = [self.word[at + j] for j in range(0, max(1, min(24, self.length - 7)), 8)]
        by = np.lexsort(lead[::-1])
        at, lead = at[by], [k[by] for k in lead]
        first = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in lead]))))
        many = np.diff(np.append(first, len(at)))
        tied = np.repeat(many > 1, many)
        rows = np.flatnonzero(tied)
        if not len(rows):
            return at
        base = np.repeat(first[many > 1], many[many > 1])
        stop = base + np.repeat(many[many > 1], many[many > 1])
        width = 1
        while width < int(many.max()):
            run = (rows - base) // width
            left = run % 2 == 0
            other = base + (run ^ 1) * width
            low, high = np.minimum(other, stop), np.minimum(other + width, stop)
            start = low.copy()
            mine = at[rows]
            live = np.flatnonzero(low < high)
            while len(live):  # where in the other run each element belongs; equal elements of the left run go first
                mid = (low[live] + high[live]) >> 1
                theirs = at[mid]
                own = mine[live]
                is_left = left[live]
                after = np.where(is_left, self.less(theirs, own), ~self.less(own, theirs))
                low[live] = np.where(after, mid + 1, low[live])
                high[live] = np.where(after, high[live], mid)
                live = live[low[live] < high[live]]
            head = np.where(left, rows - (rows - base) % width, start)
            to = head + (rows - base) % width + (low - start)
            at[to] = mine
            width *= 2
        return at

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether whole windows are equal, by their bytes; an error if one of a is greater than its neighbour of b, as then a hash has led the sort astray."""
        n, out, rows = self.length, np.zeros(len(a), bool), np.arange(len(a))
        keys = [(self.word, j) for j in range(0, n - 7, 8)] + ([(self.word, n - 8)] if n >= 8 else [(self.text, j) for j in range(n)])
        for key, j in keys:
            x, y = key[a[rows] + j], key[b[rows] + j]
            if (x > y).any():
                raise CollisionError
            rows = rows[x == y]
        out[rows] = True
        return out


def least_owner(text: bytes | np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int, suffixes: Suffixes | None = None) -> np.ndarray:
    """For each window start the least owner of an equal window."""
    if not len(starts):
        return owner
    text = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    s = suffixes or Suffixes(text, length)
    try:
        back = np.empty(int(starts.max()) + 1, np.int64)
        back[starts] = np.arange(len(starts))
        sorted_at = s.sort(starts.copy())
        order = back[sorted_at]
        group = np.concatenate(([0], np.cumsum(~s.equal(sorted_at[:-1], sorted_at[1:]))))
        first = np.flatnonzero(np.concatenate(([True], np.diff(group) > 0)))
        least = np.minimum.reduceat(owner[order], first)
        out = np.empty_like(owner)
        out[order] = least[group]
        return out
    except CollisionError:  # plain comparison for this bucket
        known: dict[bytes, int] = {}
        windows = [text[a : a + length].tobytes() for a in starts.tolist()]
        for w, o in zip(windows, owner.tolist(), strict=True):
            known[w] = min(known.get(w, NO_ID), o)
        return np.array([known[w] for w in windows])


def least_owners(text: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each window of distinct pieces, one behind the other in a text, the least owner of a piece that has it."""
    many = size - length + 1
    window = np.cumsum(many) - many
    best = np.repeat(owner, many)
    suffixes = Suffixes(text, length)
    # Equal windows have equal anchors, and with them equal bytes on the anchor's left or on its right:
    # a window whose side no other piece has needs no comparison.
    place = np.empty(len(start), np.int64)
    for a in range(0, len(text) - length + 1, SLICE):
        rows = slice(np.searchsorted(start, a), np.searchsorted(start, a + SLICE))
        if rows.start < rows.stop:
            place[rows] = anchor_places(text[a : a + SLICE + length - 1], length)[start[rows] - a] + a
    side = (length - GRAM) // 2
    left, right = place - side >= start, place + GRAM + side <= start + size
    met = []
    for ok, at in ((left, place - side), (right, place)):
        key = np.where(ok, suffixes.hash(np.where(ok, at, 0), GRAM + side), 0)
        _, of, pieces = np.unique(key, return_inverse=True, return_counts=True)
        met.append(ok & (pieces[of] > 1))
    mixed = np.flatnonzero(met[0] | met[1])
    rows, starts = stretch(window[mixed], many[mixed]), stretch(start[mixed], many[mixed])
    use = np.where(np.repeat(place[mixed], many[mixed]) - starts >= side, np.repeat(met[0][mixed], many[mixed]), np.repeat(met[1][mixed], many[mixed]))
    rows, starts = rows[use], starts[use]
    best[rows] = least_owner(text, starts, best[rows], length, suffixes)
    return best


# ----------------------------------------------------------------- the job


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with ids as numbers in their order, and the table (id, number) if they are not such numbers themselves."""
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(docs.schema[id_col].dataType, Ty.IntegralType) and few.agg(F.max(F.col("id").cast("long"))).first()[0] != NO_ID:
        return few.select(F.col("id").cast("long"), "text"), None
    numbers = few.select("id").where("id is not null").distinct().orderBy("id").withColumn("number", F.monotonically_increasing_id()).checkpoint()
    return few.join(numbers, "id", "left").select(F.col("number").alias("id"), "text"), numbers


def _packs(docs: DataFrame, blob_bytes: int, pack_bytes: int) -> DataFrame:
    """(pack, ids, ends, counts, blobs, digests, id_list, bytes): about `pack_bytes` of documents a row, in blobs of about `blob_bytes`."""

    def run(batches):
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        number, ids, ends, counts, blobs, digests, size = 0, [], [], [], [], [], 0
        texts_, filled = [], 0

        def close():
            nonlocal filled, size
            ends.extend(np.cumsum([len(t) for t in texts_], dtype=np.int64).tolist())
            counts.append(len(texts_))
            blobs.append(zstandard.ZstdCompressor(level=3).compress(b"".join([*texts_, bytes(PAD)])))
            digests.extend(hashlib.sha256(t).digest() for t in texts_)
            size += sum(map(len, texts_))
            texts_.clear()
            filled = 0

        def row():
            nonlocal number, size
            out = pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(ends, np.int64).tobytes()], pa.binary()), pa.array([counts], pa.list_(pa.int32())),
                pa.array([blobs], pa.list_(pa.binary())), pa.array([digests], pa.list_(pa.binary())), pa.array([ids], pa.list_(pa.int64())), pa.array([size], pa.int64()),
            ], names=["pack", "ids", "ends", "counts", "blobs", "digests", "id_list", "bytes"])
            number, size = number + 1, 0
            for x in (ids, ends, counts, blobs, digests):
                x.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts(b), strict=True):
                ids.append(NO_ID if i is None else i)
                texts_.append(t)
                filled += len(t) + 64
                if filled >= blob_bytes:
                    close()
                if size >= pack_bytes:
                    yield row()
        if texts_:
            close()
        if ids:
            yield row()

    return docs.mapInArrow(run, "pack long, ids binary, ends binary, counts array<int>, blobs array<binary>, digests array<binary>, id_list array<long>, bytes long")


def _copies(packs: DataFrame) -> DataFrame:
    """(pack, copies): numbers of a pack's documents whose text a smaller id has."""
    rows = packs.select("pack", F.posexplode(F.arrays_zip("id_list", "digests")).alias("at", "x")).select("pack", "at", F.col("x.id_list").alias("id"), F.col("x.digests").alias("digest"))
    # Cut off from the rows, so that the join can split a digest that many documents share.
    least = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least").checkpoint()
    return rows.join(least, "digest").where("id > least").groupBy("pack").agg(F.collect_list(F.col("at").cast("int")).alias("copies"))  # at most a pack's documents


def _blobs(row: dict, length: int):
    """(number of the first document, blob) of each blob of a pack, one at a time."""
    ids, ends, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64), 0
    for n, raw in zip(row["counts"], row["blobs"], strict=True):
        size = int(ends[at + n - 1]) + PAD
        yield at, Blob(ids[at : at + n], ends[at : at + n], zstandard.ZstdDecompressor().decompress(raw, max_output_size=size), length)
        at += n


class Answers:
    """A pack's answers by bucket, in the order in which the pack asked: bits, and which of the bits that are set stand for something heavy."""

    def __init__(self, rows: list[dict] | None):
        found: dict[int, list[np.ndarray]] = {}
        for r in sorted(rows or [], key=lambda r: r["seq"]):
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"])
            if r["heavy"]:
                at = np.flatnonzero(bits)
                bits[at] += np.unpackbits(np.frombuffer(r["heavy"], np.uint8), count=len(at))
            found.setdefault(r["bucket"], []).append(bits)
        self.whole = {k: np.concatenate(v) for k, v in found.items()}
        self.at = dict.fromkeys(self.whole, 0)

    def take(self, stretches: list[tuple[int, int, int]]) -> np.ndarray:
        """0, 1 or, if heavy, 2 for each of the next places of some buckets."""
        out = [np.empty(0, np.uint8)]
        for k, a, b in stretches:
            at = self.at[k]
            self.at[k] = at + b - a
            out.append(self.whole[k][at : at + b - a])
        return np.concatenate(out)


class Runs:
    """A part's runs whose anchor another document has, and of these the ones with a heavy anchor."""

    def __init__(self, blob: Blob, part: slice, shared: Answers, copies: np.ndarray, anchor_buckets: int):
        h, who = blob.hash[part], blob.doc[part]
        stretches, known, _, _ = asked(h, blob.ids[who], anchor_buckets)
        said = shared.take(stretches)
        use = np.flatnonzero(among(h, np.sort(known[said > 0])) & ~copies[who])
        heavy = among(h[use], np.sort(known[said > 1]))
        self.light, self.heavy = use[~heavy] + part.start, use[heavy] + part.start


class Pieces:
    """A part's distinct pieces with a shared anchor, in order of bucket and place, and all pieces that are one of these."""

    def __init__(self, blob: Blob, part: slice, shared: Answers, heavy: Answers, copies: np.ndarray, sizes: tuple[int, int, int]):
        anchor_buckets, window_buckets, buckets = sizes
        runs = Runs(blob, part, shared, copies, anchor_buckets)
        first, doc, key = blob.first[runs.light], blob.doc[runs.light], blob.hash[runs.light]
        size = blob.stop[runs.light] - first + blob.length - 1
        if len(runs.heavy):  # windows that another document has, each on its own
            start, who, h = blob.windows(runs.heavy)
            stretches, known, _, _ = asked(h, blob.ids[who], window_buckets)
            use = among(h, np.sort(known[heavy.take(stretches) > 0]))
            first, doc, key = (np.concatenate(x) for x in ((first, start[use]), (doc, who[use]), (key, h[use])))
            size = np.concatenate((size, np.full(int(use.sum()), blob.length)))
        by, new = distinct(blob.text, first, size)
        head = by[new]
        owners = np.minimum.reduceat(blob.ids[doc[by]], np.flatnonzero(new)) if len(by) else np.empty(0, np.int64)
        self.stretches, order = in_buckets(key[head], buckets, first[head])
        self.start, self.size, self.owner = first[head][order], size[head][order], owners[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.first, self.doc, self.of = first[by], doc[by], rank[np.cumsum(new) - 1]


def _sender(joined, names: list[str], kinds: list[pa.DataType]):
    """Collects what a pack sends to each bucket, part by part, and yields a row for each bucket when there is much of it."""
    held: dict[int, list[list]] = {}
    size = seq = 0

    def flush(pack: int):
        nonlocal size, seq
        keys = sorted(held)
        cols = [[joined(j, [row[j] for row in held[k]]) for k in keys] for j in range(len(names))]
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([pack] * len(keys), pa.int64()), pa.array([seq] * len(keys), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["bucket", "pack", "seq", *names])
        held.clear()
        size, seq = 0, seq + 1
        return out

    def add(bucket: int, row: list, n: int) -> bool:
        nonlocal size
        held.setdefault(bucket, []).append(row)
        size += n
        return size > FLUSH

    return add, flush


def _each(batches):
    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            yield {n: b.column(c)[i].as_py() for c, n in enumerate(names)}


def _resolve(sent: DataFrame, packs: int, fan: int, actions, merged: str) -> DataFrame:
    """(pack, seq, bucket, n, yes, n_heavy, bits, heavy): each row's answer from its bucket.

    Of the actions, merge makes one row of a bucket's rows, tell adds to such rows what all of them together say, and
    finish applies that to the first ones. With more than `fan` packs a bucket's rows are merged in
    groups, so that no task holds more than about `fan` rows of a bucket.
    """
    answer = "pack long, seq long, bucket long, n long, yes long, n_heavy long, bits binary, heavy binary"
    if packs <= fan:

        def direct(t: pa.Table) -> pa.Table:
            merge, tell, finish = actions()
            return finish(t, tell(merge(t)))

        return sent.groupBy("bucket").applyInArrow(direct, answer)
    grouped = sent.withColumn("part", F.pmod(F.xxhash64("pack"), F.lit(-(-packs // fan)))).checkpoint()
    merge, tell, finish = actions()
    few = grouped.groupBy("bucket", "part").applyInArrow(merge, merged)
    told = few.groupBy("bucket").applyInArrow(tell, "bucket long, part long, said binary").checkpoint()
    return grouped.groupBy("bucket", "part").cogroup(told.groupBy("bucket", "part")).applyInArrow(finish, answer)


def _one(t: pa.Table, **more) -> pa.Table:
    """A row for the rows of a bucket or of one of its groups."""
    part = t.column("part")[0].as_py() if "part" in t.schema.names else 0
    return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int64()), "part": pa.array([part], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in more.items()}})


def _bits(t: pa.Table, flags: np.ndarray, counts: list[int], heavy: np.ndarray | None = None) -> pa.Table:
    cut = np.cumsum(counts)[:-1]
    own = np.split(flags, cut)
    big = [h[o] for h, o in zip(np.split(heavy, cut), own, strict=True)] if heavy is not None else [np.zeros(0, bool)] * len(own)
    yes, n_heavy = ([int(x.sum()) for x in xs] for xs in (own, big))
    return pa.table({
        "pack": t.column("pack"), "seq": t.column("seq"), "bucket": t.column("bucket"), "n": pa.array(counts, pa.int64()), "yes": pa.array(yes, pa.int64()), "n_heavy": pa.array(n_heavy, pa.int64()),
        "bits": pa.array([np.packbits(x).tobytes() for x in own], pa.binary()), "heavy": pa.array([np.packbits(x).tobytes() if n else b"" for x, n in zip(big, n_heavy, strict=True)], pa.binary()),
    })


def _arrays(t: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]


class _Last:
    """A function of a table that need not run again for the table it was last given."""

    def __init__(self, f):
        self.f, self.t, self.out = f, None, None

    def __call__(self, t: pa.Table):
        if t is not self.t:
            self.t, self.out = t, self.f(t)
        return self.out


def _shared(rows: DataFrame, many_packs: int, fan: int, length: int, buckets: int, name: str, keys, heavy: int) -> DataFrame:
    """(pack, name, n_name, n_heavy): the bits of a pack's hashes that occur in two documents, by bucket; heavy are those of more than `heavy` places.

    keys(row) yields each part's hashes with the ids that have them.
    """

    def send(batches):
        def joined(j, xs):
            return np.packbits(np.concatenate(xs)).tobytes() if j == 1 else b"".join(xs)

        for row in _each(batches):
            add, flush = _sender(joined, ["hashes", "many", "places"], [pa.binary()] * 3)
            for h, who in keys(row):
                stretches, h, many, n = asked(h, who, buckets)
                h = ((h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # a bucket has few hashes beside these: 32 bits rule most others out
                n = np.minimum(n, 65535).astype(np.uint16)  # sums beyond any bound for heavy ones
                if any([add(k, [h[a:b].tobytes(), many[a:b], n[a:b][many[a:b]].tobytes()], 5 * (b - a)) for k, a, b in stretches]):
                    yield flush(row["pack"])
            yield flush(row["pack"])

    def seen_in(t: pa.Table):
        """By row how many hashes; the distinct ones, which of them each is, which occur in two documents, and in how many places."""
        own = _arrays(t, "hashes", np.uint32)
        many = np.concatenate([np.unpackbits(x, count=len(o)) for x, o in zip(_arrays(t, "many", np.uint8), own, strict=True)]).astype(bool)
        known, inverse, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        hot, which = n > 1, inverse[many]
        hot[which] = True
        np.add.at(n, which, np.concatenate(_arrays(t, "places", np.uint16)).astype(np.int64) - 1)
        return [len(o) for o in own], known, inverse, hot, n

    def actions():
        seen = _Last(seen_in)

        def merge(t: pa.Table) -> pa.Table:
            _, known, _, hot, n = seen(t)
            return _one(t, hashes=known.tobytes(), many=np.packbits(hot).tobytes(), places=np.minimum(n, 65535).astype(np.uint16)[hot].tobytes())

        def tell(t: pa.Table) -> pa.Table:
            counts, _, inverse, hot, n = seen_in(t)
            said = np.split((hot.astype(np.uint8) + (hot & (n > heavy)))[inverse], np.cumsum(counts)[:-1])
            return pa.table({"bucket": t.column("bucket"), "part": t.column("part"), "said": pa.array([x.tobytes() for x in said], pa.binary())})

        def finish(t: pa.Table, told: pa.Table) -> pa.Table:
            counts, _, inverse, _, _ = seen(t)
            said = _arrays(told, "said", np.uint8)[0][inverse]
            return _bits(t, said > 0, counts, said > 1)

        return merge, tell, finish

    kinds = "hashes binary, many binary, places binary"
    bits = _resolve(rows.mapInArrow(send, f"bucket long, pack long, seq long, {kinds}"), many_packs, fan, actions, f"bucket long, part long, {kinds}")
    return bits.groupBy("pack").agg(F.collect_list(F.struct("seq", "bucket", "n", "bits", "heavy")).alias(name), F.sum("yes").alias(f"n_{name}"), F.sum("n_heavy").alias("n_heavy"))


def _all_anchors(length: int):
    def keys(row: dict):
        for _, blob in _blobs(row, length):
            for part in blob.parts():
                yield blob.hash[part], blob.ids[blob.doc[part]]

    return keys


def _heavy_windows(length: int, anchor_buckets: int):
    def keys(row: dict):
        shared, copied = Answers(row["shared"]), _copied(row)
        for at, blob in _blobs(row, length):
            for part in blob.parts():
                runs = Runs(blob, part, shared, copied[at : at + len(blob.ids)], anchor_buckets).heavy
                if len(runs):
                    _, who, h = blob.windows(runs)
                    yield h, blob.ids[who]

    return keys


def _answers(joined: DataFrame, many_packs: int, fan: int, length: int, sizes: tuple[int, int, int]) -> DataFrame:
    """(pack, answers): the bits of a pack's piece windows that a smaller id than the piece's own has, by bucket."""

    def send(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for row in _each(batches):
            add, flush = _sender(lambda j, xs: pack.compress(b"".join(xs)) if j == 2 else b"".join(xs), ["sizes", "owners", "text"], [pa.binary()] * 3)
            shared, windows_, copied = Answers(row["shared"]), Answers(row["windows"]), _copied(row)
            for at, blob in _blobs(row, length):
                for part in blob.parts():
                    p = Pieces(blob, part, shared, windows_, copied[at : at + len(blob.ids)], sizes)
                    text, end = blob.text[stretch(p.start, p.size)].tobytes(), np.concatenate(([0], np.cumsum(p.size))).tolist()
                    size = p.size.astype(np.uint16)
                    if any([add(k, [size[a:b].tobytes(), p.owner[a:b].tobytes(), text[end[a] : end[b]]], end[b] - end[a] + 10 * (b - a)) for k, a, b in p.stretches]):
                        yield flush(row["pack"])
            yield flush(row["pack"])

    def pool(t: pa.Table):
        """Sizes and owners by row; the distinct pieces with their least owners; of each piece its number among these."""
        unpack = zstandard.ZstdDecompressor()
        sizes = [x.astype(np.int64) for x in _arrays(t, "sizes", np.uint16)]
        own = np.concatenate(_arrays(t, "owners", np.int64))
        size = np.concatenate(sizes)
        text = np.frombuffer(b"".join([*(unpack.decompress(x) for x in t.column("text").to_pylist()), bytes(PAD)]), np.uint8)
        start = np.cumsum(size) - size
        by, new = distinct(text, start, size)
        least = np.minimum.reduceat(own[by], np.flatnonzero(new)) if len(by) else own
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        head = by[new]
        return sizes, own, text[stretch(start[head], size[head])], size[head], least, which

    def windows(many: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of pieces, the numbers of their windows among those of the distinct pieces."""
        return stretch((np.cumsum(many) - many)[which], many[which])

    def actions():
        pooled = _Last(pool)

        def merge(t: pa.Table) -> pa.Table:
            _, _, text, size, least, _ = pooled(t)
            return _one(t, sizes=size.astype(np.uint16).tobytes(), owners=least.tobytes(), text=zstandard.ZstdCompressor(level=1).compress(text.tobytes()))

        def tell(t: pa.Table) -> pa.Table:
            sizes, _, text, size, least, which = pool(t)
            best = least_owners(text, np.cumsum(size) - size, size, least, length)[windows(size - length + 1, which)]
            cut = np.cumsum([int((s - length + 1).sum()) for s in sizes])[:-1]
            return pa.table({"bucket": t.column("bucket"), "part": t.column("part"), "said": pa.array([x.tobytes() for x in np.split(best, cut)], pa.binary())})

        def finish(t: pa.Table, told: pa.Table) -> pa.Table:
            sizes, own, _, size, _, which = pooled(t)
            best = _arrays(told, "said", np.int64)[0][windows(size - length + 1, which)]
            smaller = best < np.repeat(own, (size - length + 1)[which])
            return _bits(t, smaller, [int((s - length + 1).sum()) for s in sizes])

        return merge, tell, finish

    sent = joined.mapInArrow(send, "bucket long, pack long, seq long, sizes binary, owners binary, text binary")
    bits = _resolve(sent, many_packs, fan, actions, "bucket long, part long, sizes binary, owners binary, text binary")
    return bits.groupBy("pack").agg(F.collect_list(F.struct("seq", "bucket", "n", "bits", "heavy")).alias("answers"))


def _copied(row: dict) -> np.ndarray:
    out = np.zeros(sum(row["counts"]), bool)
    out[row["copies"] or []] = True
    return out


def _removed(row: dict, length: int, sizes: tuple[int, int, int]):
    """A pack's blobs and which of their bytes go."""
    shared, windows, answers, copied = Answers(row["shared"]), Answers(row["windows"]), Answers(row["answers"]), _copied(row)
    for at, blob in _blobs(row, length):
        window = np.zeros(blob.size + 1, bool)
        own = copied[at : at + len(blob.ids)]
        for part in blob.parts() if shared.whole else ():
            p = Pieces(blob, part, shared, windows, own, sizes)
            many = p.size - length + 1
            end = np.concatenate(([0], np.cumsum(many)))
            flags = answers.take([(k, int(end[a]), int(end[b])) for k, a, b in p.stretches]).view(bool)
            # What the least id that has a piece here may keep, documents of larger ids here may not.
            said = flags[stretch(end[:-1][p.of], many[p.of])] | np.repeat(blob.ids[p.doc] > p.owner[p.of], many[p.of])
            window[stretch(p.first, many[p.of])] = said
        edge = np.diff(window.view(np.int8), prepend=np.int8(0))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + length - 1
        gap = np.flatnonzero(start[1:] > stop[:-1])  # spans that overlap or touch are one
        gone = np.zeros(blob.size + 1, np.int8)
        if len(start):
            gone[start[np.concatenate(([0], gap + 1))]] = 1
            gone[stop[np.concatenate((gap, [len(stop) - 1]))]] = -1
            np.cumsum(gone, dtype=np.int8, out=gone)
        gone = gone[: blob.size].view(bool)
        for d in np.flatnonzero(own):
            if blob.ends[d] - blob.starts[d] >= length:
                gone[blob.starts[d] : blob.ends[d]] = True
        yield blob, gone


def _outcomes(judged: DataFrame, length: int, sizes: tuple[int, int, int], texts_too: bool) -> DataFrame:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text_sha256", "kept"] if texts_too else [])]

    def run(batches):
        for row in _each(batches):
            for blob, gone in _removed(row, length, sizes):
                out = []
                for i, a, e in zip(blob.ids.tolist(), blob.starts.tolist(), blob.ends.tolist(), strict=True):
                    g, raw = gone[a:e], blob.text[a:e]
                    n = int(np.count_nonzero(g))
                    kept = (raw[~g] if n else raw).tobytes()
                    spans = int(np.count_nonzero(np.diff(g.view(np.int8), prepend=np.int8(0)) == 1)) if n else 0
                    out.append((None if i == NO_ID else i, e - a, n, spans, hashlib.sha256(kept).hexdigest(), *([hashlib.sha256(raw.tobytes()).hexdigest(), kept.decode("utf-8", "ignore")] if texts_too else [])))
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

    return judged.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text_sha256 string, kept string" if texts_too else ""))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, blob_bytes: int = 1 << 20, pack_bytes: int = 16 << 20, anchor_bytes: int = 64 << 20, piece_bytes: int = 6 << 20, fan: int = 4096, heavy: int = 8192, texts_too: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256; with texts_too also the remaining text (bytes that a cut leaves as broken characters go).

    anchor_bytes and piece_bytes are what a bucket gets: texts whose anchors it compares, and pieces it sorts.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 256)
    ready_checkpoints(spark)
    few, numbers = _numbered(docs, id_col, text_col)
    packs = _packs(few, blob_bytes, pack_bytes).checkpoint()
    size, many = packs.agg(F.sum("bytes"), F.count("*")).first()
    texts_of = packs.select("pack", "ids", "ends", "counts", "blobs")
    anchor_buckets = max(8, -(-(size or 0) // anchor_bytes))
    told = _shared(texts_of, many, fan, length, anchor_buckets, "shared", _all_anchors(length), heavy).join(_copies(packs), "pack", "full").checkpoint()
    n_shared, n_heavy = (x or 0 for x in told.agg(F.sum("n_shared"), F.sum("n_heavy")).first())
    joined = texts_of.join(told.drop("n_shared", "n_heavy"), "pack", "left")
    # From here on one query: the packs' exchange is made once and serves all three joins.
    window_buckets = max(8, -(-n_heavy * length // (anchor_bytes // 16)))
    if n_heavy:
        windows = _shared(joined, many, fan, length, window_buckets, "windows", _heavy_windows(length, anchor_buckets), NO_ID).select("pack", "windows")
        joined = joined.join(windows, "pack", "left")
    else:
        joined = joined.withColumn("windows", F.lit(None).cast(told.schema["shared"].dataType))
    buckets = max(8, -(-(n_shared + n_heavy) * 2 * length // piece_bytes))  # a hash stands for a piece or two of less than 2 x length bytes
    sizes = (anchor_buckets, window_buckets, buckets)
    answers = _answers(joined, many, fan, length, sizes)
    out = _outcomes(joined.join(answers, "pack", "left"), length, sizes, texts_too)
    if numbers is not None:
        out = out.join(numbers.withColumnsRenamed({"id": "_id", "number": "id"}), "id", "left").select(F.col("_id").alias("id"), *out.columns[1:])
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = 50) -> DataFrame:
    """docs, all columns, with repeated passages cut from the text and, if there is such a column, its length renewed."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    kept = remove_repeats(inner, own, text, length, texts_too=True).select(F.col(own).alias("k"), F.col("text_sha256").alias("digest"), "kept").dropDuplicates(["k", "digest"])
    rest = inner.withColumn("digest", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).withColumn("null_text", F.col(text).isNull()).drop(text)
    both = rest.join(kept, F.col(own).eqNullSafe(F.col("k")) & (rest["digest"] == kept["digest"]))
    new = F.when(~F.col("null_text"), F.col("kept"))
    return both.select(*[new.alias(c) if c == text_col else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
