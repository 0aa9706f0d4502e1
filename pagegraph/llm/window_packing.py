"""Best-fit-decreasing packing of documents into windows without padding.

Tokens: each document's ids, then one separator id. What is longer than a window
is first cut into full windows; the rest of it, and shorter documents, are pieces
of less than a window.

Best-fit decreasing works on the histogram of piece lengths, at most `size`
numbers however many documents there are: lengths fall, and each piece goes to
the open window with the least room that holds it. A segment tree indexed by
remaining capacity finds that window; windows of equal contents are one entry
with a count, so that a step places a whole run of equal pieces.

A window is whole where it is full or holds a power of two of tokens, which needs
no padding either. Windows that are not whole are closed by cutting: the fullest
stay and are filled up, in order, with a stream of the tokens of the emptiest;
what the stream has left is laid out in powers of two. So no sequence is padded,
and only pieces of the emptiest windows are cut.

Pieces are dealt to their places by rank: a count per length and scan partition
and the place in it. A piece that goes into the stream finds all its places by
its place in the stream alone, so nothing but the histogram meets in one task or
on the driver.

Defined results: null and empty documents are the separator alone; repeated rows
and null ids are packed each; an empty table gives no rows; other columns are
ignored. Long texts are tokenised in slices.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_batches, ready_checkpoints, taken

# ----------------------------------------------------------------- tokens


#: How a word vocabulary splits a text: contractions, runs of letters, single digits, runs of anything else but white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPLIT = CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words(dict):
    """Ids of words (lowered pieces of the split) by the vocabulary's merges; forgets all when it grows over its bound.

    Normaliser and pre-tokeniser are asked once a character: a text whose characters Python lowers and
    classes (letter, number, other, white space) as they do can be split here.
    """

    def __init__(self, exact, most: int = 800_000):
        super().__init__()
        self.model, self.norm, self.split, self.most = exact.model, exact.normalizer.normalize_str, exact.pre_tokenizer.pre_tokenize_str, most
        # Only contractions and runs of anything else can begin alike, so letters may come first.
        self.find = re.compile(rf"[^\W\d_]+|\d|{CONTRACTIONS}|(?:[^\w\s]|_)+").findall
        self.find_ascii = re.compile(rf"[a-z]+|[0-9]|{CONTRACTIONS}|[^\x09-\x0D\x20a-z0-9]+").findall
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # a byte-level vocabulary's characters
        self.alike: set[str] = set()
        self.other: set[str] = set()

    def __missing__(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else "".join(map(self.shown.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        data = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = data
        return data

    def agrees(self, c: str) -> bool:
        low = c.lower()
        # Marks and Hangul parts combine with their neighbours; a sigma is lowered by its place.
        if len(low) != 1 or c == "\u03a3" or any(unicodedata.category(x)[0] == "M" for x in (c, low)) or any(a <= ord(c) <= z for a, z in ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF))):
            return False
        blank = re.fullmatch(r"\s", c) is not None
        if self.norm(c) != (" " if blank else low):
            return False
        alone, after_letter, after_mark = (len(self.split(x + low)) for x in ("", "a", "!"))
        theirs = "space" if not alone else "letter" if after_letter == 1 else "other" if after_mark == 1 else "number"
        return theirs == ("space" if blank else "letter" if re.fullmatch(r"[^\W\d_]", low) else "number" if re.fullmatch(r"\d", low) else "other")

    def knows(self, text: str) -> bool:
        own = set(text)
        if not own <= self.alike:
            for c in own - self.alike - self.other:
                (self.alike if self.agrees(c) else self.other).add(c)
        return own <= self.alike

    def ids(self, text: str) -> bytes:
        found = self.find_ascii(text.lower()) if text.isascii() else self.find(text.lower())
        return b"".join(map(self.__getitem__, found))


@lru_cache(2)
def text_encoder(path: str):
    """text -> its ids as unsigned 32-bit little-endian bytes, as tokenizers gives them without special tokens.

    Where a vocabulary lowers, splits into words and drops white space, ids of a text are those of its
    words one after the other, and equal words are looked up. Of texts with characters or special
    tokens that this can't do, runs without white space go to tokenizers; whole texts do where Python
    splits at characters that are no white space there.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    spec = json.loads(exact.to_str())
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SPLIT} and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    lowers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if not known or not lowers or spec["post_processor"]:
        return whole
    words = Words(exact)
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
    odd = re.compile("[" + "".join(re.escape(c) for c in blanks if not words.agrees(c)) + "]")
    blank = re.compile(r"\s")
    added = [t["content"] for t in spec["added_tokens"]]

    def encode(text: str, slice_chars: int = 1 << 20) -> bytes:
        if odd.search(text):
            return whole(text)
        special = any(t in text for t in added)
        out, at = [], 0
        while at < len(text):
            found = blank.search(text, at + slice_chars)
            end = found.start() if found else len(text)
            part = text[at:end]
            if not special and (part.isascii() or words.knows(part)):
                out.append(words.ids(part))
            else:
                out += [words.ids(run) if words.knows(run) and not any(t in run for t in added) else whole(run) for run in part.split()]
            at = end
        return b"".join(out)

    return encode


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, part int, place long, ids binary"


def window_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, separator: int = 1) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, part, place, ids): full windows, then the rest of a document.

    part is the scan partition and place the number of pieces of that length before it there. ids are
    kept of what is shorter than a window, as only that can be cut again.
    """
    bounded_batches(docs.sparkSession)
    few = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    end = np.array([separator], "<u4").tobytes()
    width = 4 * size

    def run(batches):
        encode = text_encoder(tokenizer)
        counts: dict[int, int] = {}
        for b in batches:
            whose, rows, ids = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = encode(text) + end
                n = len(data) // 4
                for at in range(0, len(data), width):
                    piece = data[at : at + width]
                    length = len(piece) // 4
                    place = counts.get(length, 0)
                    counts[length] = place + 1
                    whose.append(i)
                    rows.append((at // 4, length, zlib.crc32(piece), n, place))
                    ids.append(piece if length < size else None)
            start, length, crc, n, place = np.array(rows, np.int64).reshape(-1, 5).T
            at = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *map(pa.array, (start, length, crc, n)), b.column(2).take(at), pa.array(place), pa.array(ids, pa.binary())], names=["id", "start", "length", "ids_crc32", "doc_tokens", "part", "place", "ids"])

    return few.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {PIECE}")


# ----------------------------------------------------------------- best-fit decreasing

Windows = dict[tuple[int, ...], int]  # a window's lengths, in the order they came -> how many such windows


class Capacities:
    """A segment tree over remaining capacities: which have an open window, and the least one from a given capacity on."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, there: bool) -> None:
        i = self.leaves + capacity
        self.open[i] = there
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least `length` that an open window has."""
        i = self.leaves + length
        while not self.open[i]:
            while i & 1:  # a right child: what lies to its right hangs on an ancestor
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(histogram: dict[int, int], size: int) -> Windows:
    """Windows of falling lengths, each piece in the open window with the least room for it, else in a new one."""
    tree = Capacities(size)
    room: dict[int, Windows] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            gap = tree.tightest(length)
            if gap is None:
                fill = min(size // length, left)
                old, n, gap = (), left // fill, size
            else:
                group = room[gap]
                old, there = next(iter(group.items()))
                fill = min(gap // length, left)
                n = min(there, left // fill)
                if n == there:
                    del group[old]
                    if not group:
                        del room[gap]
                        tree.set(gap, False)
                else:
                    group[old] -= n
            left -= n * fill
            new, rest = old + (length,) * fill, gap - length * fill
            group = room.setdefault(rest, {})
            group[new] = group.get(new, 0) + n
            tree.set(rest, True)
    return {w: n for group in room.values() for w, n in group.items()}


def whole(fill: int, size: int) -> bool:
    """A window that needs no padding: full, or a power of two of tokens."""
    return fill == size or fill & (fill - 1) == 0


class Plan:
    """Where each piece goes: by length, runs of ranks that lie in windows or in the stream; the rooms that the stream fills.

    runs: length -> (first rank, first window or -1, place in the first window or in the stream, step in
    the stream from one rank to the next). rooms: (place in the stream, room, first window, offset there),
    one entry for each kind of window.
    """

    def __init__(self, histogram: dict[int, int], size: int):
        kinds = sorted(best_fit_decreasing(histogram, size).items(), key=lambda x: (-sum(x[0]), x[0]))
        closed = [(w, n) for w, n in kinds if whole(sum(w), size)]
        open_ = [(w, n) for w, n in kinds if not whole(sum(w), size)]
        keep, rest = divmod(sum(sum(w) * n for w, n in open_), size)
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        rooms: list[tuple[int, int, int, int]] = []
        window = stream = filled = 0

        def put(w: tuple[int, ...], n: int, first: int, at: int, step: int) -> None:
            for length in w:
                rank = ranks.get(length, 0)
                runs.setdefault(length, []).append((rank, first, at, step))
                ranks[length] = rank + n
                at += length

        for w, n in closed:
            put(w, n, window, 0, 0)
            window += n
        for w, n in open_:  # the fullest first
            fill, stay = sum(w), min(n, keep)
            if stay:
                put(w, stay, window, 0, 0)
                rooms.append((filled, size - fill, window, fill))
                filled += stay * (size - fill)
                window, keep = window + stay, keep - stay
            if n > stay:
                put(w, n - stay, -1, stream, fill)
                stream += (n - stay) * fill
        for bit in reversed(range(size.bit_length())):  # what is left, in powers of two
            if rest >> bit & 1:
                rooms.append((filled, 1 << bit, window, 0))
                filled, window = filled + (1 << bit), window + 1
        assert filled == stream
        self.windows, self.stream = window, stream
        self.runs = {length: np.array(r, np.int64).T for length, r in runs.items()}
        self.rooms = np.array(rooms, np.int64).reshape(-1, 4).T

    def streamed(self) -> list[int]:
        """Lengths of which some pieces go into the stream."""
        return sorted(length for length, (_, first, _, _) in self.runs.items() if (first < 0).any())

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of pieces of one length; -1 and the place in the stream of those that go there."""
        start, first, at, step = self.runs[length]
        run = np.searchsorted(start, rank, side="right") - 1
        behind = rank - start[run]
        return np.where(first[run] < 0, -1, first[run] + behind), at[run] + behind * step[run]

    def cut(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        """(begin in the piece, length, window, offset) of the parts of a piece that stands at a place of the stream."""
        out, begin = [], 0
        start, room, first, offset = self.rooms
        while begin < length:
            k = int(np.searchsorted(start, at + begin, side="right")) - 1
            skipped, inside = divmod(at + begin - int(start[k]), int(room[k]))
            n = min(length - begin, int(room[k]) - inside)
            out.append((begin, n, int(first[k]) + skipped, int(offset[k]) + inside))
            begin += n
        return out


def pack_windows(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, separator: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/window-pieces-{uuid.uuid4().hex}"
    window_pieces(docs, tokenizer, id_col, text_col, size, separator).write.option("compression", "zstd").parquet(folder)
    pieces = spark.read.parquet(folder)
    cells = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    plan = Plan({r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)  # at most `size` rows
    shared = spark.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ids = F.when(F.col("length").isin(plan.streamed()), F.col("ids"))  # others stay where they are
    ranked = pieces.withColumn("ids", ids).join(bases, ["length", "part"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("rank"), "ids")

    def deal(batches):
        plan = shared.value
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            window, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else []:
                window[rows], offset[rows] = plan.find(int(length[rows[0]]), rank[rows])
            stays, start, crc = np.flatnonzero(window >= 0), b.column(1).to_numpy(), b.column(3).to_numpy()
            out = [np.array([stays, start[stays], length[stays], crc[stays], window[stays], offset[stays]])]
            for i in np.flatnonzero(window < 0):
                data = b.column(6)[i].as_py()
                parts = [(i, start[i] + begin, n, zlib.crc32(data[4 * begin : 4 * (begin + n)]), w, o) for begin, n, w, o in plan.cut(int(offset[i]), int(length[i]))]
                out.append(np.array(parts, np.int64).T)
            row, *columns = np.concatenate(out, axis=1)
            at = pa.array(row)
            start, length, crc, window, offset = map(pa.array, columns)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), start, length, crc, b.column(4).take(at), window, offset], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = f"id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return taken(ranked.mapInArrow(deal, kind).withColumnRenamed("id", id_col), folder)
