"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Tokens: each document's ids, then one separator id. Only what is longer than a
sequence is cut, into whole sequences behind a first, shorter piece.

Packing works on the histogram of piece lengths, at most `size` numbers however
many documents there are. An individual is a set of bins with multiplicities.
Crossover injects whole well-filled bins of one parent, takes from the other
parent what the histogram still has (duplicates go) and puts displaced pieces
where they fit best; leftovers open new bins. Islands run as tasks and exchange
their elites between epochs; they start from random groupings and stop early at
a bound that no packing can beat: ceil(tokens / size), or the pieces of over
half a sequence.

Pieces are then dealt to the bins by their rank among pieces of their length:
ranks are counts per scan partition plus the place in it, so no length, however
common, is gathered in a task.

Defined results: null and empty documents are the separator alone; repeated
rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_batches, ready_checkpoints

# ----------------------------------------------------------------- tokens


class Classes:
    """Whether the two libraries class a character alike, asked once a character.

    A text's pieces depend on its characters' classes (letter, number, white space, other) only, so
    texts of characters classed alike are split alike.
    """

    def __init__(self, pre_tokenizer):
        import tiktoken

        self.split = pre_tokenizer.pre_tokenize_str
        bare = {bytes([i]): i for i in range(256)}
        self.find = [(k, tiktoken.Encoding(k, pat_str=p, mergeable_ranks=bare, special_tokens={}).encode_ordinary) for k, p in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s"))]
        self.alike: set[str] = set()
        self.other: set[str] = set()

    def kinds(self, c: str) -> tuple[str, str]:
        """The class that each library gives a character: one piece with a letter, a number or a mark before it, or with neither."""
        mine = next((k for k, found in self.find if found(c)), "other")
        return mine, next((k for k, before in (("letter", "a"), ("number", "1"), ("other", "!")) if len(self.split(before + c)) == 1), "space")

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return True
        for c in (own := set(text)) - self.alike - self.other:
            mine, theirs = self.kinds(c)
            (self.alike if mine == theirs else self.other).add(c)
        return not own & self.other


@lru_cache(2)
def _encoder(path: str):
    """Encodes a batch of texts by a byte-level BPE file, as tokenizers does without options.

    The same merges run in tiktoken, which gives equal ids several times faster. Texts that hold a
    special token's string, a character that the libraries class differently or a very long run of
    white space go to tokenizers.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    spec = json.loads(exact.to_str())
    plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True} and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
    if not plain:
        return lambda texts: [np.array(e.ids, np.uint32) for e in exact.encode_batch(texts, add_special_tokens=False)]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_char = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    as_byte = {c: b for b, c in as_char.items()}
    added = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    #: Fixed value: the byte-level pre-tokeniser's pattern.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    classes = Classes(exact.pre_tokenizer)
    blank = re.compile(r"\s{50000}")  # tiktoken's stack does not hold very long runs of white space

    def slow(t: str) -> bool:
        return any(x in t for x in added) or len(t) >= 50_000 and blank.search(t) is not None or not classes(t)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(exact.encode(t, add_special_tokens=False).ids if slow(t) else fast.encode_ordinary(t), dtype=np.uint32) for t in texts]

    return encode


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than a sequence."""
    head = n % size or size
    return [(0, head), *((s, size) for s in range(head, n, size))]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, separator: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part): part is the scan partition."""
    bounded_batches(docs.sparkSession)
    few = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def run(batches):
        encode = _encoder(tokenizer)
        for b in batches:
            rows, whose = [], []
            for i, ids in enumerate(encode(b.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(separator)).astype("<u4")
                for k, (start, n) in enumerate(cuts(len(ids), size)):
                    whose.append(i)
                    rows.append((k, start, n, zlib.crc32(ids[start : start + n])))
            k, start, n, crc = np.array(rows, dtype=np.int64).reshape(-1, 4).T
            at = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(k, pa.int32()), pa.array(start), pa.array(n), pa.array(crc), b.column(2).take(at)], names=["id", "piece", "start", "length", "ids_crc32", "part"])

    return few.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int")


# ----------------------------------------------------------------- genetic algorithm

Bins = dict[tuple[int, ...], int]  # a bin's lengths, longest first -> how many such bins


def best_fit(bins: Bins, rest: dict[int, int], size: int, order: list[int]) -> Bins:
    """Puts the rest, in the given order of lengths, into the fullest bins that have room, else into new bins."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for b, n in bins.items():
        group = room.setdefault(size - sum(b), {})
        group[b] = group.get(b, 0) + n
    free = sorted(room)
    for length in order:
        left = rest.get(length, 0)
        while left:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                fill = min(size // length, left)
                new, n = (length,) * fill, left // fill
                left -= n * fill
                put = size - length * fill
            else:
                gap = free[at]
                group = room[gap]
                b, n = next(iter(group.items()))
                fill = min(gap // length, left)
                n = min(n, left // fill)
                new, left, put = (*b, *(length,) * fill), left - n * fill, gap - length * fill
                group[b] -= n
                if not group[b]:
                    del group[b]
                    if not group:
                        del room[gap]
                        free.pop(at)
            if put not in room:
                room[put] = {}
                bisect.insort(free, put)
            room[put][new] = room[put].get(new, 0) + n
    out: Bins = {}
    for group in room.values():
        for b, n in group.items():
            key = tuple(sorted(b, reverse=True))
            out[key] = out.get(key, 0) + n
    return out


def cost(bins: Bins, size: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return sum(bins.values()), -sum(n * (sum(b) / size) ** 2 for b, n in bins.items())


def crossover(giver: Bins, taker: Bins, histogram: dict[int, int], size: int, rng: random.Random) -> Bins:
    """Whole well-filled bins of the giver, what is left of the taker's, and the displaced by best fit."""
    left, child = dict(histogram), {}

    def take(b: tuple[int, ...], most: int) -> None:
        need: dict[int, int] = {}
        for x in b:
            need[x] = need.get(x, 0) + 1
        n = min([most, *(left.get(x, 0) // k for x, k in need.items())])
        if n > 0:
            child[b] = child.get(b, 0) + n
            for x, k in need.items():
                left[x] -= n * k

    enough = size * (1 - 10 ** rng.uniform(-4, -1.5))  # what counts as well filled
    few = rng.random() < 0.7  # bins of few pieces first, as many small pieces fill gaps better when dealt anew
    filled = sorted((b for b in giver if sum(b) >= enough), key=lambda b: (len(b) * few, -sum(b), rng.random()))
    for b in filled[: max(1, int(len(filled) * rng.uniform(0.3, 0.9)))]:
        take(b, giver[b] if rng.random() < 0.8 else max(1, giver[b] // 2))
    for b in sorted((b for b in taker if sum(b) >= enough), key=lambda b: (len(b) * few, -sum(b), rng.random())):
        if rng.random() < (1.5 / len(b) if few else 0.8):
            take(b, taker[b])
    jitter = rng.choice((0, 0, 0.05))
    order = sorted((x for x, n in left.items() if n), key=lambda x: -x * rng.uniform(1 - jitter, 1))
    return best_fit(child, left, size, order)


def random_grouping(histogram: dict[int, int], size: int, rng: random.Random) -> Bins:
    """Lengths in random order, each put where it fits best."""
    order = sorted(histogram)
    rng.shuffle(order)
    return best_fit({}, histogram, size, order)


def evolve(histogram: dict[int, int], came: list[Bins], size: int, seed: int, rounds: int = 30, crowd: int = 8) -> list[Bins]:
    """One island's epoch from random groupings and those that came by migration: its two best individuals, the best first."""
    rng = random.Random(seed)
    bound = least_bins(histogram, size)
    everyone = sorted([*came, *(random_grouping(histogram, size, rng) for _ in range(crowd - len(came)))], key=lambda b: cost(b, size))
    for _ in range(rounds):
        parents = everyone[: max(2, crowd // 2)]
        children = [crossover(*rng.sample(parents, 2), histogram, size, rng) for _ in range(crowd - len(parents))]
        everyone = sorted(parents + children, key=lambda b: cost(b, size))
        if sum(everyone[0].values()) <= bound:
            break
    return everyone[:2]


def least_bins(histogram: dict[int, int], size: int) -> int:
    """No packing has fewer: bins for all tokens, or one for each piece of over half a bin."""
    return max(-(-sum(x * n for x, n in histogram.items()) // size), sum(n for x, n in histogram.items() if 2 * x > size))


def _pack_bins(bins: Bins) -> str:
    return json.dumps([[list(b), n] for b, n in bins.items()])


def _read_bins(text: str) -> Bins:
    return {tuple(b): n for b, n in json.loads(text)}


def pack_histogram(spark, histogram: dict[int, int], size: int, islands: int = 4, epochs: int = 3, seed: int = 7) -> Bins:
    """The best bins that `islands` tasks find in up to `epochs` epochs with migration of elites along a ring.

    Before the last epoch, which only runs where the bound is still missed, best fit by decreasing
    length joins each island, so that the outcome is never worse than that.
    """
    if not histogram:
        return {}
    bound = least_bins(histogram, size)
    elites: list[list[Bins]] = [[] for _ in range(islands)]
    counts = [[x, n] for x, n in sorted(histogram.items())]

    def island(rows):
        for pdf in rows:
            out = [[_pack_bins(b) for b in evolve({x: n for x, n in counts}, [_read_bins(t) for t in json.loads(text)], size, int(number))] for number, text in zip(pdf["island"], pdf["elites"], strict=True)]
            yield type(pdf)({"island": pdf["island"], "elites": [json.dumps(o) for o in out]})

    for epoch in range(epochs):
        if epoch and epoch == epochs - 1:
            elites = [[best_fit({}, histogram, size, sorted(histogram, reverse=True)), *e] for e in elites]
        rows = [(seed + epoch * islands + i, json.dumps([_pack_bins(b) for b in elites[i]])) for i in range(islands)]
        frame = spark.createDataFrame(rows, "island long, elites string").repartitionByRange(islands, "island")
        found = sorted(frame.mapInPandas(island, "island long, elites string").collect(), key=lambda r: r.island)
        groups = [[_read_bins(t) for t in json.loads(r.elites)] for r in found]
        best = min((b for g in groups for b in g), key=lambda b: cost(b, size))
        if sum(best.values()) <= bound:
            break
        elites = [[groups[i][0], groups[i - 1][0]] for i in range(len(groups))]
    return best


# ----------------------------------------------------------------- dealing


def _slots(bins: Bins) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of slots, its first sequence and its offset."""
    sequence, runs = 0, {}
    for b, n in sorted(bins.items(), key=lambda x: (-x[1], x[0])):
        offset = 0
        for x in b:
            runs.setdefault(x, []).append((n, sequence, offset))
            offset += x
        sequence += n
    out = {}
    for x, rows in runs.items():
        n, first, offset = np.array(rows, dtype=np.int64).T
        out[x] = (np.concatenate(([0], np.cumsum(n)[:-1])), first, offset)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, separator: int = 0, islands: int = 4, epochs: int = 3) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ready_checkpoints(spark)
    pieces = token_pieces(docs, tokenizer, id_col, text_col, size, separator).checkpoint()
    cells = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(spark, histogram, size, islands, epochs)))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(own) - 1).join(bases, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))

    def deal(batches):
        table = slots.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else []:
                start, first, place = table[int(length[rows[0]])]
                run = np.searchsorted(start, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = first[run] + rank[rows] - start[run], place[run]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(deal, kind).withColumnRenamed("id", id_col)
