"""Full-text search: a positional inverted index as a table, and queries in boolean and natural mode.

The index has one row per occurrence: word, document and place. It is written
where the texts are read, without a shuffle: a file holds the words of its task's
documents in order, so that a search for some words skips most of each file, and
a common word lies in all files and is read by all tasks.

A query is a line of clauses: `word` raises the relevance, `+word` must occur,
`-word` must not, `~word` lowers the relevance; `"some words"` stand one behind
the other, `word*` begins so. Each clause is a posting list of documents and
occurrences; lists meet by document. A phrase's occurrences meet by document and
the place where the phrase would begin. Relevance is the sum over clauses of
occurrences times the square of log10(documents / documents with the clause).

Defined results: words are lower-cased runs of letters and digits; null texts have
none; an operator without a word is ignored; without a clause that must or may
occur nothing is found; repeated ids are one document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready_checkpoints

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Clause:
    """sign: one of + - ~ and nothing; words: one, or a phrase's; prefix: whether the word is only the beginning."""

    sign: str
    words: tuple[str, ...]
    prefix: bool = False


def clauses(query: str, natural: bool = False) -> list[Clause]:
    """The clauses of a query; in natural mode each word once, without signs."""
    found = []
    for sign, phrase, word, star in re.findall(r'([+\-~]?)(?:"([^"]*)"|([^\s"+\-~*]+)(\*?))', query):
        parts = tuple(re.findall(r"[^\W_]+", (phrase or word).lower()))
        if parts:
            found.append(Clause(sign, parts, bool(star) and len(parts) == 1))
    return [Clause("", (w,)) for w in dict.fromkeys(w for c in found for w in c.words)] if natural else list(dict.fromkeys(found))


def write_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Occurrences (word, doc, place), in order of words within each file."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(words(F.col(text_col).cast("string"))).alias("place", "word"))
    rows.select("word", "doc", "place").sortWithinPartitions("word", "doc", "place").write.option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def postings(index: DataFrame, clause: Clause) -> DataFrame:
    """(doc, n): how often a clause occurs in each document that has it."""
    if len(clause.words) == 1:
        word = clause.words[0]
        return index.where(F.startswith("word", F.lit(word)) if clause.prefix else F.col("word") == word).groupBy("doc").agg(F.count("*").alias("n"))
    at: dict[str, list[int]] = {}
    for i, w in enumerate(clause.words):
        at.setdefault(w, []).append(i)
    offsets = reduce(lambda c, w: c.when(F.col("word") == w, F.array(*map(F.lit, at[w]))), at, F)  # where in the phrase a word stands
    begins = index.where(F.col("word").isin(list(at))).select("doc", "place", F.explode(offsets).alias("offset")).groupBy("doc", (F.col("place") - F.col("offset")).alias("begin")).agg(F.count("*").alias("n"))
    return begins.where(F.col("n") == len(clause.words)).groupBy("doc").agg(F.count("*").alias("n"))


def search(index: DataFrame, documents: int, query: str, natural: bool = False) -> DataFrame:
    """(doc, occurrences, relevance) of the documents that a query finds. occurrences: of all clauses but excluded ones."""
    ready_checkpoints(index.sparkSession)
    asked = clauses(query, natural)
    wanted = [k for k, c in enumerate(asked) if c.sign in ("", "+")]
    if not wanted or not documents:
        return index.select("doc", F.lit(0).cast("bigint").alias("occurrences"), F.lit(0.0).alias("relevance")).limit(0)
    lists = [postings(index, c).select("doc", F.lit(k).alias("clause"), "n") for k, c in enumerate(asked)]
    every = reduce(DataFrame.unionAll, lists)
    hits = every.groupBy("doc").agg(*[F.coalesce(F.max(F.when(F.col("clause") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(len(asked))]).checkpoint()
    found = hits.agg(*[F.count_if(F.col(f"n{k}") > 0).alias(f"n{k}") for k in range(len(asked))]).first()  # one row
    must = [k for k, c in enumerate(asked) if c.sign == "+"]
    rule = reduce(lambda a, b: a & b, [F.col(f"n{k}") > 0 for k in must]) if must else reduce(lambda a, b: a | b, [F.col(f"n{k}") > 0 for k in wanted])
    for k, c in enumerate(asked):
        if c.sign == "-":
            rule = rule & (F.col(f"n{k}") == 0)
    counted = [k for k, c in enumerate(asked) if c.sign != "-"]
    relevance = F.lit(0.0)
    for k in counted:
        if found[k]:
            idf = F.log10(F.lit(documents) / F.lit(found[k]))
            relevance = relevance + (-1 if asked[k].sign == "~" else 1) * F.col(f"n{k}") * idf * idf
    return hits.where(rule).select("doc", reduce(lambda a, b: a + b, [F.col(f"n{k}") for k in counted]).alias("occurrences"), relevance.alias("relevance"))
