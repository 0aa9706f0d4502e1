"""From raw documents to packed sequences, in five stages over Parquet.

Each stage works on all that the one before kept, and all but the last return
the columns of documents, whatever further columns these have. Defined results
common to all stages: an empty table stays empty; null ids, repeated ids and
other columns of any name pass through; null and empty texts are documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagegraph.llm.decontaminate import keep_clean
from pagegraph.llm.packing import pack_documents
from pagegraph.llm.quality import keep_good
from pagegraph.llm.queries import vocabulary
from pagegraph.llm.simhash import keep_one
from pagegraph.llm.suffix_dedup import cut_repeats
from pagegraph.session import ready_checkpoints, remove_folder, table, taken


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; repeated rows fare alike; without usable labels all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the least id's; repeated rows become one, empty texts are one component."""
    return keep_one(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document of smaller id has are cut; every document stays, if with an empty text; null texts stay null."""
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty ones have none; an empty benchmark drops nothing."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in training sequences; a null or empty text is its separator."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup), ("decontamination", decontamination), ("packing", packing)]

#: No stage before packing, and not packing, can be put in SQL; tests/llm compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and reread, and removed when the next one is there. The result is checkpointed."""
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return taken(docs, folder)
