"""Connected components with DataFrame operations only.

Alternating large-star and small-star steps: in each, every node is told the
least node among its neighbours, by a partial aggregate, and its edges are
re-hung on that node by an equi-join with one row per node. No step gathers a
node's neighbours, so a hub of any degree is only a skewed join key, which the
adaptive planner splits: the table of least nodes is dealt out anew before each
join, as a side that still lies as its aggregate left it could not be split.
Each round's edges are checkpointed, which cuts the
lineage and survives lost executors; the rounds needed grow with the logarithm
of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready_checkpoints


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours v."""
    return dealt(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows with one of each key, dealt out by a hash of it, so that both sides of a join on the key are plain exchanges and a hot key's partition can be split."""
    return rows.repartition(F.xxhash64(key))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down)
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node of an edge list; a component is named by its least node.

    Nulls on either side and loops add no link (a node with only loops has no row); repeated
    and reversed edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    ready_checkpoints(spark)
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct().checkpoint()
    mark = None
    while True:
        e = _small_star(_large_star(e)).checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v"), F.col("v")).distinct())
