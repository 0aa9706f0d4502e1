"""Aggregates and window-like operators with their tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The element n // 2 (from 0) of each group's values in ascending order, by counts of distinct values, not by gathering them."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    return run.where("_upto > _all div 2").groupBy(*keys).agg(F.min(value).alias(name))


def mode_with_ties(rows: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value; of equally frequent ones the least."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def unique_or_null(value: Column) -> Column:
    """An aggregate: the only distinct value of a group, else null."""
    return F.when(F.count_distinct(value) == 1, F.max(value))


def best_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the planner keeps k rows a group before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).withColumnRenamed("_rn", "place")


def share_of_total(rows: DataFrame, keys: list[str], value: str, name: str = "share") -> DataFrame:
    """Each row's percentage of its group's total, to six places."""
    if keys:
        joined = rows.join(rows.groupBy(*keys).agg(F.sum(value).alias("_t")), keys)
    else:
        joined = rows.withColumn("_t", rows.agg(F.sum(value)).scalar())
    return joined.withColumn(name, F.round(F.col(value) * 100.0 / F.col("_t"), 6)).drop("_t")


def log_gradation(value: Column, base: float) -> Column:
    """floor(log_base(value)); below one: -1."""
    return F.when(value >= 1, F.floor(F.log(float(base), value) + 1e-9)).otherwise(-1).cast("long")


def log_histogram(rows: DataFrame, key: str, base: float = 2) -> DataFrame:
    """(bucket, groups): how many groups have a row count of each order of magnitude."""
    per = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return per.groupBy(log_gradation(F.col("_n"), base).alias("bucket")).agg(F.count("*").alias("groups"))


def first_seen(rows: DataFrame, keys: list[str], order: str, match: Column) -> DataFrame:
    """Where a condition first becomes true along each group's order, after having been false or at its start."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_m", F.coalesce(match, F.lit(False)))
    return marked.withColumn("_before", F.lag("_m").over(w)).where("_m and not coalesce(_before, false)").groupBy(*keys).agg(F.min(order).alias("first_seen"))


def breaks(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of equal values in each group's order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")


def concat_distinct(value: Column, separator: str = ",", most: int | None = None) -> Column:
    """An aggregate: distinct values in order, joined, and cut at `most` characters where that is given."""
    out = F.array_join(F.array_sort(F.collect_set(value)), separator)
    return F.substring(out, 1, most) if most else out
