"""Upsert, update and delete semantics as aggregations and joins.

A table has no physical order, so merges take a sequence column: the greatest
sequence is the last write.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_last_non_null(rows: DataFrame, keys: list[str], seq: str, last: list[str], first: list[str] = ()) -> DataFrame:
    """One row per key: of `last` columns the newest value that is not null, of `first` columns the oldest row's."""
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in last]
    oldest = [F.min_by(c, seq).alias(c) for c in first]
    return rows.groupBy(*keys).agg(*newest, *oldest)


def upsert_additive(tables: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """Adds up measures of rows with equal keys over all tables."""
    every = tables[0].select(*keys, *measures)
    for t in tables[1:]:
        every = every.unionByName(t.select(*keys, *measures))
    return every.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def insert_ignore(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(seq)).alias("_r")).select(*keys, "_r.*")


def update_exists(rows: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """Adds a flag: whether the row's key is among keys."""
    k = keys.select(F.col(on).alias("_k")).distinct()
    return rows.join(k, F.col(on) == F.col("_k"), "left").withColumn(flag, F.col("_k").isNotNull()).drop("_k")


def update_join(rows: DataFrame, changes: DataFrame, on: str, column: str) -> DataFrame:
    """Sets a column from the change of the same key, where there is one."""
    c = changes.select(F.col(on).alias("_k"), F.col(column).alias("_v"), F.lit(True).alias("_hit"))
    return rows.join(c, F.col(on) == F.col("_k"), "left").withColumn(column, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(column))).drop("_k", "_v", "_hit")


def update_case(rows: DataFrame, key: str, column: str, values: Mapping) -> DataFrame:
    """Sets a column from literal values by key; other rows keep theirs."""
    if not values:
        return rows
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return rows.withColumn(column, F.coalesce(F.try_element_at(m, F.col(key)), F.col(column)))


def fill_from(rows: DataFrame, on: str, column: str, *sources: DataFrame) -> DataFrame:
    """Fills a column from the first source, by key, that has a value."""
    for i, s in enumerate(sources):
        s = s.select(F.col(on).alias(f"_k{i}"), F.col(column).alias(f"_v{i}"))
        rows = rows.join(s, F.col(on) == F.col(f"_k{i}"), "left")
    filled = F.coalesce(*([F.col(column)] if column in rows.columns else []), *[F.col(f"_v{i}") for i in range(len(sources))])
    return rows.withColumn(column, filled).drop(*[f"_{x}{i}" for i in range(len(sources)) for x in "kv"])


def delete_where_in(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(keys.select(*([on] if isinstance(on, str) else on)), on, "left_anti")


def replace_changed(rows: DataFrame, fresh: DataFrame, changed: DataFrame, on: str) -> DataFrame:
    """Rows of changed keys go, fresh rows come."""
    return delete_where_in(rows, changed, on).unionByName(fresh)


def update_where(rows: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    return rows.withColumn(column, F.when(condition, value).otherwise(F.col(column)))
