"""Sinks: tab-separated, JSON, XML and text files, table swaps, HTML at the edge."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes that a tab-separated field cannot hold as they are, and the letters that stand for them behind a backslash.
ESCAPES = {"\\": "\\", "\0": "0", "\b": "b", "\n": "n", "\r": "r", "\t": "t", "\x16": "Z"}


def tsv_field(c: Column, kind: str) -> Column:
    """A column as the text of a field: \\N for null, 1 and 0 for truth values, escapes behind a backslash."""
    text = F.when(c, "1").otherwise("0") if kind == "boolean" else c.cast("string")
    if kind in ("string", "binary"):
        for raw, letter in ESCAPES.items():  # the backslash first
            text = F.replace(text, F.lit(raw), F.lit(f"\\{letter}"))
    return F.when(c.isNull(), "\\N").otherwise(text)


def write_tsv(df: DataFrame, path: str, header: bool = False, compression: str = "none") -> None:
    """A line a row, fields between tabs; with header each file begins with a line of names. Readers know compressed files by their names."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    lines = df.select(F.concat_ws("\t", *[tsv_field(F.col(f"`{c}`"), k) for c, k in kinds.items()]).alias("value"))
    if header:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of each file
        lines = lines.withColumn("first", first).select(F.explode(F.when(F.col("first"), F.array(F.lit("\t".join(kinds)), "value")).otherwise(F.array("value"))).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").option("compression", compression).text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object per line; arrays of structs stay nested."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, line) -> None:
    df.select(line.cast("string").alias("value")).write.mode("overwrite").text(path)


def as_json(df: DataFrame, name: str = "json", callback: str | None = None) -> DataFrame:
    """Rows as JSON objects, wrapped in a call if a callback is given."""
    j = F.to_json(F.struct(*df.columns))
    return df.select((F.concat(F.lit(f"{callback}("), j, F.lit(")")) if callback else j).alias(name))


def as_xml(df: DataFrame, row: str = "row", name: str = "xml") -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row}).alias(name))


def html_table(df: DataFrame, caption: str = "", most: int = 1000) -> str:
    """An HTML table of a report's first rows, made on the driver."""
    body = df.limit(most).toPandas().to_html(index=False, classes="wikitable sortable", border=0)
    return body.replace("<thead>", f"<caption>{caption}</caption>\n  <thead>", 1) if caption else body


def _versions(spark: SparkSession, table: str) -> list[str]:
    """Versions of a rebuilt table, the oldest first."""
    return sorted(t.name for t in spark.catalog.listTables() if re.fullmatch(rf"{re.escape(table.lower())}_[0-9a-f]{{16}}", t.name))


def rebuild(spark: SparkSession, df: DataFrame, table: str) -> None:
    """Writes a new version beside the old one and points the name, a view, to it in one step: readers see the old or the new table.

    The version before stays until the next rebuild, as readers that began before may still read it.
    """
    old = _versions(spark, table)
    fresh = f"{table}_{time.time_ns() // 1000:016x}"
    df.write.saveAsTable(fresh)
    spark.sql(f"create or replace view {table} as select * from {fresh}")
    for name in old[:-1]:
        spark.sql(f"drop table if exists {name}")


def drop_rebuilt(spark: SparkSession, table: str) -> None:
    """Drops a rebuilt table's name and versions."""
    spark.sql(f"drop view if exists {table}")
    for name in _versions(spark, table):
        spark.sql(f"drop table if exists {name}")


def clustered(df: DataFrame, table: str, key: str, buckets: int = 8) -> None:
    """A table bucketed and sorted by a key, with statistics."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    df.sparkSession.sql(f"analyze table {table} compute statistics")
