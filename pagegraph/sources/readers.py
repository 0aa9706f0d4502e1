"""Readers for the file formats of the data model, and page selectors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sinks import ESCAPES


def tsv_value(field: Column) -> Column:
    """What a field stands for: null for \\N; a letter behind a backslash is its byte, any other character itself."""
    pieces = F.split(field, r"\\\\")  # at escaped backslashes, from the left, so that every backslash left begins an escape

    def piece(p):
        for raw, letter in ESCAPES.items():
            if raw != "\\":
                p = F.replace(p, F.lit(f"\\{letter}"), F.lit(raw))
        return F.regexp_replace(p, r"(?s)\\(.)", "$1")

    return F.when(field != "\\N", F.array_join(F.transform(pieces, piece), "\\"))


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False, sets: dict[str, str] | None = None) -> DataFrame:
    """Tab-separated lines with \\N for null and backslash escapes, cast to the schema; a missing or malformed field is null, further fields are left out. sets: columns computed by SQL expressions."""
    fields = StructType.fromDDL(schema).fields
    lines = spark.read.option("lineSep", "\n").text(path)
    if header:
        lines = lines.where(F.col("value") != "\t".join(f.name for f in fields))
    parts = lines.select(F.split("value", "\t", -1).alias("f"))
    df = parts.select(*[tsv_value(F.get("f", F.lit(i))).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
    for name, expression in (sets or {}).items():
        df = df.withColumn(name, F.expr(expression))
    return df


def read_pagecounts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of page-count logs with four fields, gzipped or not."""
    lines = spark.read.text(path).withColumn("f", F.split("value", " "))
    ok = (F.size("f") == 4) & F.col("f")[2].rlike(r"^\d+$") & F.col("f")[3].rlike(r"^\d+$")
    rows = lines.where(ok).select(F.col("f")[0].alias("project"), F.col("f")[1].alias("title"), F.col("f")[2].cast("long").alias("views"), F.col("f")[3].cast("long").alias("bytes"))
    return rows, lines.where(~ok).select("value")


def pagecounts_with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Counts with page ids from a dictionary (title, page_id); the planner broadcasts it where it is small."""
    return rows.join(ids, "title", "left")


def read_xml_dump(spark: SparkSession, path: str, keep=None) -> DataFrame:
    """(title, ns, page_id, text) of the pages of an XML dump, filtered while scanning."""
    kind = "title string, ns int, id long, revision struct<text: string>"
    df = spark.read.format("xml").option("rowTag", "page").schema(kind).load(path)
    out = df.select("title", "ns", F.col("id").alias("page_id"), F.col("revision.text").alias("text"))
    return out if keep is None else out.where(keep)


def read_log(spark: SparkSession, path: str, pattern: str, fields: list[str]) -> DataFrame:
    """Named fields, in order of the pattern's groups, of lines that match."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(f) for i, f in enumerate(fields)])


def read_link_cache(spark: SparkSession, path: str) -> DataFrame:
    names = "url refId context status reason redirect junk1 junk2 rank comment".split()
    return read_tsv(spark, path, ", ".join(f"{n} string" for n in names))


def first_file_with(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """The first file, by name, with a line that holds the needle."""
    return spark.read.text(path).where(F.contains("value", F.lit(needle))).agg(F.min("_metadata.file_path").alias("file"))


def read_results_xml(spark: SparkSession, path: str) -> DataFrame:
    """Archive results: status, id, timestamp, original and archived URL of each result element."""
    return spark.read.format("xml").option("rowTag", "result").schema("status string, webcite_id string, timestamp string, original_url string, webcite_url string").load(path)


def archive_copies(listing: DataFrame, html: str = "html") -> DataFrame:
    """Timestamps of archived copies in a listing page."""
    return listing.select("*", F.explode(F.regexp_extract_all(F.col(html), F.lit(r"/web/(\d{14,15})/"), 1)).alias("stamp"))


def rules(spark: SparkSession, text: str) -> DataFrame:
    """(name, pattern) rules of lines `name: pattern`."""
    rows = [tuple(x.strip() for x in line.split(":", 1)) for line in text.splitlines() if ":" in line]
    return spark.createDataFrame(rows, "name string, pattern string")


def freshness(df: DataFrame, at: str, now: str) -> DataFrame:
    """The newest row and its age in seconds at a given time."""
    return df.agg(F.max(at).alias("newest")).select("newest", (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("newest")).alias("lag_s"))


def file_age(spark: SparkSession, path: str) -> DataFrame:
    """Files of a table and when they were last changed."""
    return spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_modification_time").distinct()


def stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(name, files, bytes, modified): tables that lie in a folder, each a folder of files, from what the file system says of them; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).select("path", "modificationTime", "length")
    name = F.regexp_extract("path", rf"/{re.escape(folder.rstrip('/').rsplit('/', 1)[-1])}/([^/]+)/", 1)
    return files.withColumn("name", name).where("name <> ''").groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def table_report(stored: DataFrame, registry: DataFrame, now: Column | None = None, days: int = 30) -> DataFrame:
    """(name, owner, files, bytes, modified, age_days, stale, orphan, missing): stored tables beside the registry (name, owner).

    Stale is what has not changed for so many days; an orphan has files but no owner; missing is what
    is registered and has no files. A name that is registered for several owners has a row for each.
    """
    both = stored.join(registry.select("name", "owner"), "name", "full")
    age = F.timestamp_diff("DAY", F.col("modified"), F.current_timestamp() if now is None else now)
    out = both.select("name", "owner", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "modified", age.alias("age_days"))
    missing = F.col("files") == 0
    return out.withColumns({"stale": F.coalesce(F.col("age_days") >= days, F.lit(False)), "orphan": ~missing & F.col("owner").isNull(), "missing": missing})


SELECTORS: dict[str, Callable[..., DataFrame]] = {}


def selector(f):
    SELECTORS[f.__name__] = f
    return f


@selector
def titles(pages: DataFrame, wanted: list[str]) -> DataFrame:
    return pages.join(pages.sparkSession.createDataFrame([(t,) for t in wanted], "page_title string"), "page_title", "left_semi")


@selector
def category(pages: DataFrame, categorylinks: DataFrame, name: str) -> DataFrame:
    return pages.join(categorylinks.where(F.col("cl_to") == name).select(F.col("cl_from").alias("page_id")), "page_id", "left_semi")


@selector
def backlinks(pages: DataFrame, links: DataFrame, target: int) -> DataFrame:
    return pages.join(links.where(F.col("pl_to") == target).select(F.col("pl_from").alias("page_id")), "page_id", "left_semi")


@selector
def links_of(pages: DataFrame, links: DataFrame, source: int) -> DataFrame:
    return pages.join(links.where(F.col("pl_from") == source).select(F.col("pl_to").alias("page_id")), "page_id", "left_semi")


@selector
def embeddedin(pages: DataFrame, templatelinks: DataFrame, template: str) -> DataFrame:
    return pages.join(templatelinks.where(F.col("tl_title") == template).select(F.col("tl_from").alias("page_id")), "page_id", "left_semi")


@selector
def prefixindex(pages: DataFrame, prefix: str) -> DataFrame:
    return pages.where(F.col("page_title").startswith(prefix))


@selector
def newest(pages: DataFrame, n: int) -> DataFrame:
    return pages.orderBy(F.desc("page_id")).limit(n)


@selector
def random_pages(pages: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return pages.orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(n)


@selector
def weblink(pages: DataFrame, externallinks: DataFrame, pattern: str) -> DataFrame:
    return pages.join(externallinks.where(F.col("el_to").like(pattern)).select(F.col("el_from").alias("page_id")), "page_id", "left_semi")


@selector
def contribs(pages: DataFrame, revisions: DataFrame, user: int) -> DataFrame:
    return pages.join(revisions.where(F.col("rev_user") == user).select(F.col("rev_page").alias("page_id")), "page_id", "left_semi")


@selector
def from_file(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    """Pages named by [[links]] in a text file."""
    named = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"\[\[([^\]|]+)"), 1)).alias("page_title"))
    return pages.join(named, "page_title", "left_semi")


def select_pages(kind: str, *args, **kw) -> DataFrame:
    """Page sets by name, such as category, backlinks or prefixindex."""
    return SELECTORS[kind](*args, **kw)


def combined(*sets: DataFrame) -> DataFrame:
    """All page sets in one, each page once."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["page_id"])
