"""Fill-in-middle transformation with relational units.

A text is a row of units (a word with the white space before it, or white space
at the end). Two cuts at whole units make prefix, middle and suffix, which are put
together anew around sentinels. Where a cut lies in the text is found by joins and
windows, at two levels so that few rows are sorted: posexplode gives a text's
blocks of whole units (about `block` code points) with the lengths of their units;
window sums give the units and code points before each block; cut requests meet
the block that holds their unit; its units are exploded, window sums of their
lengths give the end of each, and requests meet the unit of their ordinal. Offsets
are gathered per document and join its text, which substring then cuts. Texts
cross one exchange, and only those that are cut.

Cuts and form come from the sha256 of the seed and the id, so a rerun gives the
same result. Documents meet their offsets by a digest of id and text: repeated
rows share one computation and each row stays.

Only built-in functions run: no Python workers.

Defined results: a null text is empty, a null id counts as an empty string in the
hash; a text that is empty or holds a sentinel stays plain; an empty table gives no
rows; other columns are ignored. A word or white space of any length is one unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ready_checkpoints

#: Sentinels of prefix, suffix and middle; white space; a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANK, _INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
UNIT = rf"{_BLANK}*{_INK}+|{_BLANK}+"


def group(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def assembled(form: Column, text: Column, prefix: Column, middle: Column) -> Column:
    """The output from a text, its form and the lengths of prefix and middle in code points."""
    a, b, c = F.substring(text, F.lit(1), prefix), F.substring(text, prefix + 1, middle), F.substring(text, prefix + middle + 1, F.length(text))
    psm, spm = F.concat(F.lit(PREFIX), a, F.lit(SUFFIX), c, F.lit(MIDDLE), b), F.concat(F.lit(SUFFIX), c, F.lit(PREFIX), a, F.lit(MIDDLE), b)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(form: Column, output: Column) -> Column:
    """The text that an output of that form stands for. Sentinels occur nowhere else, as texts that hold one stay plain."""
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    rest = F.substring(output, F.lit(4), F.length(output))
    at, until = F.locate(SUFFIX, rest), F.locate(MIDDLE, rest)
    at = F.when(form == "psm", at).otherwise(F.locate(PREFIX, rest))
    first, then = F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + F.length(second), until - at - F.length(second))
    middle = F.substring(rest, until + len(MIDDLE), F.length(rest))
    return F.when(form == "psm", F.concat(first, middle, then)).when(form == "spm", F.concat(then, middle, first)).otherwise(output)


def planned(docs: DataFrame, id_col: str, text_col: str, seed: int, share: int, spm_share: int) -> DataFrame:
    """(id, text, n, form, low, high): low and high are the units before the first and the second cut."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    few = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(s))
    plain = (F.col("text") == "") | held | (group(F.col("h"), 2) % 100 >= share)
    form = F.when(plain, "plain").when(group(F.col("h"), 3) % 100 < spm_share, "spm").otherwise("psm")
    one, two = (group(F.col("h"), k) % (F.col("n") + 1) for k in (0, 1))
    sized = few.withColumn("h", digest).withColumn("form", form).withColumn("n", F.size(units(F.col("text"))).cast("bigint"))
    return sized.select("id", "text", "n", "form", F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))


def keyed(cut: DataFrame) -> DataFrame:
    """With a key: 128 bits of the sha256 of id and text."""
    return cut.withColumn("key", F.substring(F.unhex(F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256)), 1, 16))


def cut_offsets(cut: DataFrame, block: int) -> DataFrame:
    """(key, prefix, until): code points before the first and the second cut. cut: (key, text, low, high)."""
    parts = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{block}}}{_BLANK}*{_INK}*"), F.lit(0))
    blocks = cut.select("key", F.posexplode(parts).alias("place", "part"))
    lengths = F.transform(units(F.col("part")), F.length)
    # A byte a unit wherever that is enough, as these arrays cross two exchanges.
    small = F.array_max("lengths") <= 127
    blocks = blocks.select("key", "place", lengths.alias("lengths")).select("key", "place", F.when(small, F.col("lengths").cast("array<tinyint>")).alias("short"), F.when(~small, F.col("lengths")).alias("long")).distinct()
    blocks = blocks.withColumn("lengths", F.coalesce(F.col("short").cast("array<int>"), "long"))
    earlier = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    begins = blocks.withColumn("chars", total).withColumn("units", F.size("lengths").cast("bigint")).select("key", "short", "long", "units", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(c) for c, v in (("units_before", F.col("units")), ("chars_before", F.col("chars")))])
    # A cut stands behind the unit of its ordinal; before the first unit there is nothing to look for.
    requests = cut.select("key", F.explode(F.array_distinct(F.array("low", "high"))).alias("ordinal")).where("ordinal > 0").distinct()
    here = (F.col("ordinal") > F.col("units_before")) & (F.col("ordinal") <= F.col("units_before") + F.col("units"))
    wanted = begins.join(requests.withColumnRenamed("key", "of"), (F.col("key") == F.col("of")) & here).select("key", "ordinal", "units_before", "chars_before", F.posexplode(F.coalesce(F.col("short").cast("array<int>"), "long")).alias("place", "length"))
    upto = Window.partitionBy("key", "ordinal").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = wanted.withColumn("end", F.col("chars_before") + F.sum("length").over(upto)).where("units_before + place + 1 = ordinal")
    return ends.groupBy("key").agg(F.min("end").alias("first"), F.max("end").alias("last"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, share: int = 50, spm_share: int = 80, block: int = 256) -> DataFrame:
    """One row per document: id, n (units), form, prefix_chars, middle_chars, text, output."""
    ready_checkpoints(docs.sparkSession)
    every = planned(docs, id_col, text_col, seed, share, spm_share)
    cut = keyed(every.where("form <> 'plain'"))
    offsets = cut_offsets(cut, block).checkpoint()  # one small row a document
    none = F.lit(0).cast("bigint")
    # One cut only has an end of a unit where the other one is at the start.
    prefix, until = F.when(F.col("low") == 0, none).otherwise(F.col("first")), F.when(F.col("high") == 0, none).otherwise(F.col("last"))
    placed = cut.join(offsets.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left").select("id", "text", "n", "form", prefix.alias("prefix_chars"), (until - prefix).alias("middle_chars"))
    null = F.lit(None).cast("bigint")
    rest = every.where("form = 'plain'").select("id", "text", "n", "form", null.alias("prefix_chars"), null.alias("middle_chars"))
    output = assembled(F.col("form"), F.col("text"), F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int"))
    return placed.unionByName(rest).withColumn("output", output).withColumnRenamed("id", id_col)
