"""Structured Streaming forms of the polling jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..session import ready_checkpoints, remove_folder

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1, schema: str = EVENTS) -> DataFrame:
    """Parquet files of a folder as a stream; offsets in the checkpoint are the high-water mark."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def held_back(stream: DataFrame, at: str = "ts", hold_off: str = "3 minutes", keep: Column | None = None) -> DataFrame:
    """Rows of a stream once the newest row is `hold_off` younger than they are; until then they are state. Rows that come later than that are left out.

    The state is a count of equal rows, which appending gives out when the watermark has passed their
    time. All rows of the stream move the watermark; keep chooses those that are held and given out. It
    names the time, so that the choice stays above the watermark.
    """
    marked = stream.withWatermark(at, hold_off)
    if keep is not None:
        marked = marked.where(F.when(F.col(at).isNotNull(), keep))
    held = marked.groupBy(at, *[c for c in stream.columns if c != at]).agg(F.count("*").alias("_copies"))
    return held.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*stream.columns)


def large_uploads(events: DataFrame, users: DataFrame, least: float, hold_off: str = "3 minutes") -> DataFrame:
    """Uploads over a size by users of a static table, each when it is older than the hold-off by the stream's time."""
    big = held_back(events, "ts", hold_off, (F.col("event_type") == "purchase") & (F.col("value") > least))
    return big.join(users, "user_id", "left_semi")


def after_recent(reports: DataFrame, hits: DataFrame, days: int = 7, delay: str = "1 hour") -> DataFrame:
    """Rows of one stream whose user has a row in another one of the last days before. Each stream has its own mark and watermark; both sides' state goes when the watermarks rule out a partner."""
    a = reports.withWatermark("ts", delay)
    b = hits.select(F.col("user_id").alias("hit_user"), F.col("ts").alias("hit_ts")).withWatermark("hit_ts", delay)
    within = (F.col("user_id") == F.col("hit_user")) & (F.col("hit_ts") <= F.col("ts")) & (F.col("hit_ts") > F.col("ts") - F.expr(f"interval {days} days"))
    return a.join(b, within, "left_semi")


def hourly_views(events: DataFrame, delay: str = "25 hours") -> DataFrame:
    """Views per page and hour."""
    v = events.where("event_type = 'view'").withWatermark("ts", delay)
    return v.groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("views")).select(F.col("w.start").alias("pc_hour"), F.col("user_id").alias("pc_page"), "views")


def daily_views(events: DataFrame, delay: str = "25 hours") -> DataFrame:
    v = events.where("event_type = 'view'").withWatermark("ts", delay)
    return v.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("views")).select(F.col("w.start").cast("date").alias("pc_date"), F.col("user_id").alias("pc_page"), "views")


def edits_within(starts: DataFrame, saves: DataFrame, hours: int = 32, how: str = "inner") -> DataFrame:
    """Stream-stream join of a user's edit starts with the saves that follow within some hours; with how="left" also starts without a save, once the watermarks rule one out."""
    a = starts.select(F.col("event_id").alias("start_id"), F.col("user_id").alias("u"), F.col("ts").alias("started")).withWatermark("started", f"{hours} hours")
    b = saves.select(F.col("event_id").alias("save_id"), "user_id", F.col("ts").alias("saved")).withWatermark("saved", f"{hours} hours")
    within = (F.col("u") == F.col("user_id")) & (F.col("saved") >= F.col("started")) & (F.col("saved") <= F.col("started") + F.expr(f"interval {hours} hours"))
    return a.join(b, within, how).select("start_id", "save_id", F.col("u").alias("user_id"))


def distinct_events(events: DataFrame, delay: str = "25 hours") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def notify_list(events: DataFrame) -> DataFrame:
    """(user_id, uploads) after each upload; a block (event error) clears the user's state."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            n = 0 if kind == "error" else n + 1
        state.update((n,)) if n else state.remove() if state.exists else None
        yield pd.DataFrame({"user_id": [key[0]], "uploads": [n]})

    few = events.where("event_type in ('purchase', 'error')").select("user_id", "ts", "event_id", "event_type")
    return few.groupBy("user_id").applyInPandasWithState(step, "user_id long, uploads long", "n long", "update", "NoTimeout")


def route(batch: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(channel, event_id): each event goes to the channels whose needle its properties hold."""
    table = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(n).alias("needle")) for c, n in rules])
    return batch.select("event_id", "props", F.explode(table).alias("r")).where(F.contains("props", F.col("r.needle"))).select(F.col("r.channel").alias("channel"), "event_id")


def sync(stream: DataFrame, target: str, key: str, at: str, checkpoint: str):
    """Keeps the last row of each key, by time, in a Parquet table: every batch writes a version v<number> beside the old ones.

    A batch starts from the newest version before its own number that was finished, so a repeated batch, and one whose
    predecessor was not needed, give the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _versions(spark, target, number)
        rows = batch.unionByName(spark.read.parquet(f"{target}/v{old[-1]}")) if old else batch
        others = [c for c in rows.columns if c != key]
        last = rows.groupBy(key).agg(F.max(F.struct(at, *[c for c in others if c != at])).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in others])
        last.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/v{number}")
        for n in old[:-1]:
            remove_folder(spark, f"{target}/v{n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str, below: int | None = None) -> list[int]:
    """Numbers of the finished versions of a synced table, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    numbers = sorted(int(f.getPath().getParent().getName()[1:]) for f in found or [])
    return [n for n in numbers if below is None or n < below]


def synced(spark: SparkSession, target: str) -> DataFrame:
    """The newest finished version of a synced table."""
    return spark.read.parquet(f"{target}/v{_versions(spark, target)[-1]}")


def sync_buckets(stream: DataFrame, target: str, key: str, at: str, checkpoint: str, buckets: int = 64, look_back: str = "25 hours"):
    """Keeps the last row of each key, by time, in a Parquet table partitioned by a hash of the key; a batch rewrites the partitions that its keys lie in, no other.

    Rows older than the look-back before the newest row of earlier batches are left out. Batches are
    marked as done by number: a repeated one, finished or not, gives the same table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("newest timestamp, number bigint").parquet(f"{target}-marks").where(F.col("number") < number) if _there(spark, f"{target}-marks") else None
        mark = marks.agg(F.max("newest")).first()[0] if marks is not None else None
        new = batch if mark is None else batch.where(F.col(at) >= F.lit(mark) - F.expr(f"interval {look_back}"))
        new = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        if touched:
            rows = new.unionByName(spark.read.schema(new.schema).parquet(target).where(F.col("bucket").isin(touched))) if _there(spark, target) else new
            others = [c for c in batch.columns if c not in (key, at)]
            last = rows.groupBy("bucket", key).agg(F.max(F.struct(at, *others)).alias("_last")).select("bucket", key, *[F.col(f"_last.{c}").alias(c) for c in (at, *others)])
            ready_checkpoints(spark)
            # The old rows are read from the partitions that are written.
            last.checkpoint().select(*batch.columns, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        batch.agg(F.max(at).cast("timestamp").alias("newest")).withColumn("number", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{target}-marks/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ----------------------------------------------------------------- staleness

LAG = "feed string, newest_micros bigint, lag_seconds bigint, warning string"


def observed(stream: DataFrame, feeds: list[str], feed: str = "event_type", at: str = "ts", name: str = "newest") -> DataFrame:
    """The stream, which reports the newest time of each feed, in microseconds, with every batch."""
    return stream.observe(name, *[F.max(F.when(F.col(feed) == f, F.unix_micros(at))).alias(f) for f in feeds])


class Staleness(StreamingQueryListener):
    """Listens to running queries whose streams are observed() and keeps the newest time of each feed.

    rows(now) tells by how much each feed is behind, with a warning from `limit` seconds on; a feed
    that has never come has a warning too. What is kept grows with the feeds only.
    """

    def __init__(self, feeds: list[str], limit: int = 300, name: str = "newest"):
        self.newest: dict[str, int | None] = dict.fromkeys(feeds)
        self.limit, self.name = limit, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.see(event.progress.observedMetrics)

    def see(self, metrics) -> None:
        """Takes in the metrics of one batch."""
        row = metrics.get(self.name)
        for feed in self.newest if row is not None else ():
            at = row[feed]
            if at is not None and (self.newest[feed] is None or at > self.newest[feed]):
                self.newest[feed] = at

    def rows(self, now: int) -> list[tuple]:
        """Rows of LAG as of a time in microseconds."""
        out = []
        for feed, at in self.newest.items():
            lag = None if at is None else (now - at) // 1_000_000
            warning = "has never come" if lag is None else f"changes of the last {lag // 60} minutes may not be shown" if lag > self.limit else None
            out.append((feed, at, lag, warning))
        return out


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its memory table; for tests and reports only."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
