"""Streams over the events table, run to their end and read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ready_checkpoints, remove_folder, table, taken
from ..streaming import feeds as S
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


def _source(spark, d):
    """The events table as a stream: its folder, or the folder that holds its file."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(spark, stream, mode="append"):
    """Runs a stream into Parquet in the shared folder and reads that."""
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    if mode == "complete":  # each batch has the whole result; the last one counts
        done = []

        def put(batch, number):
            batch.write.mode("overwrite").parquet(f"{folder}/out-{number}")
            done.append(number)

        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return taken(spark.read.schema(stream.schema).parquet(f"{folder}/out-{max(done)}") if done else spark.createDataFrame([], stream.schema), folder)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return taken(spark.read.schema(stream.schema).parquet(f"{folder}/out"), folder)


@query("""select event_id, user_id, value from events where event_type = 'purchase' and value > 90 and user_id in (select user_id from events where event_type = 'signup') and ts <= (select date_trunc('millisecond', max(ts)) - interval 3 minute from events)""")
def stream_uploads(spark, d):
    """Large uploads as a stream, held back for three minutes of its time, with a stream-static semi-join."""
    users = table(spark, d, "events").where("event_type = 'signup'").select("user_id").distinct()
    return _finish(spark, S.large_uploads(_source(spark, d).select("event_id", "user_id", "event_type", "value", "ts"), users, 90).select("event_id", "user_id", "value"))


@query("""select event_id, user_id, props from events a where event_type <> 'view' and ts <= (select date_trunc('millisecond', max(ts)) - interval 2 day from events)""")
def stream_held_back(spark, d):
    """All changes but the newest two days', which wait."""
    return _finish(spark, S.held_back(_source(spark, d), "ts", "2 days", F.col("event_type") != "view").select("event_id", "user_id", "props"))


@query("""select event_id, user_id from events a where event_type = 'click' and exists (select * from events b where b.event_type = 'error' and b.user_id = a.user_id and b.ts <= a.ts and b.ts > a.ts - interval 7 day)""")
def stream_after_hits(spark, d):
    """Reports by users whom a filter hit in the week before, as two streams."""
    e = _source(spark, d)
    return _finish(spark, S.after_recent(e.where("event_type = 'click'"), e.where("event_type = 'error'")).select("event_id", "user_id"))


FEEDS = ["click", "error", "purchase", "signup", "view"]


@query("""with n as (select max(ts) as now from events), f as (select event_type as feed, max(ts) as newest from events where event_type in ('click', 'error', 'purchase', 'signup', 'view') group by 1),
l as (select feed, newest, cast(floor(epoch(now - newest)) as bigint) as lag_seconds from f, n)
select feed, newest, lag_seconds, case when lag_seconds > 300 then 'changes of the last ' || lag_seconds // 60 || ' minutes may not be shown' end as warning from l""")
def stream_staleness(spark, d):
    """How far each kind of event in a running stream is behind the newest event, and what to warn of."""
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    q = S.observed(_source(spark, d), FEEDS).writeStream.format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    lag = S.Staleness(FEEDS)
    for p in q.recentProgress:
        lag.see(p.observedMetrics)
    remove_folder(spark, folder)
    seen = [at for at in lag.newest.values() if at is not None]
    rows = spark.createDataFrame(lag.rows(max(seen)) if seen else [], S.LAG).where("newest_micros is not null")
    return rows.select("feed", F.timestamp_micros("newest_micros").cast("timestamp_ntz").alias("newest"), "lag_seconds", "warning")


@query("select distinct event_id, event_type from events")
def stream_distinct(spark, d):
    """Each event once within the watermark."""
    return _finish(spark, S.distinct_events(_source(spark, d)).select("event_id", "event_type"))


@query("""select a.event_id as start_id, b.event_id as save_id, a.user_id from events a join events b on a.user_id = b.user_id and a.event_type = 'signup' and b.event_type = 'purchase' and b.ts between a.ts and a.ts + interval 32 hour""")
def stream_interval_join(spark, d):
    """Edit starts and saves joined as two streams."""
    e = _source(spark, d)
    return _finish(spark, S.edits_within(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'")))


@query("""with a as (select event_id, user_id, ts from events where event_type = 'signup'), b as (select event_id, user_id, ts from events where event_type = 'purchase'),
m as (select date_trunc('millisecond', least((select max(ts) from a), (select max(ts) from b))) - interval 32 hour as mark),
j as (select a.event_id as start_id, b.event_id as save_id, a.user_id, a.ts from a left join b on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 32 hour)
select start_id, save_id, user_id from j, m where save_id is not null or ts < mark - interval 32 hour""")
def stream_interval_left(spark, d):
    """Edit starts with saves within 32 hours, and, once the watermarks of both streams have passed these hours, the starts without."""
    e = _source(spark, d)
    return _finish(spark, S.edits_within(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), how="left"))


@query("select date_trunc('hour', ts) as pc_hour, user_id as pc_page, cast(count(*) as bigint) as views from events where event_type = 'view' group by all")
def stream_hourly_views(spark, d):
    """Hourly totals of all that has come, the newest hours too."""
    return _finish(spark, S.hourly_views(_source(spark, d)), "complete").withColumn("pc_hour", F.to_timestamp_ntz(F.date_format("pc_hour", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")))


@query("select cast(ts as date) as pc_date, user_id as pc_page, cast(count(*) as bigint) as views from events where event_type = 'view' group by all")
def stream_daily_views(spark, d):
    return _finish(spark, S.daily_views(_source(spark, d)), "complete")


@query("""with c as (select *, sum(cast(event_type = 'error' as int)) over (partition by user_id order by ts, event_id) as blocks from events where event_type in ('purchase', 'error')),
n as (select user_id, blocks, count(*) filter (event_type = 'purchase') as n from c group by user_id, blocks) select user_id, cast(max_by(n, blocks) as bigint) as uploads from n group by user_id""")
def stream_notify_list(spark, d):
    """What the keyed state holds in the end: each user's uploads since the last block."""
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def put(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    S.notify_list(_source(spark, d)).writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("user_id long, uploads long, batch int").parquet(f"{folder}/out/*")
    return taken(out.groupBy("user_id").agg(F.max_by("uploads", "batch").alias("uploads")), folder)


@query("""select c as channel, event_id from events, (values ('evens', '2}'), ('sixes', '6'), ('all', '{')) as r(c, needle) where contains(props, needle)""")
def stream_routes(spark, d):
    """Events to the channels whose needle their properties hold."""
    return _finish(spark, S.route(_source(spark, d), [("evens", "2}"), ("sixes", "6"), ("all", "{")]))


@query("""select user_id, max_by(event_id, ts) as event_id, max_by(value, ts) as value from events group by user_id""")
def stream_sync(spark, d):
    """A table kept in step with a stream: the last row of each key."""
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    rows = _source(spark, d).select("user_id", "ts", "event_id", "value")
    S.sync_buckets(rows, f"{folder}/table", "user_id", "ts", f"{folder}/state").awaitTermination()
    return taken(spark.read.schema("user_id bigint, event_id bigint, value double").parquet(f"{folder}/table").drop("bucket"), folder)
