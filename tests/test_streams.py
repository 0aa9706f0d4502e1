"""Streams that wait, expire, rewrite only what they touch and warn, batch by batch."""

import datetime
import os
import time

from pagegraph.streaming import feeds

BASE = datetime.datetime(2024, 1, 1)
MINUTE, HOUR, DAY = datetime.timedelta(minutes=1), datetime.timedelta(hours=1), datetime.timedelta(days=1)


def put(spark, path, rows):
    """One file of events (id, time, user, type): one micro-batch."""
    spark.createDataFrame([(i, t, u, k, 100.0, "") for i, t, u, k in rows], feeds.EVENTS).coalesce(1).write.mode("append").parquet(path)


class Runs:
    """Runs a stream over what is new, keeping its state, and gives the new rows."""

    def __init__(self, spark, make, tmp_path, name):
        self.spark, self.make, self.folder, self.seen = spark, make, f"{tmp_path}/{name}", []
        self.query = None

    def __call__(self):
        q = self.make().writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        self.query = q
        got = sorted(r[0] for r in self.spark.read.parquet(f"{self.folder}/out").collect()) if q.recentProgress else []
        new = list(got)
        for x in self.seen:
            new.remove(x)
        self.seen = got
        return new


def test_the_newest_uploads_wait(spark, tmp_path):
    path, users = f"{tmp_path}/e", spark.createDataFrame([(1,), (2,)], "user_id long")
    put(spark, path, [(1, BASE, 1, "purchase"), (2, BASE + 10 * MINUTE, 1, "purchase"), (3, BASE + 8 * MINUTE, 2, "purchase"), (4, BASE + MINUTE, 3, "purchase"), (5, BASE + MINUTE, 1, "view"), (6, BASE + 7 * MINUTE, 1, "purchase")])
    run = Runs(spark, lambda: feeds.large_uploads(feeds.event_stream(spark, path), users, 90).select("event_id"), tmp_path, "held")
    assert run() == [1, 6]  # 2 is the newest, 3 came two minutes before it, 6 exactly three; 4 is by another user, 5 no upload
    put(spark, path, [(7, BASE + 12 * MINUTE, 3, "view")])  # what is no upload moves the time as well
    assert run() == [3]
    put(spark, path, [(8, BASE + 3 * MINUTE, 1, "purchase"), (9, BASE + 30 * MINUTE, 1, "purchase"), (9, BASE + 30 * MINUTE, 1, "purchase")])
    assert run() == [2]  # 8 comes too late
    put(spark, path, [(10, BASE + 40 * MINUTE, 3, "view")])
    assert run() == [9, 9]  # equal rows stay


def test_hits_of_a_week_are_remembered_and_then_forgotten(spark, tmp_path):
    reports, hits = f"{tmp_path}/r", f"{tmp_path}/h"
    put(spark, hits, [(100 + i, BASE + i * MINUTE, i, "error") for i in range(50)])
    put(spark, reports, [(1, BASE + 6 * DAY, 3, "click"), (2, BASE + 7 * DAY + 2 * MINUTE, 2, "click"), (3, BASE + DAY, 99, "click"), (4, BASE - MINUTE, 3, "click")])
    run = Runs(spark, lambda: feeds.after_recent(feeds.event_stream(spark, reports), feeds.event_stream(spark, hits)).select("event_id"), tmp_path, "semi")
    assert run() == [1]  # 2 is a week and no less behind its hit, 3 by another user, 4 before the hit
    held = max(p.stateOperators[0].numRowsTotal for p in run.query.recentProgress)
    put(spark, reports, [(5, BASE + 6 * DAY, 7, "click"), (6, BASE + 30 * DAY, 7, "click")])
    put(spark, hits, [(200, BASE + 30 * DAY, 8, "error")])
    assert run() == [5]
    put(spark, reports, [(7, BASE + 30 * DAY + HOUR, 8, "click")])
    put(spark, hits, [(201, BASE + 30 * DAY + HOUR, 9, "error")])
    assert run() == [7]
    left = run.query.recentProgress[-1].stateOperators[0].numRowsTotal
    assert held >= 50 and left < 10


def test_a_batch_rewrites_its_partitions_only(spark, tmp_path):
    path, target = f"{tmp_path}/e", f"{tmp_path}/table"

    def sync():
        rows = feeds.event_stream(spark, path).select("user_id", "ts", "event_id")
        feeds.sync_buckets(rows, target, "user_id", "ts", f"{tmp_path}/state", buckets=16).awaitTermination()
        return {(r.user_id, r.event_id) for r in spark.read.parquet(target).collect()}

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(target) for f in names if f.endswith(".parquet")}

    put(spark, path, [(i, BASE + i * MINUTE, i, "view") for i in range(100)])
    assert sync() == {(i, i) for i in range(100)}
    before = files()
    put(spark, path, [(500, BASE + 300 * MINUTE, 7, "view"), (501, BASE + 2 * MINUTE, 8, "view"), (502, BASE - 23 * HOUR, 1000, "view"), (503, BASE - 30 * HOUR, 2000, "view")])
    want = {(i, i) for i in range(100) if i != 7} | {(7, 500), (1000, 502)}  # 501 is older than what is there, 503 older than the look-back
    assert sync() == want
    after = files()
    kept = {f for f in before if after.get(f) == before[f]}
    assert len(before) == 16 and 16 - 4 <= len(kept) < 16
    assert sync() == want and files() == after  # nothing new


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The checkpoint is lost after the table was written, so the batch comes again by its number."""
    path, target = f"{tmp_path}/e", f"{tmp_path}/table"
    put(spark, path, [(i, BASE + i * HOUR, i % 5, "view") for i in range(60)])
    for state in ("a", "b"):
        rows = feeds.event_stream(spark, path).select("user_id", "ts", "event_id")
        feeds.sync_buckets(rows, target, "user_id", "ts", f"{tmp_path}/{state}", buckets=4).awaitTermination()
        assert {(r.user_id, r.event_id) for r in spark.read.parquet(target).collect()} == {(i % 5, i) for i in range(55, 60)}


def test_a_stream_that_falls_behind_is_reported(spark, tmp_path):
    path = f"{tmp_path}/e"
    put(spark, path, [(1, BASE, 1, "view"), (2, BASE + HOUR, 1, "click")])
    listener = feeds.Staleness(["view", "click", "error"])
    spark.streams.addListener(listener)
    q = feeds.observed(feeds.event_stream(spark, path), ["view", "click", "error"]).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").start()

    def micros(t):
        return int((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)

    def until(feed, at):
        end = time.time() + 60
        while time.time() < end and listener.newest[feed] != micros(at):
            time.sleep(0.2)
        assert listener.newest[feed] == micros(at)

    try:
        until("click", BASE + HOUR)
        now = micros(BASE + HOUR + 2 * MINUTE)
        assert listener.rows(now) == [("view", micros(BASE), 3720, "changes of the last 62 minutes may not be shown"), ("click", micros(BASE + HOUR), 120, None), ("error", None, None, "has never come")]
        put(spark, path, [(3, BASE + HOUR, 1, "view"), (4, BASE, 1, "click")])  # it catches up; an older row moves nothing back
        until("view", BASE + HOUR)
        assert [r[3] for r in listener.rows(now)] == [None, None, "has never come"]
        assert spark.createDataFrame(listener.rows(now), feeds.LAG).count() == 3
    finally:
        q.stop()
        spark.streams.removeListener(listener)


def test_no_events_no_rows(spark, tmp_path):
    path = f"{tmp_path}/e"
    spark.createDataFrame([], feeds.EVENTS).write.parquet(path)
    users = spark.createDataFrame([(1,)], "user_id long")
    q = feeds.large_uploads(feeds.event_stream(spark, path), users, 90)
    assert feeds.run_to_end(q, "none_held").count() == 0
