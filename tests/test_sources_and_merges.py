"""Readers, sinks, merges, spatial and streaming operators on small fixtures."""

import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from pagegraph.operators import aggregates as A
from pagegraph.operators import intervals as I
from pagegraph.operators import links
from pagegraph.operators import merge as K
from pagegraph.operators import spatial as S
from pagegraph.sources import readers as R
from pagegraph.sources import sinks as W
from pagegraph.streaming import feeds


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", None), (2, None, 1.5)], "k long, t string, x double")
    W.write_tsv(df, f"{tmp_path}/t")
    back = R.read_tsv(spark, f"{tmp_path}/t", "k long, t string, x double", sets={"y": "k * 2"})
    assert sorted(map(tuple, back.collect())) == [(1, "a b", None, 2), (2, None, 1.5, 4)]


def test_pagecounts(spark, tmp_path):
    with gzip.open(tmp_path / "p.gz", "wt") as f:
        f.write("en Foo 3 100\nen Bar x 1\nbroken\nde Foo 1 50\n")
    rows, bad = R.read_pagecounts(spark, f"{tmp_path}/p.gz")
    assert rows.count() == 2 and bad.count() == 2
    ids = spark.createDataFrame([("Foo", 7)], "title string, page_id long")
    assert {r.page_id for r in R.pagecounts_with_ids(rows, ids).collect()} == {7}


def test_xml_and_logs(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><text>x [[B]]</text></revision></page><page><title>C</title><ns>1</ns><id>2</id><revision><text>y</text></revision></page></mediawiki>")
    assert [r.title for r in R.read_xml_dump(spark, f"{tmp_path}/d.xml", F.col("ns") == 0).collect()] == ["A"]
    (tmp_path / "l.log").write_text("10:00 bob saved Foo\nnoise\n10:05 ann saved Bar\n")
    log = R.read_log(spark, f"{tmp_path}/l.log", r"^(\d\d:\d\d) (\w+) saved (\w+)$", ["at", "who", "title"])
    assert sorted(map(tuple, log.collect())) == [("10:00", "bob", "Foo"), ("10:05", "ann", "Bar")]
    assert R.first_file_with(spark, f"{tmp_path}/*.log", "saved").first().file.endswith("l.log")


def test_selectors(spark):
    pages = spark.createDataFrame([(1, "A"), (2, "B"), (3, "AB")], "page_id long, page_title string")
    links = spark.createDataFrame([(1, 2), (3, 2)], "pl_from long, pl_to long")
    assert {r.page_id for r in R.select_pages("backlinks", pages, links, 2).collect()} == {1, 3}
    assert {r.page_id for r in R.select_pages("prefixindex", pages, "A").collect()} == {1, 3}
    assert {r.page_id for r in R.combined(R.titles(pages, ["A"]), R.links_of(pages, links, 1), R.titles(pages, ["A"])).collect()} == {1, 2}
    assert R.random_pages(pages, 2, 5).collect() == R.random_pages(pages, 2, 5).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "k long, t string")
    assert W.as_json(df, callback="f").first().json == 'f({"k":1,"t":"x"})'
    assert "<t>x</t>" in W.as_xml(df).first().xml
    assert "<caption>C</caption>" in W.html_table(df, "C")
    W.write_json(df.withColumn("h", F.array(F.struct(F.lit(1).alias("a")))), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().h[0].a == 1


def test_table_swap_and_buckets(spark):
    try:
        for n in (3, 5, 7):
            reader = spark.table("swap_test") if n > 3 else None
            W.rebuild(spark, spark.range(n), "swap_test")
            assert spark.table("swap_test").count() == n
            assert reader is None or reader.count() == n - 2  # who began before still reads the version before
        names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith("swap_test"))
        assert len(names) == 3 and names[0] == "swap_test"  # the name and the two newest versions
        W.clustered(spark.range(20).withColumnRenamed("id", "k"), "bucket_test", "k", 2)
        plan = spark.table("bucket_test").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        W.drop_rebuilt(spark, "swap_test")
        spark.sql("drop table if exists bucket_test")
        assert not [t for t in spark.catalog.listTables() if t.name.startswith(("swap_test", "bucket_test"))]


def test_first_k_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([(g, x) for g in "ab" for x in range(50)], "g string, x long")
    top = A.first_k(df, ["g"], [F.desc("x")], 2)
    assert sorted((r.g, r.x, r.place) for r in top.collect()) == [("a", 48, 2), ("a", 49, 1), ("b", 48, 2), ("b", 49, 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_merges(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (1, 3, "c", None), (2, 1, None, None)], "k long, seq long, v string, w string")
    got = {r.k: (r.v, r.w) for r in K.upsert_last_non_null(rows, ["k"], "seq", ["v", "w"]).collect()}
    assert got == {1: ("c", "x"), 2: (None, None)}
    assert {(r.k, r.v) for r in K.insert_ignore(rows, ["k"], "seq").collect()} == {(1, "a"), (2, None)}
    fresh = rows.where("k = 1 and seq = 3").withColumn("v", F.lit("new"))
    assert sorted((r.k, r.v or "") for r in K.replace_changed(rows, fresh, fresh, "k").collect()) == [(1, "new"), (2, "")]
    assert {r.v for r in K.update_case(rows, "seq", "v", {2: "two"}).collect()} == {"a", "two", "c", None}


def test_medians_and_runs(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 3, 3)] + [("b", None)], "g string, v long")
    assert {r.g: r.median for r in A.upper_median(df, ["g"], "v").collect()} == {"a": 3}
    assert {r.g: r["mode"] for r in A.mode_with_ties(df, ["g"], "v").collect()} == {"a": 3}
    runs = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, None)], "t long, v string").withColumn("g", F.lit(1))
    assert [r.run for r in sorted(A.breaks(runs, ["g"], ["t"], F.col("v")).collect(), key=lambda r: r.t)] == [1, 1, 2, 3]


def test_intervals(spark):
    t = datetime.datetime(2024, 1, 1)
    hour = datetime.timedelta(hours=1)
    a = spark.createDataFrame([(1, "u", t), (2, "v", t)], "a long, k string, s timestamp")
    b = spark.createDataFrame([(1, "u", t + 32 * hour), (2, "u", t + 33 * hour), (3, "u", t - hour), (4, "u", t)], "b long, k string, e timestamp")
    assert {r.b for r in I.interval_join(a, b, ["k"], "s", "e", 32).collect()} == {1, 4}
    assert {(r.a, r.b) for r in I.interval_join(a, b, ["k"], "s", "e", 32, "left").collect()} == {(1, 1), (1, 4), (2, None)}
    rows = a.select(F.col("a").alias("row_id"), "k", "s")
    near = {r.row_id: r.nearest for r in I.nearest_in_time(rows, b.select("k", "e").where("b <> 4"), "k", "s", "e", 21, 2).collect()}
    assert near == {1: t - hour, 2: None}


def test_polygons(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0)]
    polygons = spark.createDataFrame([("bent", [(x, y) for x, y in ring])], "region string, area array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 2.0, 5.0), (2, 9.0, 5.0), (3, 12.0, 10.0), (4, 60.0, 60.0)], "gc_from long, gc_lat double, gc_lon double")
    assert {r.gc_from for r in S.containing_regions(points, polygons).collect()} == {1}
    near = {r.gc_from: r.distance for r in S.nearest_region(points, polygons).collect()}
    assert near[1] == 0 and near[3] == 2 and 4 not in near and 0 < near[2] < 5


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=i), i % 2, k, float(i), f'{{"k": {i}}}') for i, k in enumerate(["purchase", "purchase", "error", "purchase", "view", "purchase"])]
    spark.createDataFrame(rows, feeds.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = feeds.event_stream(spark, f"{tmp_path}/e")
    got = {r.user_id: r.uploads for r in feeds.run_to_end(feeds.notify_list(stream), "notify", "update").collect()}
    assert got == {0: 0, 1: 3}
    routed = feeds.route(spark.createDataFrame(rows, feeds.EVENTS), [("low", '"k": 1'), ("all", "k")])
    assert routed.where("channel = 'low'").count() == 1 and routed.where("channel = 'all'").count() == 6
    changes = stream.select("user_id", "ts", "event_id")
    feeds.sync(changes, f"{tmp_path}/out", "user_id", "ts", f"{tmp_path}/c").awaitTermination()
    assert {tuple(r) for r in feeds.synced(spark, f"{tmp_path}/out").select("user_id", "event_id").collect()} == {(0, 4), (1, 5)}
    later = [(9, base + datetime.timedelta(hours=1), 1, "view", 9.0, ""), (8, base + datetime.timedelta(seconds=1), 0, "view", 8.0, ""), (7, base, 2, "view", 7.0, "")]
    for row in later:  # one batch each; an older row does not replace a newer one
        spark.createDataFrame([row], feeds.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        feeds.sync(changes, f"{tmp_path}/out", "user_id", "ts", f"{tmp_path}/c").awaitTermination()
    assert {tuple(r) for r in feeds.synced(spark, f"{tmp_path}/out").select("user_id", "event_id").collect()} == {(0, 4), (1, 9), (2, 7)}


def test_stream_left_join(spark, tmp_path):
    """A start without a save comes out once later events have moved the watermarks past its 32 hours."""
    base, hour = datetime.datetime(2024, 1, 1), datetime.timedelta(hours=1)
    rows = [(1, base, 7, "signup", 0.0, ""), (2, base + 31 * hour, 7, "purchase", 0.0, ""), (3, base, 8, "signup", 0.0, ""), (4, base + 33 * hour, 8, "purchase", 0.0, ""), (5, base + 400 * hour, 9, "signup", 0.0, ""), (6, base + 400 * hour, 9, "purchase", 0.0, "")]
    spark.createDataFrame(rows, feeds.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/e")
    e = feeds.event_stream(spark, f"{tmp_path}/e")
    joined = feeds.edits_within(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), how="left")
    got = {tuple(r) for r in feeds.run_to_end(joined, "left_edits").collect()}
    assert got == {(1, 2, 7), (3, None, 8), (5, 6, 9)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["norm", "dab_pages", "missing_cnt", "missing"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_redirect_ends(spark):
    """Long chains end where they end; loops, and what leads into them, end nowhere."""
    rows = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 200), (400, 400), (500, 501)]
    got = {r.rd_from: (r.final, r.hops) for r in links.redirect_ends(spark.createDataFrame(rows, "rd_from long, rd_to long")).collect()}
    assert got == {i: (100, 100 - i) for i in range(100)} | dict.fromkeys([200, 201, 202, 300, 400], (None, None)) | {500: (501, 1)}
    assert links.redirect_ends(spark.createDataFrame([], "rd_from long, rd_to long")).count() == 0


def test_cocitation(spark):
    rows = [(p, t) for p in range(9) for t in range(5) if (p * t) % 3 != 1]
    pages = spark.createDataFrame(rows, "pl_from long, pl_to long")
    got = {(r.a, r.b): r.n for r in links.cocitation(pages, spark.createDataFrame([(t,) for t in range(4)], "target long")).collect()}
    citing = {t: {p for p, x in rows if x == t} for t in range(4)}
    assert got == {(a, b): len(citing[a] & citing[b]) for a in citing for b in citing if a != b and citing[a] & citing[b]}
    assert links.cocited(pages, 0, 3).first().n == len(citing[0] & citing[3])


def test_checkpoint_folder_must_be_shared(spark, monkeypatch):
    from types import SimpleNamespace

    from pagegraph.session import ready_checkpoints

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]"), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        ready_checkpoints(cluster)


def test_stale_orphaned_and_missing_tables(spark, tmp_path):
    import os

    for name, n in (("a", 3), ("b", 0), ("c", 5)):
        spark.range(n).write.parquet(f"{tmp_path}/all/{name}")
    for d, _, files in os.walk(f"{tmp_path}/all/c"):
        for f in files:
            os.utime(os.path.join(d, f), (1_700_000_000, 1_700_000_000))
    stored = R.stored_tables(spark, f"{tmp_path}/all")
    registry = spark.createDataFrame([("a", "ann", 1), ("gone", "bob", 2)], "name string, owner string, files int")
    got = {r.name: r for r in R.table_report(stored, registry).collect()}
    assert {k: (r.owner, r.stale, r.orphan, r.missing) for k, r in got.items()} == {"a": ("ann", False, False, False), "b": (None, False, True, False), "c": (None, True, True, False), "gone": ("bob", False, False, True)}
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{tmp_path}/all/a") for f in files if f.startswith("part-"))
    assert got["a"].bytes == size and got["a"].age_days == 0 and got["gone"].bytes == 0 and got["gone"].age_days is None
    later = R.table_report(stored, registry, F.current_timestamp() + F.expr("interval 31 days")).where("stale").select("name").collect()
    assert {r.name for r in later} == {"a", "b", "c"}
    os.makedirs(f"{tmp_path}/none/x")
    assert R.stored_tables(spark, f"{tmp_path}/none").count() == 0
