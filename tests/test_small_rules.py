"""DOIs, titles that may not be, and files larger than their pixels need."""

import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from pagegraph import catalog
from pagegraph.functions import text, titles
from pagegraph.operators import predicates


def one(spark, column, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values)))).select(column).first()[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<meta name="citation_doi" content="10.1126/science.1144079">', "10.1126/science.1144079"), ("<META content='doi: 10.1/x' name='Citation_DOI'>", "10.1/x"), ('<meta name="citation_doi" content=""><a href="http://dx.doi.org/10.1000/abcdefghij">', "10.1000/abcdefghij"),
        ("doi:10.1000/abcdefghij ", "10.1000/abcdefghij"), ('x="10.1000/abcdefghij"', "10.1000/abcdefghij"), ("doi:10.1000/short ", None), ("doi:10.1000/abcdefghij doi:10.1000/abcdefghik ", None), ("10.1000/abcdefghij ", None), ("", None), (None, None),
    ],
)
def test_dois(spark, html, want):
    assert one(spark, text.doi(F.col("c0")), html) == want


@pytest.mark.parametrize(("title", "allowed"), [("A", True), ("A b/c (d)", True), ("a.b", True), ("Ünï", True), ("", False), (" ", False), (None, False), ("a#b", False), ("a|b", False), ("[a]", False), ("a\tb", False), (":a", False), ("./a", False), ("a/..", False), ("a/../b", False), ("a%41", False), ("100%", True), ("a&amp;b", False), ("a&b", True), ("x" * 255, True), ("x" * 256, False), ("é" * 128, False), ("bad title", False), ("~~~~", False)])
def test_titles(spark, title, allowed):
    assert one(spark, titles.allowed_title(F.col("c0"), ["^bad "]), title) is allowed


def test_oversized(spark):
    mb = 1024 * 1024
    rows = [(10 * mb + 301, 10, 10, "jpeg", 8, 3, True), (10 * mb + 300, 10, 10, "jpeg", 8, 3, False), (12 * mb, 10, 10, "png", 8, 3, True), (11 * mb, 10, 10, "png", 8, 3, False), (99 * mb, 10, 10, "gif", 8, 3, False), (None, 10, 10, "png", 8, 3, False), (99 * mb, None, 10, "jpeg", 8, 3, False), (10**12, 100_000, 100_000, "jpeg", 8, 3, True)]
    df = spark.createDataFrame(rows, "size long, w int, h int, kind string, bits int, c int, want boolean")
    assert all(r.want == r.got for r in df.select("want", predicates.oversized(*map(F.col, ("size", "w", "h", "kind", "bits", "c"))).alias("got")).collect())


def test_long_comments(spark):
    short, long = "<!--" + "a" * 249 + "-->", "<!--" + "a\n" * 125 + "-->"
    assert one(spark, text.long_comments(F.col("c0")), f"x{short}y{long}z<!-- open") == f"x{short}yz<!-- open"


@pytest.mark.parametrize("name", ["soup_nodes", "merged_references", "entities", "charsets"])
def test_batches_are_small(spark, name):
    """Python in tasks sees few texts at a time, however large a partition is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        catalog.queries()[name](spark, DATA)
        assert int(spark.conf.get(key)) <= 256
    finally:
        spark.conf.set(key, was)


def test_python_gets_small_batches(spark):
    """However many rows a partition has, a batch that reaches Python in a query of the catalogue has 256 at most."""
    from pagegraph.catalog.base import Catalogue

    @F.pandas_udf("long")
    def rows_in_batch(s: pd.Series) -> pd.Series:
        return pd.Series([len(s)] * len(s))

    c = Catalogue()

    @c.query()
    def batches(spark, d):
        return spark.range(0, 3000, 1, 1).select(rows_in_batch("id").alias("n"))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        assert c.functions["batches"](spark, DATA).agg(F.max("n")).first()[0] <= 256
    finally:
        spark.conf.set(key, was)


def test_python_gets_few_bytes(spark):
    """However long the texts are, a batch that reaches Python in a query of the catalogue has some 8 MB at most: 16 texts of 500,000 characters, and one more."""
    from pagegraph.catalog.base import Catalogue

    @F.pandas_udf("long")
    def rows_in_batch(s: pd.Series) -> pd.Series:
        return pd.Series([len(s)] * len(s))

    c = Catalogue()

    @c.query()
    def batches(spark, d):
        return spark.range(10, 74, 1, 1).select(rows_in_batch(F.repeat(F.col("id").cast("string"), 250_000)).alias("n"))

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        for before, most in (("64m", 18), ("2MB", 6)):  # a smaller bound of the caller's stays
            spark.conf.set(key, before)
            got = c.functions["batches"](spark, DATA).agg(F.max("n"), F.count("n")).first()
            assert got[0] <= most and got[1] == 64
    finally:
        spark.conf.set(key, was)


@pytest.mark.parametrize("name", ["entities", "charsets"])
def test_batches_have_few_bytes(spark, name):
    """The plan's batches are bounded by bytes too, whatever the session had."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        catalog.queries()[name](spark, DATA)
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.set(key, was)


def test_windows_are_streamed(spark):
    """Points at a window's very ends lie in it; what a task repeats are the points of a stretch, not the windows, which reach over many (F8)."""
    from pagegraph.operators import intervals

    seconds = [0, 1, 179, 180, 181, 359, 360, 7199, 7200, 7201, 7380, 9000]
    points = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    windows = spark.createDataFrame([(s, s) for s in (0, 1, 180, 1800, 7201)], "w long, s long").select("w", F.timestamp_seconds("s").alias("a"), F.timestamp_seconds(F.col("s") + 7200).alias("b"))
    got = intervals.window_join(points, windows, "ts", "a", "b", minutes=3).select("w", "id")
    assert sorted(map(tuple, got.collect())) == [(w, i) for w in (0, 1, 180, 1800, 7201) for i, s in enumerate(seconds) if w <= s <= w + 7200]
    plan = got._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "Generate" in plan.left().toString() and "Generate" not in plan.right().toString()


def test_windows_of_hot_stretches(spark):
    """A stretch of very many points is parted, equal points too as far as they differ, with the same pairs; few rows read don't mean few tasks (F2)."""
    from pagegraph.operators import intervals

    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)"
    points = spark.range(1500).selectExpr("id", "if(id < 1000, 60, id * 11) as s").selectExpr("id", f"{at} as ts")
    windows = spark.createDataFrame([(w,) for w in (0, 60, 61, 3000, 90000)], "s int").selectExpr("s as w", f"{at} as a", f"{at} + interval 2 hours as b")
    want = sorted((w, i) for w in (0, 60, 61, 3000, 90000) for i in range(1500) if w <= (60 if i < 1000 else i * 11) <= w + 7200)
    for most in (100, 10_000):
        got = intervals.window_join(points, windows, "ts", "a", "b", minutes=3, task=100, most=most).select("w", "id")
        assert sorted(map(tuple, got.collect())) == want
        assert got.rdd.getNumPartitions() >= 4
        if most == 100:
            by_task = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
            assert by_task < len(want) / 2
    none = points.where("false")
    assert intervals.window_join(none, windows, "ts", "a", "b", minutes=3).count() == 0


def test_coordinates_are_read_once(spark):
    """Each part of a coordinate is looked for once a row."""
    from pagegraph.functions import geo

    plan = spark.createDataFrame([("1_N_2_E",)], "p string").select(geo.latlon(F.col("p")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_extract(") <= 12


def test_closure_broadcasts_nothing(spark, monkeypatch):
    """What many rounds send to the driver would add up."""
    from pagegraph.operators import links

    edges, plans = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source long, target long"), []
    checkpoint = type(edges).checkpoint
    monkeypatch.setattr(type(edges), "checkpoint", lambda self, *a: plans.append(self._jdf.queryExecution().executedPlan().toString()) or checkpoint(self, *a))
    assert links.closure(edges).count() == 9
    assert plans and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("n", [0, 1, 61, 62, 3843, 2**53 + 1, 2**62 + 12345, 2**63 - 1])
def test_base62_of_every_long(spark, n):
    """Numbers beyond 2^53 too, which are no doubles."""
    want, k = "", n
    while k or not want:
        k, r = divmod(k, 62)
        want = titles._DIGITS62[r] + want
    row = spark.createDataFrame([(n,)], "n long").select(titles.base62(F.col("n")).alias("t")).withColumn("back", titles.unbase62(F.col("t"))).first()
    assert (row.t, row.back) == (want, n)


def test_or_join_of_repeated_keys(spark, tmp_path):
    """Pairs once, where keys repeat, have several nations or none, and meet by both conditions; no distinct over the plain pairs."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"copy (select i % 7 as c_custkey, case when i % 11 > 0 then i % 3 end as c_nationkey, case when i % 5 = 0 then 100.0 else 9500.0 end as c_acctbal from range(40) t(i)) to '{tmp_path}/customer.parquet'")
    con.execute(f"copy (select i % 9 as s_suppkey, case when i % 8 > 0 then i % 4 end as s_nationkey, case when i % 4 = 0 then 10.0 else 6000.0 end as s_acctbal from range(30) t(i)) to '{tmp_path}/supplier.parquet'")
    for t in ("customer", "supplier"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = sorted(map(tuple, catalog.queries()["or_join_as_union"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.oracle_sql()["or_join_as_union"]).fetchall())
    plan = catalog.queries()["or_join_as_union"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


def test_longest_target_sorts_no_titles(spark):
    """The longest target is found by numbers alone, without a window over rows with titles or a distinct over links."""
    plan = catalog.queries()["longest_target"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("most", [100_000, 2])
def test_links_through_templates(spark, most):
    """Counts as by brute force: null ids, templates without links, repeated links, pages of very many templates by the other way (F2)."""
    from pagegraph.operators import links

    direct = {(p, (p * 7 + k * k) % 23) for p in range(40) for k in range(p % 4 + 1)} | {(99, None), (None, 3), (None, None)}
    held = {(t, t // 3) for t in range(1, 23)} | {(5, 6), (6, 5)}
    linked = [(f, (f * f + k) % 31) for f in range(17) for k in range(f % 6)] * 2 + [(4, None), (None, 9)]
    reach = set(held)
    while more := {(a, d) for a, b in reach for c, d in held if b == c} - reach:
        reach |= more
    want = []
    for page in {p for p, _ in direct}:
        own = {t for p, t in direct if p == page and t is not None}
        own |= {t for s, t in reach if s in own}
        want.append((page, len(own), len({t for f, t in linked if f in own and t is not None})))
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((direct, "page long, template long"), (reach, "source long, target long"), (linked, "pl_from long, pl_to long"))]
    got = [tuple(r) for r in links.links_through(*frames, block=20, most=most).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_template_links_are_counted_in_blocks(spark):
    """No exchange carries a row for each page, template and link (F2)."""
    plan = catalog.queries()["template_links"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "count(distinct" not in plan.lower()


def test_closure_takes_little_disk(spark):
    """A round's shuffle files go with it; no table stays behind and the session's settings are as before (F1)."""
    from pathlib import Path

    from pagegraph.operators import links

    local = [Path(p) for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p: p.stat().st_size for d in local for p in d.rglob("shuffle_*")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, old, tables = files(), spark.conf.get(key), spark.catalog.listTables()
    got = links.closure(spark.range(1, 2000).selectExpr("id as source", "id div 2 as target"))
    left = sum(n for p, n in files().items() if p not in before)
    pairs = sum(i.bit_length() for i in range(1, 2000))
    assert (got.count(), got.distinct().count(), dict(got.dtypes)) == (pairs, pairs, {"source": "bigint", "target": "bigint", "hops": "int"})
    assert {(r.target, r.hops) for r in got.where("source = 1999").collect()} == {(1999 >> k, k) for k in range(1, 12)}
    assert left < 10 * pairs  # 65 bytes a pair, when the files of all rounds stayed
    assert (spark.conf.get(key), spark.catalog.listTables()) == (old, tables)


def test_shared_templates_go_to_few_blocks(spark, monkeypatch):
    """Pages that share templates meet in a block, whatever their ids, so that a template goes to little more than one (F1)."""
    from pagegraph.operators import links

    kept, stored = {}, links.stored
    monkeypatch.setattr(links, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    direct = spark.range(4000).selectExpr("id * 7919 % 500 as page", "id * 7919 % 500 div 10 * 10 + id div 500 as template").distinct()
    reach, linked = spark.createDataFrame([(1, 2)], "source long, target long"), spark.createDataFrame([(1, 5), (2, 6)], "pl_from long, pl_to long")
    got = links.links_through(direct, reach, linked, block=200).collect()
    assert {(r.templates, r.links) for r in got if r.page < 10} == {(8, 2)} and {(r.templates, r.links) for r in got if r.page >= 10} == {(8, 0)} and len(got) == 500
    assert kept["pages"].select("block").distinct().count() > 10
    assert kept["known"].count() < 1.5 * direct.select("template").distinct().count()


def test_links_of_templates_with_nulls(spark, tmp_path):
    """As the SQL says, with repeated rows, titles that are null, and titles whose pages link to null only; no distinct over all links."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"copy (select i % 40 as o_orderkey, case when i % 13 > 0 then i % 17 end as o_custkey from range(60) t(i)) to '{tmp_path}/orders.parquet'")
    con.execute(f"copy (select i % 45 as l_orderkey, case when i % 7 > 0 then i % 19 end as l_partkey, case when i % 5 > 0 then chr(65 + cast(i % 3 as int)) end as l_returnflag, 'F' as l_linestatus from range(200) t(i) union all select 50, 18, 'Z', 'Z' union all select 3, null, 'Z', 'Y') to '{tmp_path}/lineitem.parquet'")
    con.execute(f"copy (select 50 as o_orderkey, 18 as o_custkey union all select o_orderkey, o_custkey from '{tmp_path}/orders.parquet') to '{tmp_path}/more.parquet'")
    (tmp_path / "more.parquet").replace(tmp_path / "orders.parquet")
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    con.execute("create view part as select 1 as p_partkey, 'x' as p_name, 1 as p_size, 'x' as p_brand, 'x' as p_type")
    df = catalog.queries()["template_path_links"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(catalog.oracle_sql()["template_path_links"]).fetchall(), key=str)
    assert "count(distinct" not in df._jdf.queryExecution().logical().toString().lower()


def test_beginnings_are_guarded():
    """Places that can begin no span are passed by one look, and none that can is lost."""
    import random
    import re

    from pagegraph.functions import spans

    kinds, r = tuple(spans.KINDS), random.Random(14)
    guarded, plain = spans._openers(kinds), re.compile("|".join(f"(?P<{k}>{spans.KINDS[k][0]})" for k in kinds), spans._FLAGS)
    bits = ["<!--", "<MATH a>", "{{", "{|", "|}", "\n", " ", "[[", "==x==", "http://a.b/c", "HTTPS://x ", "<ref>", "<Table>", "</table>", "h", "\r", "ſ", "a", "<inputbox>"]
    for _ in range(500):
        t = "".join(r.choice(bits) for _ in range(r.randrange(30)))
        assert [(m.lastgroup, m.span()) for m in guarded.finditer(t)] == [(m.lastgroup, m.span()) for m in plain.finditer(t)]
    assert guarded.pattern.startswith(spans._FIRST)
