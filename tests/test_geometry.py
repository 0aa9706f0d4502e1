"""Text and binary forms of geometries, envelopes, and joins on the globe against plain loops."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from pagegraph.operators import geometry as G


def packed(rings, order="<"):
    head = struct.pack(order + "BII", order == "<", 3, len(rings))
    return head + b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "dd", *p) for p in r) for r in rings)


RINGS = [[[(0.0, 0.0), (4.5, 0.0), (4.5, -3.25), (0.0, 0.0)]], [[(-1e-9, 1e300), (math.pi, -0.0), (179.99999999999997, 5e-324)], [(1.0, 2.0)]], [[]], []]


def plain(rings):
    return None if rings is None else [[(p.x, p.y) for p in r] for r in rings]


def test_binary_is_the_format(spark):
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in enumerate(RINGS)]
    frame = spark.createDataFrame(rows, f"k int, rings {G.RINGS}").withColumn("wkb", G.as_binary(F.col("rings")))
    for r in frame.select("k", "wkb", G.from_binary(F.col("wkb")).alias("back")).collect():
        assert bytes(r.wkb) == packed(RINGS[r.k]) and repr(plain(r.back)) == repr(RINGS[r.k])
    other = spark.createDataFrame([(k, bytearray(packed(r, ">"))) for k, r in enumerate(RINGS)], "k int, wkb binary")
    for r in other.select("k", G.from_binary(F.col("wkb")).alias("back")).collect():
        assert repr(plain(r.back)) == repr(RINGS[r.k])


def test_points_and_lines(spark):
    x, y = F.lit(1.5), F.lit(-2.0)
    row = spark.range(1).select(
        G.as_text(G.point(x, y), "POINT").alias("p"), G.as_text(G.line(G.place(x, y), G.place(y, x)), "LINESTRING").alias("l"),
        G.as_binary(G.point(x, y), "POINT").alias("bp"), G.as_binary(G.line(G.place(x, y), G.place(y, x)), "LINESTRING").alias("bl"),
        G.envelope(G.line(G.place(x, y), G.place(y, x))).alias("e"),
    ).first()
    assert (row.p, row.l) == ("POINT(1.5 -2.0)", "LINESTRING(1.5 -2.0,-2.0 1.5)")
    assert bytes(row.bp) == struct.pack("<BIdd", 1, 1, 1.5, -2.0) and bytes(row.bl) == struct.pack("<BIIdddd", 1, 2, 2, 1.5, -2.0, -2.0, 1.5)
    assert tuple(row.e) == (-2.0, 1.5, -2.0, 1.5)
    back = spark.createDataFrame([(row.bp,), (row.bl,)], "b binary").select(G.from_binary(F.col("b")).alias("r")).collect()
    assert [plain(r.r) for r in back] == [[[(1.5, -2.0)]], [[(1.5, -2.0), (-2.0, 1.5)]]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("POLYGON((0 0,1 0,1 1,0 0))", [[(0, 0), (1, 0), (1, 1), (0, 0)]]), (" polygon ( ( 0 0 , 1e1 -.5 ,\n3. 4 ) , (5 6) ) ", [[(0, 0), (10, -0.5), (3, 4)], [(5, 6)]]), ("POINT( -1 2 )", [[(-1, 2)]]), ("LineString(1 2,3 4)", [[(1, 2), (3, 4)]]),
        ("POLYGON((0 0,1 x))", None), ("POLYGON(0 0,1 1)", None), ("POLYGON((0 0", None), ("", None), (None, None), ("MULTIPOINT(1 2)", None), ("POINT(1 2 3)", None), ("POINT(1 2) x", None), ("POLYGON((" + "1 2," * 20000 + "1 2))", [[(1, 2)] * 20001]),
    ],
)
def test_text_is_read(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(G.from_text(F.col("t")).alias("r")).first().r
    assert plain(got) == want


def test_other_binary_is_null(spark):
    bad = [None, b"", b"\x02\x03\x00\x00\x00", b"\x01\x07\x00\x00\x00\x00\x00\x00\x00", b"\x01"]
    rows = spark.createDataFrame([(None if b is None else bytearray(b),) for b in bad], "b binary").select(G.from_binary(F.col("b")).alias("r")).collect()
    assert [r.r for r in rows] == [None] * 5


def areas(rng, n):
    """Boxes of all sizes, with and without holes, many across 180 degrees in either writing."""
    out = []
    for k in range(n):
        x, y = rng.choice([rng.uniform(-180, 180), rng.choice([178.0, -179.5])]), rng.uniform(-80, 80)
        w, h = (10 ** rng.uniform(-2, 1.5) for _ in "xy")
        if rng.random() < 0.2:
            x -= 360
        rings = [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]
        if rng.random() < 0.4:
            rings.append([(x + w / 4, y + h / 4), (x + w / 2, y + h / 4), (x + w / 2, y + h / 2), (x + w / 4, y + h / 2)])
        out.append((f"a{k:03d}", rings))
    return out


def gap(rings, x, y):
    """To a box with or without a hole."""
    (x0, y0), (x1, y1) = rings[0][0], rings[0][2]
    out = math.hypot(max(x0 - x, 0, x - x1), max(y0 - y, 0, y - y1))
    if len(rings) > 1:
        (a0, b0), (a1, b1) = rings[1][0], rings[1][2]
        if a0 < x < a1 and b0 < y < b1:
            return min(x - a0, a1 - x, y - b0, b1 - y)
    return out


def frame(spark, some, name="name", rings="rings"):
    return spark.createDataFrame([(n, [[{"x": a, "y": b} for a, b in r] for r in rs]) for n, rs in some], f"{name} string, {rings} {G.RINGS}")


def test_nearest_is_the_plain_one(spark):
    rng = random.Random(7)
    some = areas(rng, 80)
    places = [(i, rng.choice([rng.uniform(-180, 180), rng.uniform(176, 180), rng.uniform(-180, -176)]), rng.uniform(-89, 89)) for i in range(300)] + [(900, None, 1.0), (901, 1.0, None)]
    for limit in (0.0, 0.7, 6.0):
        want = {}
        for i, x, y in places:
            if x is not None and y is not None:
                near = min((round(min(gap(r, x + t, y) for t in (-720, -360, 0, 360)), 6), n) for n, r in some)
                if near[0] <= limit:
                    want[i] = near
        got = {r.id: (r.distance, r.name) for r in G.nearest_area(spark.createDataFrame(places, "id long, lon double, lat double"), frame(spark, [*some, ("none", [])]), "id", "lon", "lat", "rings", "name", limit).collect()}
        assert got == want and (want or not limit)


def test_envelopes_meet_as_in_a_loop(spark):
    rng = random.Random(8)
    a, b = areas(rng, 60), areas(rng, 60)

    def box(rings):
        xs, ys = [x for x, _ in rings[0]], [y for _, y in rings[0]]
        return min(xs), max(xs), min(ys), max(ys)

    want = set()
    for n, r in a:
        for m, s in b:
            p, q = box(r), box(s)
            if any(p[0] <= q[1] + t and q[0] + t <= p[1] for t in (-720, -360, 0, 360, 720)) and p[2] <= q[3] and q[2] <= p[3]:
                want.add((n, m))
    got = [(r.name, r.other) for r in G.intersecting(frame(spark, a, rings="own"), frame(spark, b, "other"), "own", "rings").select("name", "other").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_no_areas_no_pairs(spark):
    places = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lon double, lat double")
    assert G.nearest_area(places, frame(spark, []), "id", "lon", "lat", "rings", "name").collect() == []
    assert G.nearest_area(places.limit(0), frame(spark, areas(random.Random(1), 3)), "id", "lon", "lat", "rings", "name").collect() == []


def test_envelopes(spark):
    e = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "x1", "y0", "y1"), strict=True)])
    row = spark.range(1).select(G.mbr_intersects(e(0, 1, 0, 1), e(1, 2, 1, 2)), G.mbr_intersects(e(0, 1, 0, 1), e(1.1, 2, 0, 1)), G.mbr_contains(e(0, 2, 0, 2), e(0, 1, 1, 2)), G.mbr_contains(e(0, 1, 0, 1), e(0, 2, 0, 1)), G.envelope(G.box_of(e(1, 2, 3, 4)))).first()
    assert tuple(row[:4]) == (True, False, True, False) and tuple(row[4]) == (1, 2, 3, 4)


def test_binary_is_read_once(spark):
    """Each value is worked out once a row, not once for each digit that is named (F1)."""
    few = spark.createDataFrame([(bytearray(packed(RINGS[0])),)], "wkb binary")
    plan = few.select(G.from_binary(F.col("wkb")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hex(wkb") == 1
    rings = spark.createDataFrame([("POINT(1 2)",)], "t string").select(G.as_binary(G.from_text(F.col("t"))).alias("b"))
    assert rings._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 1
