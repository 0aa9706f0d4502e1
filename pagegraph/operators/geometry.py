"""Geometry on columns: points, lines and polygons with holes as text and binary, boxes, and joins of places with areas on the whole globe.

A geometry is a column of rings, array<array<struct<x, y>>>: a polygon's outer ring
and its holes, a line's or a point's only one. All is built of column functions.

Areas meet places by cells of a quadtree: an area lies in the cells of the level
whose width is its own size or more, so it has four at most, small areas lie in
small cells and few places meet them; a place looks once on each level that is in
use. Cells go round the globe, and a place is moved by full turns to the side of
the area, so areas may cross 180 degrees, in either way of writing it (170 to 190,
or -190 to -170).

Defined results: text and binary that is no geometry of these kinds gives null;
null and empty geometries meet nothing; a place on an edge may be in or out, its
distance is zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<struct<x: double, y: double>>>"
_KINDS = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3}
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PLACE = rf"\s*{_NUMBER}\s+{_NUMBER}\s*"
_LIST = rf"\({_PLACE}(?:,{_PLACE})*+\)"

# ----------------------------------------------------------------- text


def once(value: Column, use) -> Column:
    """use(value), where the value is worked out once, however often it is named: the planner doesn't share what stands in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def place(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column) -> Column:
    return F.array(F.array(place(x, y)))


def line(*places: Column) -> Column:
    return F.array(F.array(*places))


def kind_of_text(wkt: Column) -> Column:
    """POINT, LINESTRING or POLYGON, else null."""
    whole = rf"(?is)^\s*(?:(POINT)\s*\({_PLACE}\)|(LINESTRING)\s*{_LIST}|(POLYGON)\s*\(\s*{_LIST}(?:\s*,\s*{_LIST})*+\s*\))\s*$"
    return F.when(wkt.rlike(whole), F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1)))


def from_text(wkt: Column) -> Column:
    """Rings of well-known text."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]*)\)"), F.lit(1))

    def one(p):
        return once(F.split(F.trim(F.translate(p, "\t\r\n", "   ")), " +"), lambda parts: place(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))

    return F.when(kind_of_text(wkt).isNotNull(), F.transform(rings, lambda r: F.transform(F.split(r, ","), one)))


def _ring_text(ring: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))


def as_text(rings: Column, kind: str = "POLYGON") -> Column:
    """Well-known text of rings."""
    body = F.array_join(F.transform(rings, _ring_text), ",")
    return F.concat(F.lit(kind), F.concat(F.lit("("), body, F.lit(")")) if kind == "POLYGON" else body)


# ----------------------------------------------------------------- binary


def _turned(h: Column, size: int) -> Column:
    """Hex digits of `size` bytes in the opposite order."""
    return F.concat(*[F.substring(h, 2 * k - 1, 2) for k in range(size, 0, -1)])


def _int_hex(n: Column) -> Column:
    return once(F.lpad(F.hex(n.cast("bigint")), 8, "0"), lambda h: _turned(h, 4))


def _double_hex(x: Column) -> Column:
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("bigint")
    return once(F.lpad(F.hex(bits), 16, "0"), lambda h: _turned(h, 8))


def as_binary(rings: Column, kind: str = "POLYGON") -> Column:
    """Little-endian well-known binary of rings."""

    def places(ring):
        return F.array_join(F.transform(ring, lambda p: F.concat(_double_hex(p["x"]), _double_hex(p["y"]))), "")

    body = {
        "POINT": lambda r: places(F.get(r, F.lit(0))),
        "LINESTRING": lambda r: F.concat(_int_hex(F.size(F.get(r, F.lit(0)))), places(F.get(r, F.lit(0)))),
        "POLYGON": lambda r: F.concat(_int_hex(F.size(r)), F.array_join(F.transform(r, lambda x: F.concat(_int_hex(F.size(x)), places(x))), "")),
    }[kind]
    return F.unhex(F.concat(F.lit(f"01{_KINDS[kind]:02X}000000"), once(rings, body)))


def from_binary(wkb: Column) -> Column:
    """Rings of well-known binary of either byte order. Hex digits, counts and numbers are worked out once, then named."""
    start = F.struct(F.lit(9).alias("at"), F.array().cast(RINGS).alias("rings"))

    def rings(h, little):
        def digits(at, size, use):  # at: a place in bytes, from 0
            return once(F.substring(h, at * 2 + 1, F.lit(2 * size)), lambda own: once(F.when(little, _turned(own, size)).otherwise(own), use))

        def number(at):
            return digits(at, 4, lambda own: F.conv(own, 16, 10).cast("int"))

        def value(own):
            bits = F.conv(own, 16, -10).cast("bigint")  # to a negative base: with its sign
            return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")

        def places(at, n):
            return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: place(digits(at + k * 16, 8, value), digits(at + k * 16 + 8, 8, value)))).otherwise(F.array().cast("array<struct<x: double, y: double>>"))

        def add(a, _):
            return once(number(a["at"]), lambda n: F.struct((a["at"] + 4 + n * 16).alias("at"), F.concat(a["rings"], F.array(places(a["at"] + 4, n))).alias("rings")))

        def polygon(count):
            return F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), start, add)["rings"]

        def of_kind(kind):
            five, nine = F.lit(5), F.lit(9)
            line_ = once(number(five), lambda n: F.array(places(nine, n)))
            return F.when(kind == 1, F.array(places(five, F.lit(1)))).when(kind == 2, line_).when(kind == 3, once(F.least(number(five), F.length(wkb)), polygon))

        return F.when(F.substring(h, 1, 2).isin("00", "01"), once(number(F.lit(1)), of_kind))

    return once(F.hex(wkb), lambda h: once(F.substring(h, 1, 2) == "01", lambda little: rings(h, little)))


# ----------------------------------------------------------------- boxes


def envelope(rings: Column) -> Column:
    """struct<x0, x1, y0, y1> around all places."""

    def around(every):
        xs, ys = F.transform(every, lambda p: p["x"]), F.transform(every, lambda p: p["y"])
        return F.when(F.size(every) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1")))

    return once(F.flatten(rings), around)


def box(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Rings of a box, closed."""
    return F.array(F.array(place(x0, y0), place(x1, y0), place(x1, y1), place(x0, y1), place(x0, y0)))


def box_of(e: Column) -> Column:
    return box(e["x0"], e["x1"], e["y0"], e["y1"])


def mbr_intersects(a: Column, b: Column) -> Column:
    """Whether two envelopes have a place in common, edges included."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def mbr_contains(a: Column, b: Column) -> Column:
    """Whether envelope a holds envelope b, edges included."""
    return (a["x0"] <= b["x0"]) & (b["x1"] <= a["x1"]) & (a["y0"] <= b["y0"]) & (b["y1"] <= a["y1"])


def _edges(rings: Column) -> Column:
    """Neighbouring places of each ring; a ring that is not closed is closed."""
    return F.flatten(F.transform(rings, lambda r: F.zip_with(r, F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))


def within(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings: in the outer one and in no hole."""

    def inside(p):
        x, y = p["x"], p["y"]
        crosses = F.filter(_edges(rings), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]))
        return F.size(crosses) % 2 == 1

    return once(F.struct(x.alias("x"), y.alias("y")), inside)


def distance(rings: Column, x: Column, y: Column) -> Column:
    """Planar degrees to a polygon: zero inside, else to the nearest edge of any ring."""

    def one(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / length))).otherwise(0.0)
        return F.pow(x - e["a"]["x"] - t * dx, F.lit(2.0)) + F.pow(y - e["a"]["y"] - t * dy, F.lit(2.0))

    return F.when(within(rings, x, y), 0.0).otherwise(F.sqrt(F.array_min(F.transform(_edges(rings), one))))


# ----------------------------------------------------------------- joins on the globe

DEEPEST = 16


def _level(e: Column, margin: float) -> Column:
    """The level of the smallest cells that are no narrower than an envelope with its margin."""
    width = F.greatest(e["x1"] - e["x0"], e["y1"] - e["y0"]) + 2 * margin
    return F.when(width >= 360, 0).otherwise(F.least(F.lit(DEEPEST), F.floor(F.log2(F.lit(360.0) / F.greatest(width, F.lit(1e-9)))))).cast("int")


def _numbers(low: Column, high: Column, level: Column) -> Column:
    """Cells that a range of degrees meets on a level, round the globe; a range has two unless it is the globe."""
    n = F.pow(F.lit(2.0), level)
    first, last = (F.floor((v + 180) * n / 360).cast("bigint") for v in (low, high))
    last = F.least(last, first + n.cast("bigint"))
    return F.array_distinct(F.transform(F.sequence(first, last), lambda k: F.pmod(k, n.cast("bigint"))))


def area_cells(areas: DataFrame, rings: str, margin: float = 0.0) -> DataFrame:
    """Areas with their envelope, a row for each cell (level, cx, cy)."""
    boxed = areas.withColumn("envelope", envelope(F.col(rings))).where("envelope is not null")
    e = F.col("envelope")
    level = F.col("level")
    cells = boxed.withColumn("level", _level(e, margin)).withColumn("cx", F.explode(_numbers(e["x0"] - margin, e["x1"] + margin, level)))
    return cells.withColumn("cy", F.explode(_numbers(e["y0"] - margin, e["y1"] + margin, level)))


def place_area_pairs(places: DataFrame, areas: DataFrame, x: str, y: str, rings: str, margin: float = 0.0) -> DataFrame:
    """Places with the areas whose envelope, widened by margin, holds them; near_x: the place's x on the area's side of the globe."""
    cells = area_cells(areas, rings, margin)
    levels = [r.level for r in cells.select("level").distinct().collect()]  # at most DEEPEST + 1
    if not levels:
        return places.crossJoin(cells.drop("level", "cx", "cy").limit(0)).withColumn("near_x", F.lit(0.0)).limit(0)
    looks = places.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    n = F.pow(F.lit(2.0), F.col("level"))
    for name, at in (("cx", x), ("cy", y)):
        looks = looks.withColumn(name, F.pmod(F.floor((F.col(at) + 180) * n / 360).cast("bigint"), n.cast("bigint")))
    met = looks.join(cells, ["level", "cx", "cy"]).drop("level", "cx", "cy")
    e = F.col("envelope")
    met = met.withColumn("near_x", F.col(x) + 360 * F.round(((e["x0"] + e["x1"]) / 2 - F.col(x)) / 360))
    return met.where(F.col("near_x").between(e["x0"] - margin, e["x1"] + margin) & F.col(y).between(e["y0"] - margin, e["y1"] + margin))


def nearest_area(places: DataFrame, areas: DataFrame, id_col: str, x: str, y: str, rings: str, name: str, limit: float = 5.0) -> DataFrame:
    """(id, name, distance): for each place the nearest area within a limit of degrees; ties go to the first name."""
    c = place_area_pairs(places, areas, x, y, rings, limit).withColumn("distance", F.round(distance(F.col(rings), F.col("near_x"), F.col(y)), 6))
    best = c.where(F.col("distance") <= limit).groupBy(id_col).agg(F.min(F.struct("distance", name)).alias("m"))
    return best.select(id_col, f"m.{name}", "m.distance")


def intersecting(left: DataFrame, right: DataFrame, left_rings: str, right_rings: str) -> DataFrame:
    """Pairs of areas whose envelopes intersect, round the globe: envelopes a and b, b on a's side.

    Two boxes meet in the cells of the wider one's level: every box lies in cells of its own level, and
    looks for wider ones in the cells around it on each level above.
    """
    a, b = (area_cells(df, rings).withColumnRenamed("envelope", e) for df, rings, e in ((left, left_rings, "a"), (right, right_rings, "b")))

    def looks(df, rings, e, down):
        boxed = df.withColumn(e, envelope(F.col(rings))).where(f"{e} is not null")
        own = F.col(e)
        above = boxed.withColumn("level", F.explode(F.sequence(F.lit(0), _level(own, 0.0) - F.lit(int(down)))) if not down else F.explode(F.when(_level(own, 0.0) > 0, F.sequence(F.lit(0), _level(own, 0.0) - 1))))
        cells = above.withColumn("cx", F.explode(_numbers(own["x0"], own["x1"], F.col("level"))))
        return cells.withColumn("cy", F.explode(_numbers(own["y0"], own["y1"], F.col("level"))))

    keys = ["level", "cx", "cy"]
    ea, eb = F.col("a"), F.col("b")
    up = looks(left, left_rings, "a", False).join(b, keys)  # b is as wide or wider
    down = a.join(looks(right, right_rings, "b", True), keys)  # b is narrower
    pairs = up.unionByName(down).drop(*keys)
    turn = 360 * F.round(((ea["x0"] + ea["x1"]) / 2 - (eb["x0"] + eb["x1"]) / 2) / 360)
    moved = F.struct((eb["x0"] + turn).alias("x0"), (eb["x1"] + turn).alias("x1"), eb["y0"].alias("y0"), eb["y1"].alias("y1"))
    return pairs.withColumn("b", moved).where(mbr_intersects(ea, F.col("b"))).distinct()


def radius_box(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """(x0, x1, y0, y1) of the box of a radius; all longitudes where it holds a pole."""
    dlat = km / 111.3
    y0, y1 = max(-90.0, lat - dlat), min(90.0, lat + dlat)
    if lat - dlat <= -90 or lat + dlat >= 90:
        return -180.0, 180.0, y0, y1
    dlon = min(180.0, dlat / max(1e-9, math.cos(lat / 57.27)))
    return lon - dlon, lon + dlon, y0, y1


def in_box(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Whether a place is in a box, edges included. Bounds of latitude may be swapped; longitudes go from x0 to the east until x1, by full turns."""
    y0, y1 = min(y0, y1), max(y0, y1)
    width = x1 - x0 if 0 <= x1 - x0 <= 360 else 360.0 if x1 - x0 > 360 else (x1 - x0) % 360
    inside = F.pmod(x - F.lit(float(x0)), F.lit(360.0)) <= F.lit(float(width))
    return y.between(y0, y1) & (F.lit(width >= 360) | inside)
