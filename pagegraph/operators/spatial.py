"""Spatial joins on plain columns: cells first, geometry after."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_latlon(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Latitude in [-90, 90] (beyond a pole the meridian changes) and longitude in (-180, 180]."""
    turn = F.pmod(lat + 90, F.lit(360.0))
    over = turn > 180
    new_lat = F.when(over, 270 - turn).otherwise(turn - 90)
    shifted = F.pmod(F.when(over, lon + 180).otherwise(lon) + 180, F.lit(360.0)) - 180
    return new_lat, F.when(shifted == -180, 180.0).otherwise(shifted)


def box_search(points: DataFrame, lat: float, lon: float, km: float, lat_col: str = "gc_lat", lon_col: str = "gc_lon") -> DataFrame:
    """Points in the box of a radius around a place."""
    dlat = km / 111.3
    dlon = dlat / max(1e-9, math.cos(lat / 57.27))
    return points.where(F.col(lat_col).between(lat - dlat, lat + dlat) & F.col(lon_col).between(lon - dlon, lon + dlon))


def bounds(polygons: DataFrame, area: str = "area") -> DataFrame:
    """Adds x0, x1, y0, y1."""
    xs, ys = F.transform(area, lambda p: p["x"]), F.transform(area, lambda p: p["y"])
    return polygons.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})


def within(area: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over an array of vertices."""
    n = F.size(area)
    edges = F.zip_with(area, F.concat(F.slice(area, 2, n - 1), F.slice(area, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]))
    return F.size(crosses) % 2 == 1


def distance_sq(area: Column, x: Column, y: Column) -> Column:
    """Least squared planar distance of a point to a polygon's edges."""
    n = F.size(area)
    edges = F.zip_with(area, F.concat(F.slice(area, 2, n - 1), F.slice(area, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def one(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / length))).otherwise(0.0)
        return F.pow(x - e["a"]["x"] - t * dx, F.lit(2.0)) + F.pow(y - e["a"]["y"] - t * dy, F.lit(2.0))

    return F.array_min(F.transform(edges, one))


def _cells(polygons: DataFrame, cell: float, margin: float) -> DataFrame:
    def span(low, high):
        return F.sequence(F.floor((F.col(low) - margin) / cell), F.floor((F.col(high) + margin) / cell))

    return polygons.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))


def polygon_candidates(points: DataFrame, polygons: DataFrame, cell: float = 10.0, margin: float = 0.0) -> DataFrame:
    """Points with the polygons whose bounding box, widened by margin, holds them: an equi-join on cells."""
    p = points.withColumn("_cx", F.floor(F.col("gc_lon") / cell)).withColumn("_cy", F.floor(F.col("gc_lat") / cell))
    q = _cells(bounds(polygons), cell, margin)
    box = F.col("gc_lon").between(F.col("x0") - margin, F.col("x1") + margin) & F.col("gc_lat").between(F.col("y0") - margin, F.col("y1") + margin)
    return p.join(q, ["_cx", "_cy"]).where(box).drop("_cx", "_cy")


def containing_regions(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(gc_from, region) of each polygon that holds a point."""
    return polygon_candidates(points, polygons).where(within(F.col("area"), F.col("gc_lon"), F.col("gc_lat"))).select("gc_from", "region")


def nearest_region(points: DataFrame, polygons: DataFrame, limit: float = 5.0) -> DataFrame:
    """(gc_from, region, distance): the nearest polygon within a limit of degrees; inside counts as zero, ties go to the first name."""
    c = polygon_candidates(points, polygons, margin=limit)
    far = F.when(within(F.col("area"), F.col("gc_lon"), F.col("gc_lat")), 0.0).otherwise(F.sqrt(distance_sq(F.col("area"), F.col("gc_lon"), F.col("gc_lat"))))
    best = c.select("gc_from", F.struct(F.round(far, 6).alias("distance"), "region").alias("m")).where(F.col("m.distance") <= limit).groupBy("gc_from").agg(F.min("m").alias("m"))
    return best.select("gc_from", "m.region", "m.distance")


def region_audit(points: DataFrame, polygons: DataFrame, claimed: str, tolerance: float = math.sqrt(0.018)) -> DataFrame:
    """(gc_from, claimed, verdict): OK inside the claimed region, OFFSET just outside, ERROR inside another, ISOLATED nowhere near, NA without a claim."""
    near = nearest_region(points, polygons)
    own = points.select("gc_from", F.col(claimed).alias("claimed"), "gc_lat", "gc_lon").join(polygons.select(F.col("region").alias("claimed"), "area"), "claimed", "left")
    own = own.withColumn("own_d", F.when(within(F.col("area"), F.col("gc_lon"), F.col("gc_lat")), 0.0).otherwise(F.sqrt(distance_sq(F.col("area"), F.col("gc_lon"), F.col("gc_lat")))))
    both = own.join(near.select("gc_from", F.col("region").alias("found"), "distance"), "gc_from", "left")
    verdict = F.when(F.col("claimed").isNull(), "NA").when(F.col("own_d") == 0, "OK").when(F.col("own_d") <= tolerance, "OFFSET").when(F.col("found").isNotNull(), "ERROR").otherwise("ISOLATED")
    return both.select("gc_from", "claimed", "found", verdict.alias("verdict"))
