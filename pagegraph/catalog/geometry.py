"""Geometries as text and binary, and joins across 180 degrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..sources import model as M
from ..sources.model import with_model
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


def _squares(spark, d):
    """A box of two degrees with a hole around each coordinate, in quarters of a degree; some cross 180 degrees."""
    x, y = F.floor(F.col("gc_lon")) + 0.25, F.floor(F.col("gc_lat")) * 0.5
    rings = F.concat(G.box(x - 1, x + 1, y - 1, y + 1), G.box(x - 0.5, x + 0.5, y - 0.25, y + 0.25))
    return M.coord(spark, d).select("gc_from", rings.alias("rings"))


def _areas(spark, d):
    """The regions 40 degrees to the east, so that some cross 180, with a hole."""
    n = M.region_box(spark, d)
    x, y = F.col("area")[0]["x"] + 40, F.col("area")[0]["y"]
    return n.select("region", F.concat(G.box(x, x + 55, y, y + 26), G.box(x + 20, x + 30, y + 8, y + 16)).alias("rings"))


_SQUARES_SQL = "s as (select gc_from, floor(gc_lon) + 0.25::double as x, floor(gc_lat) * 0.5::double as y from coord)"
_AREAS_SQL = "a as (select region, x0 + 40 as x0, x0 + 95 as x1, y0, y0 + 26 as y1 from region_box)"
_TURNS_SQL = "t as (select unnest([-360.0::double, 0, 360]) as turn)"


@query(with_model("coord", then=f"""{_SQUARES_SQL}
select gc_from, 'POLYGON((' || (x - 1) || ' ' || (y - 1) || ',' || (x + 1) || ' ' || (y - 1) || ',' || (x + 1) || ' ' || (y + 1) || ',' || (x - 1) || ' ' || (y + 1) || ',' || (x - 1) || ' ' || (y - 1) || '),(' || (x - 0.5) || ' ' || (y - 0.25) || ',' || (x + 0.5) || ' ' || (y - 0.25) || ',' || (x + 0.5) || ' ' || (y + 0.25) || ',' || (x - 0.5) || ' ' || (y + 0.25) || ',' || (x - 0.5) || ' ' || (y - 0.25) || '))' as wkt,
  cast(177 as bigint) as wkb_bytes, x - 1 as x0, x + 1 as x1, y - 1 as y0, y + 1 as y1, false as in_hole, true as beside_hole from s"""))
def geometry_round_trip(spark, d):
    """Polygons with holes written as text, read, written as binary, read; their envelopes, and whether the centre and a place beside the hole are in them."""
    s = _squares(spark, d).select("gc_from", G.as_text(F.col("rings")).alias("wkt"))
    s = s.withColumn("wkb", G.as_binary(G.from_text(F.col("wkt")))).withColumn("rings", G.from_binary(F.col("wkb")))
    e = G.envelope(F.col("rings"))
    x, y = (F.col("e.x0") + F.col("e.x1")) / 2, (F.col("e.y0") + F.col("e.y1")) / 2
    out = s.withColumn("e", e)
    return out.select("gc_from", "wkt", F.length("wkb").cast("bigint").alias("wkb_bytes"), "e.*", G.within(F.col("rings"), x, y).alias("in_hole"), G.within(F.col("rings"), x + 0.75, y).alias("beside_hole"))


@query(with_model("coord", "region_box", then=f"""{_AREAS_SQL}, {_TURNS_SQL}, p as (select gc_from, region, gc_lat as y, gc_lon + turn as x, x0, x1, y0, y1 from coord, t, a),
g as (select gc_from, region, case when x > x0 + 20 and x < x0 + 30 and y > y0 + 8 and y < y0 + 16 then least(x - x0 - 20, x0 + 30 - x, y - y0 - 8, y0 + 16 - y)
  else sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)) end as gap from p),
r as (select gc_from, region, round(gap, 6) as distance, row_number() over (partition by gc_from order by round(gap, 6), region) as rn from g where round(gap, 6) <= 5)
select gc_from, region, distance from r where rn = 1"""))
def nearest_across(spark, d):
    """The nearest region within five degrees, across 180 degrees too; regions have holes."""
    return G.nearest_area(M.coord(spark, d), _areas(spark, d), "gc_from", "gc_lon", "gc_lat", "rings", "region")


@query(with_model("coord", "region_box", then=f"""{_SQUARES_SQL}, {_AREAS_SQL}, {_TURNS_SQL}
select region, cast(count(distinct gc_from) as bigint) as places, min(gc_from) as first_place from s, t, a where x - 1 + turn <= x1 and x + 1 + turn >= x0 and y - 1 <= y1 and y + 1 >= y0 group by region"""))
def envelopes_meet(spark, d):
    """Boxes that intersect each region's box, across 180 degrees too."""
    pairs = G.intersecting(_squares(spark, d).withColumnRenamed("rings", "own"), _areas(spark, d), "own", "rings")
    return pairs.groupBy("region").agg(F.countDistinct("gc_from").alias("places"), F.min("gc_from").alias("first_place"))


@query(with_model("coord", then="""b as (select *, case when gc_lon < 0 then gc_lon + 360 else gc_lon end as east from coord)
select gc_from, 'antimeridian' as name from b where gc_lat between -18 - 2000 / 111.3 and -18 + 2000 / 111.3 and east between 178 - 2000 / 111.3 / cos(-18 / 57.27) and 178 + 2000 / 111.3 / cos(-18 / 57.27)
union all select gc_from, 'pole' from coord where gc_lat >= 85 - 1000 / 111.3 union all select gc_from, 'swapped' from coord where gc_lat between 10 and 50 and (gc_lon >= 150 or gc_lon <= -120)"""))
def box_searches(spark, d):
    """Boxes across 180 degrees, around a pole, and with swapped bounds."""
    c = M.coord(spark, d)
    boxes = {"antimeridian": G.radius_box(-18, 178, 2000), "pole": G.radius_box(85, 10, 1000), "swapped": (150, -120, 50, 10)}
    parts = [c.where(G.in_box(F.col("gc_lon"), F.col("gc_lat"), *b)).select("gc_from", F.lit(k).alias("name")) for k, b in boxes.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
