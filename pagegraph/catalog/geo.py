"""Geospatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import spatial as S
from ..session import table
from ..sources import model as M
from ..sources.model import with_model
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query(with_model("coord", then="select gc_from, gc_lat, gc_lon, gc_type from coord where gc_lat between 48 - 1500 / 111.3 and 48 + 1500 / 111.3 and gc_lon between 11 - 1500 / 111.3 / cos(48 / 57.27) and 11 + 1500 / 111.3 / cos(48 / 57.27)"))
def bbox_search(spark, d):
    """Places in the box of 1,500 km around a place."""
    return S.box_search(M.coord(spark, d), 48, 11, 1500).select("gc_from", "gc_lat", "gc_lon", "gc_type")


@query(with_model("coord", "region_box", then="select gc_from, region from coord join region_box on gc_lon > x0 and gc_lon < x0 + 55 and gc_lat > y0 and gc_lat < y0 + 26 union all select gc_from, region from coord join region_box on ((gc_lon = x0 and gc_lat >= y0 and gc_lat < y0 + 26) or (gc_lat = y0 and gc_lon > x0 and gc_lon < x0 + 55))"))
def point_in_polygon(spark, d):
    """Cell join, bounding box, then the even-odd rule; of edges the lower and left ones belong to a polygon."""
    return S.containing_regions(M.coord(spark, d), M.region_box(spark, d))


@query(with_model("coord", "region_box", then="""gap as (select gc_from, region, round(sqrt(pow(greatest(x0 - gc_lon, 0, gc_lon - x0 - 55), 2) + pow(greatest(y0 - gc_lat, 0, gc_lat - y0 - 26), 2)), 6) as distance from coord, region_box),
r as (select *, row_number() over (partition by gc_from order by distance, region) as rn from gap where distance <= 5) select gc_from, region, distance from r where rn = 1"""))
def nearest_polygon(spark, d):
    """The nearest region within five degrees."""
    return S.nearest_region(M.coord(spark, d), M.region_box(spark, d))


@query(with_model("coord", then="select cast(floor(gc_lat / 5) as bigint) as lat, cast(floor(gc_lon / 5) as bigint) as lon, cast(count(*) as bigint) as n, min(gc_from) as first_page from coord group by 1, 2 having count(*) >= 2"))
def duplicate_coords(spark, d):
    """Cells of five degrees that hold two coordinates or more."""
    return M.coord(spark, d).groupBy(F.floor(F.col("gc_lat") / 5).alias("lat"), F.floor(F.col("gc_lon") / 5).alias("lon")).agg(F.count("*").alias("n"), F.min("gc_from").alias("first_page")).where("n >= 2")


@query(with_model("coord", then="""a as (select gc_nation, gc_from, gc_primary, count(*) over (partition by gc_nation) as n, count(*) filter (gc_primary) over (partition by gc_nation) as p from coord),
b as (select gc_from, gc_nation, gc_primary and not (n > 4 and p = n) as one, floor((select gc_lat from coord c where c.gc_from = a.gc_from) / 10) as cell from a)
select gc_from, one and not (count(*) filter (one) over (partition by cell) >= 8) as gc_primary from b"""))
def primary_flag_rules(spark, d):
    """Groups of over four, all primary, lose the flag; then crowded places of eight or more do."""
    c = M.coord(spark, d)
    nation = c.groupBy("gc_nation").agg(((F.count("*") > 4) & (F.count_if("gc_primary") == F.count("*"))).alias("all_primary"))
    c = c.join(nation, "gc_nation").select("gc_from", F.floor(F.col("gc_lat") / 10).alias("cell"), (F.col("gc_primary") & ~F.col("all_primary")).alias("one"))
    crowd = c.groupBy("cell").agg((F.count_if("one") >= 8).alias("crowded"))
    return c.join(crowd, "cell").select("gc_from", (F.col("one") & ~F.col("crowded")).alias("gc_primary"))


@query(with_model("coord", then="select gc_from, cast(round((gc_lat - 90 + 360) * 100) % 36000 as bigint) as turned from coord"))
def latlon_turn(spark, d):
    """Degrees folded into a full turn, in hundredths."""
    return M.coord(spark, d).select("gc_from", (F.round((F.col("gc_lat") + 270) * 100) % 36000).cast("long").alias("turned"))


@query("""with k as (select c_custkey, ((c_custkey * 7919) % 100000) / 100.0::double - 500 as lat, ((c_custkey * 6151) % 200000) / 100.0::double - 1000 as lon from customer),
t as (select *, (lat + 90) - 360 * floor((lat + 90) / 360) as turn from k),
f as (select c_custkey, case when turn > 180 then 270 - turn else turn - 90 end as flat, case when turn > 180 then lon + 180 else lon end as l from t),
g as (select c_custkey, flat, (l + 180) - 360 * floor((l + 180) / 360) - 180 as flon from f)
select c_custkey, round(flat, 6) as lat, round(case when flon = -180 then 180 else flon end, 6) as lon from g""")
def latlon_fold(spark, d):
    """Any latitude and longitude folded onto the globe."""
    c = table(spark, d, "customer")
    lat, lon = S.fold_latlon((F.col("c_custkey") * 7919 % 100000) / F.lit(100.0) - 500, (F.col("c_custkey") * 6151 % 200000) / F.lit(100.0) - 1000)
    return c.select("c_custkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(with_model("coord", then="select gc_type, cast(count(*) as bigint) as n, cast(count(*) filter (gc_primary) as bigint) as primaries, min(gc_lat) as south, max(gc_lat) as north from coord group by gc_type"))
def coords_by_type(spark, d):
    return M.coord(spark, d).groupBy("gc_type").agg(F.count("*").alias("n"), F.count_if("gc_primary").alias("primaries"), F.min("gc_lat").alias("south"), F.max("gc_lat").alias("north"))


@query(with_model("coord", then="n as (select gc_nation, count(*) as c from coord group by 1) select cast(floor(log10(c) * 4) as bigint) as bucket, cast(count(*) as bigint) as pages, cast(sum(c) as bigint) as coords from n group by 1"))
def coord_distribution(spark, d):
    """How many pages have how many coordinates, on a log scale."""
    n = M.coord(spark, d).groupBy("gc_nation").agg(F.count("*").alias("c"))
    return n.groupBy(F.floor(F.log10("c") * 4).cast("long").alias("bucket")).agg(F.count("*").alias("pages"), F.sum("c").alias("coords"))


def _params(spark, d):
    s = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey"))
    text = F.concat(
        (F.col("k") % 90).cast("string"), F.lit("_"), (F.col("k") % 60).cast("string"), F.lit("_"), (F.col("k") * 7 % 60).cast("string"), F.when(F.col("k") % 2 == 0, "_N_").otherwise("_S_"),
        (F.col("k") * 3 % 180).cast("string"), F.lit("_"), (F.col("k") * 11 % 60).cast("string"), F.when(F.col("k") % 3 == 0, "_W").otherwise("_E"), F.lit("_type:city("), (F.col("k") * 100).cast("string"), F.lit(")_region:DE-BY_scale:"), (F.col("k") + 1000).cast("string"),
    )
    return s.select("s_suppkey", F.concat(F.lit("https://geo.example.org/geohack?pagename=X&params="), text, F.lit("&language=en")).alias("url"))


@query("""select s_suppkey, round(case when s_suppkey % 2 = 0 then 1 else -1 end * ((s_suppkey % 90) + (s_suppkey % 60) / 60.0::double + (s_suppkey * 7 % 60) / 3600.0::double), 6) + 0.0::double as lat,
round(case when s_suppkey % 3 = 0 then -1 else 1 end * ((s_suppkey * 3 % 180) + (s_suppkey * 11 % 60) / 60.0::double), 6) + 0.0::double as lon, 'city' as type, cast(s_suppkey * 100 as double) as size, 'DE-BY' as region, s_suppkey + 1000 as scale from supplier""")
def coord_parse_dms(spark, d):
    """Coordinate links with degrees, minutes and seconds, parsed back."""
    g = _params(spark, d).select("s_suppkey", G.geolink(F.col("url")).alias("g"))
    return g.select("s_suppkey", F.round("g.lat", 6).alias("lat"), F.round("g.lon", 6).alias("lon"), "g.type", "g.size", "g.region", "g.scale")


@query(with_model("coord", "region_box", then="""claim as (select gc_from, gc_lat, gc_lon, n_name as claimed from coord join nation on n_nationkey = gc_nation),
gap as (select gc_from, region, round(sqrt(pow(greatest(x0 - gc_lon, 0, gc_lon - x0 - 55), 2) + pow(greatest(y0 - gc_lat, 0, gc_lat - y0 - 26), 2)), 6) as distance, x0, y0 from coord, region_box),
near as (select gc_from, region, row_number() over (partition by gc_from order by distance, region) as rn from gap where distance <= 5)
select c.gc_from, c.claimed, n.region as found, case when g.distance = 0 then 'OK' when g.distance <= sqrt(0.018) then 'OFFSET' when n.region is not null then 'ERROR' else 'ISOLATED' end as verdict
from claim c join gap g on g.gc_from = c.gc_from and g.region = c.claimed left join near n on n.gc_from = c.gc_from and n.rn = 1"""))
def region_audit(spark, d):
    """Claimed against found regions."""
    points = M.coord(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("gc_nation"), F.col("n_name").alias("claim")), "gc_nation")
    return S.region_audit(points, M.region_box(spark, d), "claim")


@query("""with w as (select s_suppkey, case when s_suppkey % 5 = 0 then 'unknown type' end as w from supplier) select coalesce(w, 'none') as warning, cast(count(*) as bigint) as n from w group by 1""")
def coord_warnings(spark, d):
    """Warnings of parsed links by kind; every fifth link has a type that does not exist."""
    odd = _params(spark, d).withColumn("url", F.when(F.col("s_suppkey") % 5 == 0, F.replace("url", F.lit("type:city"), F.lit("type:nowhere"))).otherwise(F.col("url")))
    g = odd.select(F.explode_outer(G.geolink(F.col("url"))["warnings"]).alias("w"))
    return g.groupBy(F.coalesce("w", F.lit("none")).alias("warning")).agg(F.count("*").alias("n"))


@query("""with c as (select c_custkey, c_custkey % 6 as k, c_nationkey % 8 as z from customer)
select c_custkey, case k when 0 then 'adm2nd' when 1 then 'mountain' when 2 then 'waterbody' when 3 then 'railwaystation' when 4 then 'city' else 'adm1st' end as type, case k when 0 then 'GB' when 1 then 'RE' when 2 then 'PR' when 3 then 'DE' when 4 then 'SJ' else 'FI' end as region,
cast(case z when 0 then 33.75 when 1 then 45.0 when 2 then 337.5 when 3 then 90.0 when 4 then 10.0 when 5 then 202.5 when 6 then 348.75 end as double) as heading,
case when c_custkey % 3 = 0 then 12345 when c_custkey % 3 = 1 then cast(100000 * pow(2, 12 - z) as bigint) else case k when 0 then 300000 when 3 then 10000 when 5 then 1000000 else 100000 end end as scale,
cast(case when c_custkey % 4 = 0 then 5000.0 when c_custkey % 4 = 1 then 1234.5 when c_custkey % 4 = 2 then 50000000.0 end as double) as dim,
concat_ws(',', case when c_custkey % 7 = 0 then 'region on another globe' end, case when c_custkey % 4 = 2 then 'dim out of range' end, case when c_custkey % 3 = 0 and c_custkey % 4 in (0, 2) then 'dim beside another scale' end) as warnings from c""")
def coord_corrections(spark, d):
    """Misspelt types, regions with codes of their own, headings of all kinds, scales by zoom level and type, and diameters."""
    c = F.col("c_custkey")

    def pick(n, values):
        out = F.lit(None).cast("string")
        for i, v in enumerate(values):
            out = F.when(n == i, v).otherwise(out)
        return out

    k, z = c % 6, F.col("c_nationkey") % 8
    kinds = F.concat(F.lit("_type:"), pick(k, ("Admin2", "montain", "lake", "station", "city", "adm")), F.lit("_region:"), pick(k, ("UK", "fr-re", "US-PR", "DE", "NO-21", "SF")))
    head = F.concat(F.lit("_heading:"), pick(z, ("NNEbE", "EN", "north-northwest", "O", "370", "SSW", "NNWbyN", "up")))
    size = F.when(c % 3 == 0, "_scale:12345").when(c % 3 == 1, F.concat(F.lit("_zoom:"), z.cast("string"))).otherwise("")
    wide = F.when(c % 4 == 0, "_dim:5km").when(c % 4 == 1, "_dim:1234.5").when(c % 4 == 2, "_dim:50000000m").otherwise("")
    url = F.concat(F.lit("http://x.org/?params=1_N_2_E"), kinds, head, size, wide, F.when(c % 7 == 0, "_globe:moon").otherwise(""))
    g = table(spark, d, "customer").select("c_custkey", G.geolink(url).alias("g"))
    return g.select("c_custkey", "g.type", "g.region", "g.heading", "g.scale", "g.dim", F.array_join("g.warnings", ",").alias("warnings"))


@query("""with w as (select 'wiki' || s_nationkey % 4 as wiki, case when s_suppkey % 5 = 0 then 'unknown type' end as w, s_suppkey from supplier), c as (select wiki, w, count(*) as n from w where w is not null group by 1, 2)
select wiki, w as warning, cast(n as bigint) as n, n > 4 as suppressed, case when n <= 4 then (select string_agg(cast(s_suppkey as varchar), ',' order by s_suppkey) from w x where x.wiki = c.wiki and x.w = c.w) end as shown from c""")
def suppressed_warnings(spark, d):
    """Warnings counted by wiki; those of over four cases are suppressed, the others are shown with theirs."""
    s = _params(spark, d).withColumn("url", F.when(F.col("s_suppkey") % 5 == 0, F.replace("url", F.lit("type:city"), F.lit("type:nowhere"))).otherwise(F.col("url")))
    w = s.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").select("s_suppkey", F.concat(F.lit("wiki"), (F.col("s_nationkey") % 4).cast("string")).alias("wiki"), F.explode(G.geolink(F.col("url"))["warnings"]).alias("warning"))
    counts = w.groupBy("wiki", "warning").agg(F.count("*").alias("n"))
    few = w.join(counts.where("n <= 4"), ["wiki", "warning"], "left_semi").groupBy("wiki", "warning").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",").alias("shown"))
    return counts.join(few, ["wiki", "warning"], "left").select("wiki", "warning", "n", (F.col("n") > 4).alias("suppressed"), "shown")


@query(with_model("page", "categorylinks", "langlinks", "coord", then="""tagged as (select cl_from from categorylinks where cl_to in ('1905_births', '1911_births', '1920_births') and not exists (select 1 from coord where gc_from = cl_from and gc_primary))
select page_id, page_title, ll_lang, c.gc_lat, c.gc_lon from tagged join page on page_id = cl_from join langlinks on ll_from = page_id join coord c on c.gc_from = ll_page and c.gc_primary"""))
def interwiki_coords(spark, d):
    """Pages of categories of missing coordinates, with those that their counterparts in other languages have."""
    c = M.coord(spark, d).where("gc_primary")
    tagged = M.categorylinks(spark, d).where(F.col("cl_to").isin("1905_births", "1911_births", "1920_births")).select(F.col("cl_from").alias("page_id")).join(c.select(F.col("gc_from").alias("page_id")), "page_id", "left_anti")
    hop = tagged.join(M.page(spark, d), "page_id").join(M.langlinks(spark, d), F.col("page_id") == F.col("ll_from"))
    return hop.join(c, F.col("ll_page") == F.col("gc_from")).select("page_id", "page_title", "ll_lang", "gc_lat", "gc_lon")


@query("""select s_suppkey, '{{coord|' || (s_suppkey % 90) || '|' || case when s_suppkey % 2 = 0 then 'N' else 'S' end || '|' || (s_suppkey % 180) || '.5|E|' || case when s_suppkey % 3 = 0 then 'type:city' else 'type:city_region:DE' end || '|display=title}}' as template from supplier where s_suppkey % 90 > 0 or s_suppkey % 2 = 0""")
def coord_templates(spark, d):
    """Coordinates written as templates."""
    k = F.col("s_suppkey")
    lat = (k % 90).cast("double") * F.when(k % 2 == 0, 1).otherwise(-1)
    s = table(spark, d, "supplier").where("s_suppkey % 90 > 0 or s_suppkey % 2 = 0")
    return s.select("s_suppkey", G.template(lat, (k % 180) + F.lit(0.5), F.lit("city"), F.when(k % 3 != 0, "DE")).alias("template"))
