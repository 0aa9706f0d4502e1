"""The wiki data model as projections of the driver's tables.

Every projection is a lazy DataFrame over whole tables; MODEL_SQL holds the same
projection as a common table expression, so that a query and its SQL start from
the same rows. `div` is integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def page(spark: SparkSession, d: str) -> DataFrame:
    """Pages from part: eight neighbours share a normalised title; small sizes mark disambiguation pages and redirects."""
    title = F.concat(F.lit("Topic_"), F.expr("p_partkey div 8").cast("string"), F.lit("_("), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(")"))
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("page_id"), title.alias("page_title"), F.col("p_size").cast("long").alias("page_len"),
        ((F.col("p_size") < 8) & (F.col("p_size") % 5 != 1)).alias("is_dab"), (F.col("p_size") % 5 == 1).alias("is_redirect"), F.col("p_brand").alias("project"), F.col("p_type").alias("kind"),
    )


def redirect(spark: SparkSession, d: str) -> DataFrame:
    """A redirect page points at the page before it, which may be a redirect too."""
    return page(spark, d).where("is_redirect").select(F.col("page_id").alias("rd_from"), (F.col("page_id") - 1).alias("rd_to"))


def pagelinks(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """Page c links to page p where customer c ordered part p; each once, or as often as it comes."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    links = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("pl_from"), F.col("l_partkey").alias("pl_to"))
    return links.distinct() if once else links


def wantedlinks(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """Links some of which lead beyond the last page, so to pages that don't exist."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    links = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("pl_from"), (F.col("l_partkey") + F.col("l_suppkey")).alias("pl_to"))
    return links.distinct() if once else links


def categorylinks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kinds = p.select(F.col("p_partkey").alias("cl_from"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("cl_to"))
    births = p.select(F.col("p_partkey").alias("cl_from"), F.concat((F.col("p_size") + 1900).cast("string"), F.lit("_births")).alias("cl_to"))
    return kinds.unionAll(births)


def templatelinks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("tl_from"), F.concat("l_returnflag", "l_linestatus").alias("tl_title")).distinct()


def langlinks(spark: SparkSession, d: str) -> DataFrame:
    """Two other languages' pages for each page: numbers stand for titles."""
    p = table(spark, d, "part")
    langs = F.explode(F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(i).alias("i")) for i, lang in ((1, "de"), (2, "fr"))]))
    return p.select(F.col("p_partkey").alias("ll_from"), "p_size", langs.alias("l")).select("ll_from", F.col("l.lang").alias("ll_lang"), (F.col("ll_from") * F.col("l.i") + F.col("p_size")).alias("ll_page"))


def coord(spark: SparkSession, d: str) -> DataFrame:
    """One coordinate per customer, in hundredths of a degree."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("gc_from"), (((F.col("c_custkey") * 3701) % 18000) / F.lit(100.0) - 90).alias("gc_lat"), (((F.col("c_custkey") * 9103) % 36000) / F.lit(100.0) - 180).alias("gc_lon"),
        F.lower("c_mktsegment").alias("gc_type"), F.col("c_nationkey").cast("long").alias("gc_nation"), (F.col("c_acctbal") > 0).alias("gc_primary"),
    )


def region_box(spark: SparkSession, d: str) -> DataFrame:
    """One polygon per nation: a box of 55 by 26 degrees in a 5 by 5 grid, as an array of vertices."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("region_id"), F.col("n_name").alias("region"))
    x, y = (F.col("region_id") % 5) * 72.0 - 180 + 5, F.expr("region_id div 5") * 36.0 - 90 + 4
    corners = [(0, 0), (55, 0), (55, 26), (0, 26)]
    return n.withColumn("area", F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in corners]))


def views(spark: SparkSession, d: str) -> DataFrame:
    """Page-view records from events of the kind view."""
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select(F.col("user_id").alias("pc_page"), F.col("ts"), F.date_trunc("hour", "ts").alias("pc_hour"), F.to_date("ts").alias("pc_date"), F.lit(1).cast("long").alias("pc_views"), F.floor("value").cast("long").alias("pc_traffic"))


#: Common table expressions in DuckDB's dialect, by name.
MODEL_SQL = {
    "page": """page as (select p_partkey as page_id, 'Topic_' || cast(p_partkey // 8 as varchar) || '_(' || replace(p_name, ' ', '_') || '_' || cast(p_partkey as varchar) || ')' as page_title,
  cast(p_size as bigint) as page_len, p_size < 8 and p_size % 5 <> 1 as is_dab, p_size % 5 = 1 as is_redirect, p_brand as project, p_type as kind from part)""",
    "redirect": "redirect as (select p_partkey as rd_from, p_partkey - 1 as rd_to from part where p_size % 5 = 1)",
    "pagelinks": "pagelinks as (select distinct o_custkey as pl_from, l_partkey as pl_to from orders join lineitem on o_orderkey = l_orderkey)",
    "wantedlinks": "wantedlinks as (select distinct o_custkey as pl_from, l_partkey + l_suppkey as pl_to from orders join lineitem on o_orderkey = l_orderkey)",
    "categorylinks": "categorylinks as (select p_partkey as cl_from, replace(p_type, ' ', '_') as cl_to from part union all select p_partkey, cast(p_size + 1900 as varchar) || '_births' from part)",
    "templatelinks": "templatelinks as (select distinct l_partkey as tl_from, l_returnflag || l_linestatus as tl_title from lineitem)",
    "langlinks": "langlinks as (select p_partkey as ll_from, unnest(['de', 'fr']) as ll_lang, unnest([p_partkey + p_size, p_partkey * 2 + p_size]) as ll_page from part)",
    "coord": """coord as (select c_custkey as gc_from, ((c_custkey * 3701) % 18000) / 100.0::double - 90 as gc_lat, ((c_custkey * 9103) % 36000) / 100.0::double - 180 as gc_lon,
  lower(c_mktsegment) as gc_type, cast(c_nationkey as bigint) as gc_nation, c_acctbal > 0 as gc_primary from customer)""",
    "region_box": "region_box as (select cast(n_nationkey as bigint) as region_id, n_name as region, (n_nationkey % 5) * 72.0::double - 175 as x0, (n_nationkey // 5) * 36.0::double - 86 as y0 from nation)",
    "views": "views as (select user_id as pc_page, ts, date_trunc('hour', ts) as pc_hour, cast(ts as date) as pc_date, 1 as pc_views, cast(floor(value) as bigint) as pc_traffic from events where event_type = 'view')",
    "resolved": "resolved as (select distinct pl_from, coalesce(rd_to, pl_to) as target from pagelinks left join redirect on rd_from = pl_to)",
}


def with_model(*names: str, then: str) -> str:
    """SQL that starts from the named projections; `then` goes on with `select` or with further `name as (...)`."""
    head = "with " + ",\n".join(MODEL_SQL[n] for n in names)
    return head + ("\n" if then.lstrip().lower().startswith("select") else ",\n") + then.lstrip()
