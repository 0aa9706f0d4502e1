"""Aggregation, window-like and sort queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import titles
from ..operators import aggregates as A
from ..session import table
from ..sources import model as M
from ..sources.model import with_model
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_quantity), 6) as avg_qty, cast(count(*) as bigint) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    price = F.col("l_extendedprice")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""select o_orderstatus, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities, string_agg(distinct case when o_totalprice > 300000 then o_orderpriority end, '|' order by case when o_totalprice > 300000 then o_orderpriority end) as dear,
substr(string_agg(distinct o_orderpriority, ',' order by o_orderpriority), 1, 12) as cut from orders group by o_orderstatus""")
def group_concat_variants(spark, d):
    """Plain, distinct, conditional and length-limited concatenation."""
    o = table(spark, d, "orders")
    dear = A.concat_distinct(F.when(F.col("o_totalprice") > 300000, F.col("o_orderpriority")), "|")
    return o.groupBy("o_orderstatus").agg(A.concat_distinct(F.col("o_orderpriority")).alias("priorities"), F.nullif(dear, F.lit("")).alias("dear"), A.concat_distinct(F.col("o_orderpriority"), ",", 12).alias("cut"))


@query("select o_custkey, cast(count(*) as bigint) as n, max(o_totalprice) as top from orders group by o_custkey having (count(*) > 12 and max(o_totalprice) > 200000) or min(o_totalprice) > 150000")
def having_or(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"))
    return g.where("(n > 12 and top > 200000) or low > 150000").select("o_custkey", "n", "top")


@query("select o_custkey, case when count(distinct o_orderstatus) = 1 then max(o_orderstatus) end as only_status from orders group by o_custkey")
def unique_or_null(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(A.unique_or_null(F.col("o_orderstatus")).alias("only_status"))


@query(r"""with w as (select unnest(list_distinct(regexp_extract_all(text, '\p{L}+'))) as word from documents), c as (select word, count(*) as n from w group by word)
select strip_accents(lower(word)) as folded, cast(count(distinct word) as bigint) as spellings, cast(sum(n) as bigint) as uses from c group by 1 having count(distinct word) > 1""")
def collation_groups(spark, d):
    """Words whose spellings differ in case or accents only; the spellings are told apart by digest."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0))).alias("word"))
    counted = w.groupBy("word").agg(F.count("*").alias("n"))
    return counted.groupBy(titles.folded(F.col("word")).alias("folded")).agg(F.countDistinct(F.md5(F.col("word").cast("binary"))).alias("spellings"), F.sum("n").alias("uses")).where("spellings > 1")


@query("""with r as (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by l_quantity) - 1 as i, count(*) over (partition by l_suppkey) as n from lineitem)
select l_suppkey, l_quantity as median from r where i = n // 2""")
def upper_median(spark, d):
    return A.upper_median(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query("""with c as (select l_suppkey, l_quantity, count(*) as n from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_quantity) as rn from c)
select l_suppkey, l_quantity as mode from r where rn = 1""")
def mode_with_ties(spark, d):
    return A.mode_with_ties(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query("with c as (select l_orderkey, count(*) as n from lineitem group by 1) select cast(floor(log2(n) + 1e-9) as bigint) as bucket, cast(count(*) as bigint) as groups from c group by 1")
def log_bucket_histogram(spark, d):
    return A.log_histogram(table(spark, d, "lineitem"), "l_orderkey")


@query("with c as (select c_mktsegment, c_nationkey, count(*) as n from customer group by 1, 2) select c_mktsegment, c_nationkey, cast(n as bigint) as n, round(n * 100.0::double / sum(n) over (partition by c_mktsegment), 6) as share from c")
def percent_of_total(spark, d):
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return A.share_of_total(c, ["c_mktsegment"], "n")


@query("select user_id, cast(count(*) as bigint) as edits, min(ts) as first_ts, max(ts) as last_ts from events group by user_id order by edits desc, user_id limit 10")
def topk_users(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("edits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).orderBy(F.desc("edits"), "user_id").limit(10)


@query("""with t as (select unnest(string_split(replace(p_type, ' ', ','), ',')) as tag from part) select tag, cast(count(*) as bigint) as n from t group by tag""")
def tag_cloud(spark, d):
    """Counts of the tags of a delimited list."""
    return table(spark, d, "part").select(F.explode(F.split(F.replace("p_type", F.lit(" "), F.lit(",")), ",")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("""with s as (select user_id, event_type, date_diff('second', lag(ts) over (partition by user_id order by ts, event_id), ts) as gap from events)
select event_type, cast(count(*) as bigint) as n, min(gap) as least, max(gap) as most, round(avg(gap), 4) as mean, round(stddev_pop(gap), 4) as deviation from s where gap >= 0 and gap < 86400 group by event_type having count(*) >= 5""")
def elapsed_stats(spark, d):
    """Elapsed seconds per kind where there are five samples or more."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.date_trunc("second", F.lag("ts").over(w)))
    e = table(spark, d, "events").withColumn("gap", gap).where("gap >= 0 and gap < 86400")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.round(F.avg("gap"), 4).alias("mean"), F.round(F.stddev_pop("gap"), 4).alias("deviation")).where("n >= 5")


@query(with_model("page", then="""links as (select o_custkey as article_id, l_partkey as dab_id, l_returnflag = 'R' as fixed from orders join lineitem on l_orderkey = o_orderkey)
select project, cast(count(*) as bigint) as links, cast(count(*) filter (fixed) as bigint) as fixed, cast(count(distinct article_id) as bigint) as articles from links join page on page_id = dab_id group by project"""))
def project_points(spark, d):
    """Links per project, those fixed and the articles they are on."""
    li = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("article_id"), F.col("l_partkey").alias("page_id"), (F.col("l_returnflag") == "R").alias("fixed"))
    return li.join(M.page(spark, d).select("page_id", "project"), "page_id").groupBy("project").agg(F.count("*").alias("links"), F.count_if("fixed").alias("fixed"), F.countDistinct("article_id").alias("articles"))


@query("""with own as (select o_custkey as user_id, l_partkey as page_id from orders join lineitem on l_orderkey = o_orderkey), size as (select p_brand, count(*) as size from part group by 1),
n as (select user_id, p_brand, count(distinct page_id) as n from own join part on p_partkey = page_id group by 1, 2),
s as (select user_id, p_brand as project, round(100.0::double * (n - 1) / size, 6) as score from n join size using (p_brand)),
r as (select *, row_number() over (partition by user_id order by score desc, project) as rn from s where score > 0.005)
select user_id, project, score from r where rn <= 7""")
def suggest_projects(spark, d):
    """Seven projects a user by the share of their pages the user knows."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("project"))
    own = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("page_id"))
    n = own.join(part, "page_id").groupBy("user_id", "project").agg(F.countDistinct("page_id").alias("n"))
    s = n.join(part.groupBy("project").agg(F.count("*").alias("size")), "project").withColumn("score", F.round(100.0 * (F.col("n") - 1) / F.col("size"), 6)).where("score > 0.005")
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "project")
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 7").select("user_id", "project", "score")


@query("""with w as (select user_id, count(*) as points, length(cast(count(*) as varchar)) as digits from events group by user_id) select cast(digits as bigint) as digits, cast(count(*) as bigint) as users, cast(sum(points) as bigint) as points from w group by digits""")
def points_by_digits(spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("points"))
    return p.groupBy(F.length(F.col("points").cast("string")).cast("long").alias("digits")).agg(F.count("*").alias("users"), F.sum("points").alias("points"))


@query("""with m as (select conv_id, turn, role = 'assistant' as hit, lag(role = 'assistant') over (partition by conv_id order by turn) as before from conversations)
select conv_id, min(turn) as first_seen from m where hit and not coalesce(before, false) group by conv_id""")
def blame_first_seen(spark, d):
    """The first revision (turn) at which a condition holds after it did not."""
    return A.first_seen(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "assistant")


@query("""with b as (select user_id, ts, event_id, case when lag(cast(ts as date)) over (partition by user_id order by ts, event_id) is distinct from cast(ts as date) then 1 else 0 end as new from events),
r as (select *, sum(new) over (partition by user_id order by ts, event_id) as run from b)
select user_id, cast(run as bigint) as run, cast(count(*) as bigint) as n, min(ts) as first_ts from r group by 1, 2""")
def date_breaks(spark, d):
    """Runs of a user's events on one date."""
    r = A.breaks(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.to_date("ts"))
    return r.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("""with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) select o_custkey, o_orderkey, o_totalprice from r where rn = 1""")
def best_row_per_group(spark, d):
    return A.best_row(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("""with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as rn from part) select p_brand, string_agg(cast(p_partkey as varchar), ',' order by rn) as samples from r where rn <= 33 group by p_brand""")
def first_samples(spark, d):
    """The first 33 ids of each group."""
    ranked = A.first_k(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")], 33)
    return ranked.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ",").alias("samples"))


@query(with_model("page", then=r"select page_id, page_title, reverse(upper(regexp_replace(page_title, '_\([0-9]{4}\)$', ''))) as sort_key from page order by sort_key, page_id"))
def suffix_sorted_titles(spark, d):
    p = M.page(spark, d)
    return p.select("page_id", "page_title", titles.sort_key(F.col("page_title")).alias("sort_key")).orderBy("sort_key", "page_id")


@query("select p_partkey, p_name, cast(floor(log(p_size) / log(5) + 1e-9) as bigint) as grade from part order by grade desc, p_name, p_partkey")
def log_gradation_sort(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", "p_name", A.log_gradation(F.col("p_size"), 5).alias("grade")).orderBy(F.desc("grade"), "p_name", "p_partkey")


@query("select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment from customer order by segment is null, segment, c_custkey")
def null_last_sort(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return c.orderBy(F.col("segment").isNull(), "segment", "c_custkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def limit_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("""select n_name as name from nation union select r_name from region""")
def union_distinct(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).distinct()


@query("""select 'a' as wiki, c_nationkey as k from customer where c_acctbal > 5000 union all select 'b', s_nationkey from supplier where s_acctbal > 5000""")
def union_all_wikis(spark, d):
    """The same query on two tables, tagged and put together."""
    a = table(spark, d, "customer").where("c_acctbal > 5000").select(F.lit("a").alias("wiki"), F.col("c_nationkey").alias("k"))
    return a.unionByName(table(spark, d, "supplier").where("s_acctbal > 5000").select(F.lit("b").alias("wiki"), F.col("s_nationkey").alias("k")))


@query("select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 250000")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 250000").select("o_custkey"))


@query("select p_partkey as k from part intersect select l_partkey from lineitem where l_discount > 0.05")
def set_intersection(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).intersect(table(spark, d, "lineitem").where("l_discount > 0.05").select("l_partkey"))


@query("select cast(count(*) as bigint) as n, cast(count(distinct o_custkey) as bigint) as customers, cast(count(case when o_orderstatus = 'F' then 1 end) as bigint) as filled from orders")
def global_counts(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("filled"))


@query("""with k as (select p_name, p_partkey, count(*) over (partition by p_name, p_size) as c from part) select p_partkey, p_name from k where c > 1""")
def keep_collisions(spark, d):
    """Rows whose name and size are not unique."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return p.join(p.groupBy("p_name", "p_size").agg(F.count("*").alias("c")).where("c > 1").drop("c"), ["p_name", "p_size"]).select("p_partkey", "p_name")
