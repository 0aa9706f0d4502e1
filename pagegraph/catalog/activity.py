"""Edit, upload, page-view and user-activity queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals as I
from ..session import table
from ..sources import model as M
from ..sources.model import with_model
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""select a.event_id as start_id, b.event_id as save_id, a.user_id from events a join events b on a.user_id = b.user_id and a.event_type = 'signup' and b.event_type = 'purchase' and b.ts between a.ts and a.ts + interval 32 hour""")
def interval_join_32h(spark, d):
    """Edit starts with the saves of the same user within 32 hours."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'signup'").select(F.col("event_id").alias("start_id"), "user_id", F.col("ts").alias("started"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("save_id"), "user_id", F.col("ts").alias("saved"))
    return I.interval_join(a, b, ["user_id"], "started", "saved", 32).select("start_id", "save_id", "user_id")


@query("""select a.event_id as start_id, b.event_id as save_id, a.user_id from events a left join events b on a.user_id = b.user_id and b.event_type = 'purchase' and b.ts between a.ts and a.ts + interval 32 hour where a.event_type = 'signup'""")
def interval_left_join(spark, d):
    """Edit starts with the saves of the same user within 32 hours, and those without any."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'signup'").select(F.col("event_id").alias("start_id"), "user_id", F.col("ts").alias("started"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("save_id"), "user_id", F.col("ts").alias("saved"))
    return I.interval_join(a, b, ["user_id"], "started", "saved", 32, "left").select("start_id", "save_id", "user_id")


@query("""with a as (select event_id as row_id, user_id, date_trunc('second', ts) as seen from events where event_type = 'click'), b as (select user_id, date_trunc('second', ts) as other from events where event_type = 'view'),
c as (select row_id, other, date_diff('second', seen, other) as gap from a join b using (user_id) where abs(date_diff('second', seen, other)) <= 21 * 86400),
r as (select *, case when gap > 0 then gap * 2 else -gap end as far, row_number() over (partition by row_id order by case when gap > 0 then gap * 2 else -gap end, other) as rn from c)
select a.row_id, user_id, r.other as nearest, r.far as distance_s from a left join r on r.row_id = a.row_id and rn = 1""")
def nearest_archive(spark, d):
    """The copy nearest in time within 21 days, later copies at twice the distance."""
    e = table(spark, d, "events").withColumn("s", F.date_trunc("second", "ts"))
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("row_id"), "user_id", F.col("s").alias("at"))
    b = e.where("event_type = 'view'").select("user_id", F.col("s").alias("other"))
    return I.nearest_in_time(a, b, "user_id", "at", "other", 21, 2).select("row_id", "user_id", "nearest", "distance_s")


@query(with_model("views", then="""select pc_page, pc_date, cast(sum(pc_views) as bigint) as views, cast(sum(pc_traffic) as bigint) as traffic, cast(count(*) as bigint) as samples,
(select string_agg(strftime(h.pc_hour, '%H') || ':' || cast(h.n as varchar), '|' order by h.pc_hour) from (select pc_page, pc_hour, count(*) as n from views group by 1, 2) h where h.pc_page = v.pc_page and cast(h.pc_hour as date) = v.pc_date) as hourly from views v group by pc_page, pc_date"""))
def hourly_to_daily(spark, d):
    """Daily totals with the list of hours."""
    h = M.views(spark, d).groupBy("pc_page", "pc_date", "pc_hour").agg(F.sum("pc_views").alias("v"), F.sum("pc_traffic").alias("t"), F.count("*").alias("s"))
    hours = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pc_hour", "v"))), lambda x: F.concat(F.date_format(x["pc_hour"], "HH"), F.lit(":"), x["v"].cast("string"))), "|")
    return h.groupBy("pc_page", "pc_date").agg(F.sum("v").alias("views"), F.sum("t").alias("traffic"), F.sum("s").alias("samples"), hours.alias("hourly"))


@query(r"""with lines as (select l_orderkey || ' ' || l_returnflag || l_linestatus || ' ' || cast(l_quantity as bigint) || case when l_linenumber = 7 then '' else ' ' || l_linenumber end as line from lineitem),
f as (select string_split(line, ' ') as f from lines) select f[2] as title, cast(sum(cast(f[3] as bigint)) as bigint) as views, cast(sum(cast(f[4] as bigint)) as bigint) as bytes, cast(count(*) as bigint) as n from f where len(f) = 4 group by 1""")
def pagecounts_filter(spark, d):
    """Page-count lines of four fields; shorter ones are skipped."""
    li = table(spark, d, "lineitem")
    last = F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit(" "), F.col("l_linenumber").cast("string")))
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(" "), "l_returnflag", "l_linestatus", F.lit(" "), F.col("l_quantity").cast("long").cast("string"), last)
    f = li.select(F.split(line, " ").alias("f")).where(F.size("f") == 4)
    return f.groupBy(F.col("f")[1].alias("title")).agg(F.sum(F.col("f")[2].cast("long")).alias("views"), F.sum(F.col("f")[3].cast("long")).alias("bytes"), F.count("*").alias("n"))


@query("""select event_id, user_id, value from events where event_type = 'purchase' and (value > 90 or (value > 50 and user_id < 20)) and ts > (select max(ts) from events) - interval 14 day and user_id in (select user_id from events where event_type = 'signup')""")
def large_uploads(spark, d):
    """Large uploads of the last two weeks by users who signed up: size heuristics, relative time, semi-join."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts")).scalar()
    big = e.where("event_type = 'purchase' and (value > 90 or (value > 50 and user_id < 20))").where(F.col("ts") > last - F.expr("interval 14 days"))
    return big.join(e.where("event_type = 'signup'").select("user_id"), "user_id", "left_semi").select("event_id", "user_id", "value")


@query("""with a as (select c_custkey, c_name, c_acctbal < 0 as blocked, (select count(*) from orders where o_custkey = c_custkey) as edits, (select max(o_orderdate) from orders where o_custkey = c_custkey) as last, case when c_mktsegment = 'MACHINERY' then c_name || '_new' end as renamed from customer),
m as (select max(o_orderdate) as today from orders)
select c_custkey, cast(edits as bigint) as edits, last, case when renamed is not null then 'rename' when blocked then 'mark blocked' when edits = 0 then 'zero edits' when edits = 1 then 'single edit' when date_diff('day', cast(last as date), cast(today as date)) > 365 then 'mark inactive' else 'keep' end as action from a, m""")
def user_activity(spark, d):
    """The activity report and what a member list should do."""
    o = table(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("edits"), F.max("o_orderdate").alias("last"))
    c = table(spark, d, "customer").join(per, "c_custkey", "left").withColumn("today", o.agg(F.max("o_orderdate")).scalar())
    renamed = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat("c_name", F.lit("_new")))
    edits = F.coalesce("edits", F.lit(0))
    action = T.member_action(F.lit(True), renamed, edits, F.col("c_acctbal") < 0, F.datediff("today", "last"))
    return c.select("c_custkey", edits.alias("edits"), "last", action.alias("action"))


@query("""with r as (select user_id, event_id, ts, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) select user_id, event_id, strftime(ts, '%Y%m%d%H%M%S') as stamp, event_type from r where rn <= 5""")
def recent_contributions(spark, d):
    """Each user's last five edits, with 14-digit timestamps."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("user_id", "event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), "event_type")


@query("""with w as (select user_id, date_trunc('day', ts) as day, count(*) as n from events group by 1, 2), t as (select max(day) as last from w)
select user_id, cast(sum(n) filter (day > last - interval 7 day) as bigint) as week, cast(sum(n) as bigint) as total from w, t group by user_id""")
def activity_windows(spark, d):
    """Edits of the last week and in all, per user."""
    w = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    last = table(spark, d, "events").agg(F.date_trunc("day", F.max("ts"))).scalar()
    return w.withColumn("last", last).groupBy("user_id").agg(F.sum(F.when(F.col("day") > F.col("last") - F.expr("interval 7 days"), F.col("n"))).alias("week"), F.sum("n").alias("total"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""select cast(x as date) as day, cast(count(event_id) as bigint) as edits from (select unnest(generate_series(cast((select min(ts) from events) as date), cast((select max(ts) from events) as date), interval 1 day)) as x) left join events on cast(ts as date) = cast(x as date) group by 1""")
def daily_calendar(spark, d):
    """Edits per day, days without any too."""
    e = table(spark, d, "events")
    days = e.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("edits")), "day", "left").select("day", F.coalesce("edits", F.lit(0)).alias("edits"))
