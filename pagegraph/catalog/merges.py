"""Upsert, update, delete and replace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as K
from ..session import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""select user_id, max_by(value, event_id) filter (event_type <> 'error' and value is not null) as value, max_by(event_type, event_id) filter (event_type <> 'error') as last_type, min_by(props, event_id) as first_props from events group by user_id""")
def upsert_last_non_null(spark, d):
    """Of errors the values are null; the newest value that is not null wins, properties stay the first row's."""
    ok = F.col("event_type") != "error"
    e = table(spark, d, "events").select("user_id", "event_id", F.when(ok, F.col("value")).alias("value"), F.when(ok, F.col("event_type")).alias("last_type"), F.col("props").alias("first_props"))
    return K.upsert_last_non_null(e, ["user_id"], "event_id", ["value", "last_type"], ["first_props"])


@query("""select p_partkey as page_id, cast(sum(views) as bigint) as views, sum(traffic) as traffic from
(select l_partkey as p_partkey, 1 as views, l_quantity as traffic from lineitem union all select p_partkey, 1, cast(p_size as double) from part) group by 1""")
def upsert_additive(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("page_id"), F.lit(1).cast("long").alias("views"), F.col("l_quantity").alias("traffic"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.lit(1).cast("long").alias("views"), F.col("p_size").cast("double").alias("traffic"))
    return K.upsert_additive([a, b], ["page_id"], ["views", "traffic"])


@query("with r as (select user_id, event_id, event_type, value, row_number() over (partition by user_id, event_type order by event_id) as rn from events) select user_id, event_type, event_id, value from r where rn = 1")
def insert_ignore(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return K.insert_ignore(e, ["user_id", "event_type"], "event_id")


@query("""with changed as (select distinct o_custkey from orders where o_orderdate >= timestamp '1997-06-01'), fresh as (select c_custkey, c_name || '*' as c_name from customer where c_custkey in (select o_custkey from changed))
select c_custkey, c_name from customer where c_custkey not in (select o_custkey from changed) union all select * from fresh""")
def incremental_replace(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    changed = table(spark, d, "orders").where("o_orderdate >= timestamp'1997-06-01'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    fresh = c.join(changed, "c_custkey", "left_semi").withColumn("c_name", F.concat("c_name", F.lit("*")))
    return K.replace_changed(c, fresh, changed, "c_custkey")


@query("select p_partkey, exists(select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R') as returned from part")
def update_exists(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return K.update_exists(table(spark, d, "part").select("p_partkey"), returned, "p_partkey", "returned")


@query("""select s_suppkey, s_name, coalesce(b.top, s_acctbal) as s_acctbal from supplier left join (select c_nationkey, max(c_acctbal) as top from customer group by 1) b on b.c_nationkey = s_nationkey and s_acctbal < 0""")
def update_join(spark, d):
    """Debts are set to the nation's best balance."""
    s = table(spark, d, "supplier")
    best = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.max("c_acctbal").alias("s_acctbal"))
    debt, rest = s.where("s_acctbal < 0"), s.where("not s_acctbal < 0 or s_acctbal is null")
    return K.update_join(debt, best, "s_nationkey", "s_acctbal").unionByName(rest).select("s_suppkey", "s_name", "s_acctbal")


@query("select n_nationkey, case n_nationkey when 0 then 'ZERO' when 7 then 'SEVEN' else n_name end as n_name from nation")
def update_case(spark, d):
    return K.update_case(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name", {0: "ZERO", 7: "SEVEN"})


@query("""select c_custkey, coalesce((select max(o_orderdate) from orders where o_custkey = c_custkey and o_orderstatus = 'F'), (select max(o_orderdate) from orders where o_custkey = c_custkey)) as last_edit from customer""")
def fill_from_two_sources(spark, d):
    """The last edit from one source and, where that has none, from another."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    one = o.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_edit"))
    two = o.groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_edit"))
    return K.fill_from(table(spark, d, "customer").select("c_custkey"), "c_custkey", "last_edit", one, two)


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def delete_join(spark, d):
    heavy = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return K.delete_where_in(table(spark, d, "part").select("p_partkey", "p_name"), heavy, "p_partkey")


@query(r"select p_partkey, case when p_name like '%a%' then regexp_replace(p_name, '^([^ ]+) .*', '\1') else p_name end as p_name from part")
def update_regexp(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return K.update_where(p, F.col("p_name").like("%a%"), "p_name", F.regexp_replace("p_name", "^([^ ]+) .*", "$1"))


@query("with m as (select max(o_orderdate) as last from orders) select o_orderkey, date_diff('day', cast(o_orderdate as date), cast(last as date)) as age_days from orders, m where o_orderdate > last - interval 30 day")
def session_variable(spark, d):
    """A scalar of one query as a bound of the next."""
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate")).scalar()
    return o.where(F.col("o_orderdate") > last - F.expr("interval 30 days")).select("o_orderkey", F.datediff(last, "o_orderdate").cast("long").alias("age_days"))
