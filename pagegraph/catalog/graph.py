"""Link-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles
from ..operators import links as L
from ..session import table
from ..sources import model as M
from ..sources.model import with_model
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

RESOLVED = "resolved as (select distinct pl_from, coalesce(rd_to, pl_to) as target from pagelinks left join redirect on rd_from = pl_to)"


@query(with_model("page", "redirect", "pagelinks", then=RESOLVED + r""",
linked as (select distinct target from resolved join page on page_id = pl_from and is_dab),
art as (select page_title, is_dab, upper(trim(both '_' from regexp_replace(regexp_replace(page_title, '^([^(]+)[(][^)]*[)](,[^(),]*)?$', '\1'), '(^|_)(the|an?)(_|$)', '', 'gi'))) as norm, target is not null as linked from page left join linked on target = page_id where not is_redirect)
select norm, cast(count(*) filter (is_dab) as bigint) as dab_pages, cast(count(*) filter (not is_dab and not linked) as bigint) as missing_cnt, coalesce(string_agg(page_title, ' ' order by page_title) filter (not is_dab and not linked), '') as missing
from art group by norm having count(*) filter (is_dab) = 1 and count(*) filter (not is_dab and not linked) between 1 and 10"""))
def missing_entries(spark, d):
    """Titles one disambiguation page covers that lack entries."""
    return L.missing_entries(M.page(spark, d), M.pagelinks(spark, d), M.redirect(spark, d))


@query(with_model("redirect", "pagelinks", then="""direct as (select pl_to as page_id, count(*) as n from pagelinks group by pl_to),
via as (select rd_to as page_id, count(*) as n from pagelinks join redirect on rd_from = pl_to group by rd_to)
select page_id, cast(sum(n) as bigint) as backlinks from (select * from direct union all select * from via) group by page_id"""))
def backlinks_count(spark, d):
    """Direct links and links through redirects, added up."""
    links, redirects = M.pagelinks(spark, d), M.redirect(spark, d)
    direct = links.select(F.col("pl_to").alias("page_id"))
    via = links.join(redirects, F.col("pl_to") == F.col("rd_from")).select(F.col("rd_to").alias("page_id"))
    return direct.unionAll(via).groupBy("page_id").agg(F.count("*").alias("backlinks"))


@query(with_model("templatelinks", then="select tl_title, cast(count(*) as bigint) as embedded from templatelinks group by tl_title"))
def embedded_count(spark, d):
    return M.templatelinks(spark, d).groupBy("tl_title").agg(F.count("*").alias("embedded"))


@query(with_model("page", "redirect", "pagelinks", then=RESOLVED + """
select r.pl_from, r.target, p.page_title as dab_title, b.pl_from is not null as links_back
from resolved r join page p on p.page_id = r.target and p.is_dab left join pagelinks b on b.pl_from = r.target and b.pl_to = r.pl_from"""))
def dab_links(spark, d):
    """Links to disambiguation pages and whether those link back."""
    return L.dab_links(M.pagelinks(spark, d), M.redirect(spark, d), M.page(spark, d))


@query(with_model("redirect", "pagelinks", then="select pl_from, pl_to from pagelinks join redirect on rd_from = pl_to and rd_to = pl_from"))
def self_redirects(spark, d):
    return L.self_redirects(M.pagelinks(spark, d), M.redirect(spark, d))


@query(with_model("redirect", then="select a.rd_from, a.rd_to as via, b.rd_to from redirect a join redirect b on a.rd_to = b.rd_from"))
def double_redirects(spark, d):
    return L.double_redirects(M.redirect(spark, d))


@query(with_model("page", "wantedlinks", then="select pl_to, cast(count(*) as bigint) as wanted from wantedlinks where not exists (select 1 from page where page_id = pl_to) group by pl_to"))
def red_links(spark, d):
    """Pages that do not exist, by how many pages want them."""
    return L.red_links(M.wantedlinks(spark, d, once=False), M.page(spark, d)).groupBy("pl_to").agg(F.count("*").alias("wanted"))


@query(with_model("page", "wantedlinks", then="""red as (select pl_from, pl_to from wantedlinks where pl_to not in (select page_id from page))
select substr(cast(pl_to as varchar), 1, 3) as prefix, cast(count(distinct pl_to) as bigint) as titles, min(pl_to) as example from red group by 1 order by titles desc, prefix limit 20"""))
def red_links_by_prefix(spark, d):
    """The twenty prefixes with the most missing titles."""
    red = L.red_links(M.wantedlinks(spark, d, once=False), M.page(spark, d)).withColumn("prefix", F.substring(F.col("pl_to").cast("string"), 1, 3))
    return red.groupBy("prefix").agg(F.countDistinct("pl_to").alias("titles"), F.min("pl_to").alias("example")).orderBy(F.desc("titles"), "prefix").limit(20)


@query(with_model("page", "pagelinks", then="""a as (select pl_from, pl_to as a from pagelinks join page on page_id = pl_to where is_dab),
b as (select pl_from, pl_to as b from pagelinks join page on page_id = pl_to where is_dab),
n as (select a, b, count(distinct a.pl_from) as n from a join b using (pl_from) where a <> b group by a, b)
select a, b, cast(n as bigint) as n, case when n <= 0 then 0 when n <= 1 then 1 when n <= 4 then 2 when n <= 18 then 3 else 4 end as score from n where n > 1"""))
def cocitation_score(spark, d):
    """Disambiguation pages cited together by two pages or more, with a score from 0 to 4."""
    dabs = M.page(spark, d).where("is_dab").select(F.col("page_id").alias("target"))
    return L.cocitation(M.pagelinks(spark, d), dabs).where("n > 1").withColumn("score", L.relatedness_score(F.col("n")))


@query(with_model("page", "redirect", "pagelinks", then=RESOLVED + """
select distinct o.pl_from as dab, o.target as topic from resolved o join page on page_id = o.pl_from and is_dab join resolved i on i.pl_from = o.target and i.target = o.pl_from where o.pl_from <> o.target"""))
def primary_topic(spark, d):
    return L.primary_topics(M.pagelinks(spark, d), M.redirect(spark, d), M.page(spark, d))


@query(with_model("templatelinks", "pagelinks", then="""outer_ as (select distinct tl_title, tl_from from templatelinks)
select tl_title, cast(count(distinct pl_to) as bigint) as reached from outer_ join pagelinks on pl_from = tl_from group by tl_title"""))
def template_path_links(spark, d):
    """How many pages are linked from pages with each template.

    A page's titles go with its links in one list and are parted where all links to a page meet, so that a task keeps only its own pages' titles.
    """
    t = M.templatelinks(spark, d).groupBy(F.col("tl_from").alias("pl_from")).agg(F.collect_list(F.struct("tl_title")).alias("titles"))
    led = M.pagelinks(spark, d, once=False).join(t, "pl_from").select("pl_to", "titles").repartition("pl_to")
    return led.select("pl_to", F.inline("titles")).distinct().groupBy("tl_title").agg(F.count("pl_to").alias("reached"))


@query(with_model("page", "redirect", then="""select t.page_id, t.page_title, cast(count(*) as bigint) as n, string_agg(r.page_title, '|' order by r.page_title) as redirects
from redirect join page t on t.page_id = rd_to join page r on r.page_id = rd_from group by t.page_id, t.page_title"""))
def redirects_by_target(spark, d):
    p = M.page(spark, d)
    src, dst = p.select(F.col("page_id").alias("rd_from"), F.col("page_title").alias("from_title")), p.select(F.col("page_id").alias("rd_to"), "page_title")
    return M.redirect(spark, d).join(src, "rd_from").join(dst, "rd_to").groupBy(F.col("rd_to").alias("page_id"), "page_title").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("from_title")), "|").alias("redirects"))


@query(with_model("page", "pagelinks", then="""src as (select page_id, split_part(page_title, '_(', 1) as prefix from page where is_dab),
cand as (select s.page_id as dab, p.page_id, p.page_title, p.page_len from src s join page p on split_part(p.page_title, '_(', 1) = s.prefix and p.page_id <> s.page_id and not p.is_redirect)
select dab, page_id, page_title, page_len from cand where not exists (select 1 from pagelinks where pl_from = dab and pl_to = page_id)"""))
def blue_link_suggest(spark, d):
    """Existing pages that start like a disambiguation page and are not linked from it."""
    p = M.page(spark, d).withColumn("prefix", titles.without_qualifier(F.col("page_title")))
    dabs = p.where("is_dab").select(F.col("page_id").alias("dab"), "prefix")
    cand = p.where("not is_redirect").join(dabs, "prefix").where("page_id <> dab").select("dab", "page_id", "page_title", "page_len")
    return cand.join(M.pagelinks(spark, d).select(F.col("pl_from").alias("dab"), F.col("pl_to").alias("page_id")), ["dab", "page_id"], "left_anti")


@query(with_model("page", "wantedlinks", then="""red as (select pl_to, count(*) as n, min(pl_from) as example from wantedlinks where pl_to not in (select page_id from page) group by pl_to)
select pl_to, cast(n as bigint) as n, example, cast(floor(log(n) / log(5) + 1e-9) as bigint) as grade from red"""))
def red_link_suggest(spark, d):
    """Wanted pages with an example and a grade by powers of five."""
    from ..operators.aggregates import log_gradation

    red = L.red_links(M.wantedlinks(spark, d, once=False), M.page(spark, d)).groupBy("pl_to").agg(F.count("*").alias("n"), F.min("pl_from").alias("example"))
    return red.withColumn("grade", log_gradation(F.col("n"), 5))


@query("""with spend as (select c_custkey, c_name, (select count(*) from orders where o_custkey = c_custkey) as orders, (select max(o_totalprice) from orders where o_custkey = c_custkey) as top from customer)
select c_custkey, c_name, cast(orders as bigint) as orders, top from spend""")
def scalar_subqueries(spark, d):
    """Correlated scalar subqueries as an aggregate and a left join."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("top"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F') and c_nationkey in (1, 3, 5)")
def semi_in(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.where(F.col("c_nationkey").isin(1, 3, 5)).join(o.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def anti_not_exists(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 100000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select s_suppkey from supplier where s_nationkey not in (select case when c_acctbal > 9900 then c_nationkey end from customer where c_acctbal > 9900)")
def not_in_null_aware(spark, d):
    """NOT IN, by whose rules a null among the keys would leave no row, as an anti-join and two counts, without a broadcast of the keys."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer").where("c_acctbal > 9900")
    keys = c.selectExpr("case when c_acctbal > 9900 then c_nationkey end as k")
    nulls, n = keys.agg(F.count_if(F.col("k").isNull())).scalar(), keys.agg(F.count("*")).scalar()
    return s.join(keys, F.col("s_nationkey") == F.col("k"), "left_anti").where((n == 0) | ((nulls == 0) & F.col("s_nationkey").isNotNull())).select("s_suppkey")


@query(with_model("page", "pagelinks", then="""select page_id, exists(select 1 from pagelinks where pl_to = page_id) as has_backlinks, exists(select 1 from pagelinks where pl_from = page_id) as has_links, is_dab as dab from page"""))
def exists_flags(spark, d):
    """EXISTS as output columns."""
    p, links = M.page(spark, d), M.pagelinks(spark, d)
    to, fr = links.select(F.col("pl_to").alias("page_id")).distinct().withColumn("a", F.lit(True)), links.select(F.col("pl_from").alias("page_id")).distinct().withColumn("b", F.lit(True))
    return p.join(to, "page_id", "left").join(fr, "page_id", "left").select("page_id", F.coalesce("a", F.lit(False)).alias("has_backlinks"), F.coalesce("b", F.lit(False)).alias("has_links"), F.col("is_dab").alias("dab"))


@query("select distinct c_custkey, s_suppkey from customer join supplier on (c_nationkey = s_nationkey and c_acctbal > 9000 and s_acctbal > 5000) or c_custkey = s_suppkey")
def or_join_as_union(spark, d):
    """A disjunctive join condition as the union of two equi-joins that share no pair, so that the many pairs themselves need no distinct: only keys of several nations could repeat one."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    pair = ["c_custkey", "s_suppkey"]
    rich = c.where("c_acctbal > 9000").select("c_custkey", F.col("c_nationkey").alias("nation")).distinct().where("nation is not null")
    able = s.where("s_acctbal > 5000").select("s_suppkey", F.col("s_nationkey").alias("nation")).distinct()
    several = rich.groupBy("c_custkey").agg(F.count("*").alias("n")).where("n > 1").select("c_custkey")
    # A nation has very many of both, so its customers are dealt to sixteen tasks, each with all of its suppliers.
    left = rich.withColumn("part", F.pmod(F.xxhash64("c_custkey"), F.lit(16)).cast("int"))
    right = able.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    plain = left.join(several, "c_custkey", "left_anti").join(right, ["nation", "part"]).select(pair)
    mixed = left.join(several, "c_custkey", "left_semi").join(right, ["nation", "part"]).select(pair).distinct()
    keys = c.select("c_custkey").distinct().join(s.select("s_suppkey").distinct(), F.col("c_custkey") == F.col("s_suppkey"))
    found = rich.join(able, (F.col("c_custkey") == F.col("s_suppkey")) & (rich.nation == able.nation), "left_semi").select("c_custkey")
    return plain.unionAll(mixed).unionAll(keys.join(found, "c_custkey", "left_anti").select(pair))


@query(with_model("page", "categorylinks", then="""select cl_to, cast(count(*) as bigint) as members, cast(count(*) filter (is_dab) as bigint) as dabs from categorylinks join page on page_id = cl_from group by cl_to"""))
def category_members(spark, d):
    """Category to page hop with a conditional count."""
    return M.categorylinks(spark, d).join(M.page(spark, d), F.col("cl_from") == F.col("page_id")).groupBy("cl_to").agg(F.count("*").alias("members"), F.count_if("is_dab").alias("dabs"))


@query(with_model("page", then="""select a.page_id as subject_id, b.page_id as talk_id, a.page_id | 1 as talk_key from page a join page b on (a.page_id | 1) = b.page_id where a.page_id <> b.page_id"""))
def talk_pairing(spark, d):
    """Subject and talk pages, paired by bit arithmetic on the number."""
    p = M.page(spark, d)
    a, b = p.select(F.col("page_id").alias("subject_id"), titles.talk_namespace(F.col("page_id")).alias("talk_key")), p.select(F.col("page_id").alias("talk_id"))
    return a.join(b, F.col("talk_key") == F.col("talk_id")).where("subject_id <> talk_id").select("subject_id", "talk_id", "talk_key")


@query(with_model("page", "redirect", "pagelinks", then=RESOLVED + """,
known as (select o.pl_from, o.target, p.page_title, p.page_len, row_number() over (partition by o.pl_from order by p.page_len desc, p.page_id) as rn from resolved o join page p on p.page_id = o.target)
select pl_from, target, page_title, page_len from known where rn = 1"""))
def longest_target(spark, d):
    """Of each page's resolved targets the longest."""
    p = M.page(spark, d)
    r = L.resolve_redirects(M.pagelinks(spark, d), M.redirect(spark, d), once=False).join(p.select("page_id", "page_len"), F.col("target") == F.col("page_id"))
    first = r.groupBy("pl_from").agg(F.min(F.struct(F.col("page_len").isNull().alias("no"), (-F.col("page_len")).alias("len"), "target")).alias("m")).select("pl_from", "m.target", "m.len")
    named = p.groupBy("page_id", "page_len").agg(F.min("page_title").alias("page_title"))  # one row, should a page come twice
    return first.join(named, (F.col("target") == F.col("page_id")) & F.col("len").eqNullSafe(-F.col("page_len"))).select("pl_from", "target", "page_title", "page_len")


@query("""with recursive chain(rd_from, rd_to, hops) as (select p_partkey, p_partkey - 1, 1 from part where p_size % 5 = 1
union all select c.rd_from, r.p_partkey - 1, c.hops + 1 from chain c join part r on r.p_partkey = c.rd_to and r.p_size % 5 = 1)
select rd_from, max_by(rd_to, hops) as final, cast(max(hops) as int) as hops from chain group by rd_from""")
def redirect_chains(spark, d):
    """The end of every redirect chain."""
    return L.redirect_ends(M.redirect(spark, d))
