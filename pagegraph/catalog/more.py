"""Further text, sort and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import markup as H
from ..functions import text as T
from ..functions import titles as N
from ..functions import urls as U
from ..operators import aggregates as A
from ..operators import intervals as I
from ..operators import predicates as P
from ..session import table
from ..sources import model as M
from ..sources.model import with_model
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query(r"select doc_id from documents where contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ', ' of the ')")
def fulltext_phrase(spark, d):
    """Documents with a phrase, by its words."""
    return table(spark, d, "documents").where(T.contains_phrase(F.col("text"), "of the")).select("doc_id")


@query(r"""with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from documents), h as (select doc_id, len(list_intersect(w, ['and', 'der', 'les', 'idiot'])) as hits from w) select doc_id, cast(hits as bigint) as hits from h where hits > 0""")
def fulltext_tokens(spark, d):
    """How many of some tokens a document holds."""
    return T.token_hits(table(spark, d, "documents"), "doc_id", "text", ["and", "der", "les", "idiot"])


@query("""select c_custkey, c_name from customer order by lower(c_name) = 'customer#000000007' desc, lower(c_name), c_custkey""")
def exact_title_first(spark, d):
    """An exact title first, then without regard to case."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.orderBy(F.desc(F.lower("c_name") == "customer#000000007"), F.lower("c_name"), "c_custkey")


@query("""select l_suppkey, cast(count(*) filter (l_returnflag = 'R') as bigint) as fixed, cast(count(*) as bigint) as links from lineitem group by l_suppkey order by count(*) filter (l_returnflag = 'R') / count(*) desc, l_suppkey limit 50""")
def ratio_sort(spark, d):
    """The fifty with the best ratio of fixed links."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("fixed"), F.count("*").alias("links"))
    return g.orderBy(F.desc(F.col("fixed") / F.col("links")), "l_suppkey").limit(50)


@query("""select c_custkey, 1900 + c_nationkey as birth, case when c_acctbal < 0 then 1980 + c_nationkey end as death, c_name as description from customer""")
def item_years(spark, d):
    """Years from an item's JSON claims."""
    nation = F.col("c_nationkey")

    def claim(base):
        return F.array(F.struct(F.concat(F.lit("+"), (nation + base).cast("string"), F.lit("-01-01T00:00:00Z")).alias("time")))

    claims = F.struct(claim(1900).alias("P569"), F.when(F.col("c_acctbal") < 0, claim(1980)).alias("P570"))
    c = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(claims.alias("claims"), F.col("c_name").alias("description"))).alias("j"))
    y = T.claim_years(F.col("j"))
    return c.select("c_custkey", y.alias("y")).select("c_custkey", "y.birth", "y.death", "y.description")


@query("""select c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' as json from customer""")
def json_rows(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.to_json(F.struct("c_custkey", "c_name")).alias("json"))


@query(with_model("page", then="""o as (select page_id, kind, lag(kind) over (partition by project order by page_id) as before, project from page) select page_id, project, kind from o where before is distinct from kind"""))
def group_headings(spark, d):
    """The pages at which a new heading begins in each project's list."""
    w = Window.partitionBy("project").orderBy("page_id")
    return M.page(spark, d).withColumn("before", F.lag("kind").over(w)).where(~F.col("before").eqNullSafe(F.col("kind"))).select("page_id", "project", "kind")


@query("""select o_orderkey, '<span class="autocomment">→' || o_orderpriority || '</span> see <a href="/wiki/' || o_custkey || '">' || o_custkey || '</a>' as html, 'see [[' || o_custkey || ']]' as plain from orders""")
def summary_links(spark, d):
    """Edit summaries in HTML, and without their section mark."""
    s = F.concat(F.lit("/* "), "o_orderpriority", F.lit(" */ see [["), F.col("o_custkey").cast("string"), F.lit("]]"))
    return table(spark, d, "orders").select("o_orderkey", T.summary_links(s).alias("html"), T.without_auto_sections(s).alias("plain"))


@query("""select e.event_id, case when s < 60 then s || ' second' || case when s = 1 then '' else 's' end when s < 3600 then (s // 60) || ' minute' || case when s // 60 = 1 then '' else 's' end when s < 86400 then (s // 3600) || ' hour' || case when s // 3600 = 1 then '' else 's' end else (s // 86400) || ' day' || case when s // 86400 = 1 then '' else 's' end end as ago
from (select event_id, date_diff('second', date_trunc('second', ts), timestamp '2024-02-01 00:00:00') as s from events) e""")
def time_ago(spark, d):
    return table(spark, d, "events").select("event_id", T.time_ago(F.date_trunc("second", "ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("ago"))


@query("""select s_suppkey, (s_suppkey % 90) || '_' || case when s_suppkey % 2 = 0 then 'N' else 'S' end || '_' || (s_suppkey % 180) || '.5_E_type:city' as params from supplier where s_suppkey % 90 > 0 or s_suppkey % 2 = 0""")
def coord_emit(spark, d):
    """Coordinates written as parameters."""
    k = F.col("s_suppkey")
    lat = (k % 90).cast("double") * F.when(k % 2 == 0, 1).otherwise(-1)
    s = table(spark, d, "supplier").where("s_suppkey % 90 > 0 or s_suppkey % 2 = 0")
    return s.select("s_suppkey", G.emit(lat, (k % 180) + F.lit(0.5), F.lit("city"), F.lit(None).cast("string")).alias("params"))


@query(with_model("coord", "region_box", then="""inside as (select gc_from, region from coord join region_box on gc_lon between x0 and x0 + 55 and gc_lat between y0 and y0 + 26),
cached as (select gc_lat, gc_lon, min(region) as region from coord join inside using (gc_from) group by 1, 2)
select gc_from, coalesce(case when gc_primary then gc_type end, c.region) as region from coord left join cached c using (gc_lat, gc_lon)"""))
def region_backfill(spark, d):
    """Missing regions filled from a cache of distinct points."""
    from ..operators.spatial import polygon_candidates

    c = M.coord(spark, d)
    points = c.groupBy("gc_lat", "gc_lon").agg(F.min("gc_from").alias("gc_from"))
    cache = polygon_candidates(points, M.region_box(spark, d)).groupBy("gc_lat", "gc_lon").agg(F.min("region").alias("found"))
    return c.join(cache, ["gc_lat", "gc_lon"], "left").select("gc_from", F.coalesce(F.when(F.col("gc_primary"), F.col("gc_type")), F.col("found")).alias("region"))


@query("""select event_id, user_id, event_type from (select *, row_number() over (partition by user_id order by md5(cast(event_id as varchar))) as rn from events) where rn <= 3""")
def sampled_per_user(spark, d):
    """Three events of each user, drawn by a hash: a sampling operator that can be repeated."""
    e = table(spark, d, "events").withColumn("h", F.md5(F.col("event_id").cast("string").cast("binary")))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("h"))).where("rn <= 3").select("event_id", "user_id", "event_type")


@query("""select n_nationkey, '#ff' || lower(printf('%02X', cast(round(255 * 2 * n_nationkey / 50.0) as int))) || '00' as colour from nation""")
def gradients(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.gradient(F.col("n_nationkey") / F.lit(50.0)).alias("colour"))


@query()
def html_text_diff(spark, d):
    """What a clean-up changes, line by line."""
    p = table(spark, d, "pages")
    return p.select("page_id", H.text_diff(F.col("html"), H.html_cleanup(F.col("html"))).alias("diff"))


@query()
def first_sentences(spark, d):
    """A short description from each page."""
    return table(spark, d, "pages").select("page_id", H.first_sentences(F.col("html")).alias("description"))


def _plain_sql(t: str) -> str:
    for old, new in N.SUBSTITUTIONS:
        t = "replace({}, '{}', '{}')".format(t, old.replace("'", "''"), new.replace("'", "''"))
    return t


@query(rf"""with t as (select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g')) as title from pages),
k as (select page_id, {_plain_sql("strip_accents(' ' || upper(replace(replace(split_part(title, ' (', 1), '_', ' '), 'ß', 'SS')) || ' ')")} as k from t where title <> ''),
p as (select page_id, translate(array_to_string(list_transform(range(1, length(k) + 1), lambda i: case when i = 1 or k[i] <> k[i - 1] then k[i] else '' end), ''), ' !"'',-.:;?', '') as key from k)
select key, cast(count(*) as bigint) as n from p group by key""")
def plain_keys(spark, d):
    """Keys that spellings of page titles share."""
    p = table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title")).where("title is not null")
    return p.select(N.plain_key(F.col("title")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("""select c_custkey, regexp_replace(c_name, '[0-9]+$', '') || lpad(regexp_extract(c_name, '([0-9]+)$', 1), 10, '0') as key from customer""")
def natural_order(spark, d):
    """A key by which numbers in names compare by value."""
    return table(spark, d, "customer").select("c_custkey", N.natural_key(F.col("c_name")).alias("key"))


@query("""with c as (select o_custkey, count(*) as n from orders group by 1), t as (select *, sum(n) over () as total, sum(n) over (order by n desc, o_custkey rows between unbounded preceding and current row) as run from c) select o_custkey, cast(n as bigint) as n, round(100.0::double * n / total, 6) as share from t where run <= total // 10""")
def running_share(spark, d):
    """The users that make the first tenth of all edits: counts first, then a running sum over the few that a bound on rank leaves."""
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    per = c.groupBy("n").agg(F.count("*").alias("users"), F.sum("n").alias("edits"))  # one row for each count
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    steps = per.select("n", F.coalesce(F.sum("edits").over(w), F.lit(0)).alias("above"))
    total = per.agg(F.sum("edits")).scalar()
    inside = c.join(steps, "n").withColumn("total", total).where("above < total div 10")
    placed = inside.withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy("o_custkey")))
    return placed.where("above + n * place <= total div 10").select("o_custkey", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))


@query("select c_mktsegment, cast(count(*) filter (c_acctbal < 0) as bigint) as debt, cast(count(*) filter (c_acctbal between 0 and 5000) as bigint) as some, cast(count(*) filter (c_acctbal > 5000) as bigint) as much from customer group by 1")
def rank_pivot(spark, d):
    """Counts by class as columns."""
    c = table(spark, d, "customer").withColumn("k", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") <= 5000, "some").otherwise("much"))
    p = c.groupBy("c_mktsegment").pivot("k", ["debt", "some", "much"]).count()
    return p.select("c_mktsegment", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("debt", "some", "much")])


@query("""select c_nationkey, cast(count(distinct c_mktsegment) as bigint) as kinds, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) as names from customer group by 1""")
def distinct_lists(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("kinds"), A.concat_distinct(F.col("c_mktsegment"), ", ").alias("names"))


@query("""select o_orderkey from orders where o_orderstatus = 'F' and not (o_totalprice < 50000) and o_orderpriority like '1-%' and list_contains(string_split(o_orderpriority || ',' || o_orderstatus, ','), 'F')""")
def built_predicates(spark, d):
    """Conditions added one by one, some negated, some left out."""
    o = table(spark, d, "orders").withColumn("tags", F.concat("o_orderpriority", F.lit(","), "o_orderstatus"))
    w = P.Where().option("F", lambda v: F.col("o_orderstatus") == v).add(F.col("o_totalprice") < 50000, negate=True).option(None, lambda v: F.col("o_custkey") == v)
    w.add(F.col("o_orderpriority").startswith("1-")).add(P.tagged("tags", "F"))
    return w.apply(o).select("o_orderkey")


@query("""with w as (select event_id as window_id, ts as a, ts + interval 2 hour as b from events where event_type = 'signup' and value > 95) select window_id, event_id from w join events on ts between a and b""")
def changes_in_windows(spark, d):
    """Events in windows of time of two hours, by stretches of three minutes."""
    e = table(spark, d, "events")
    w = e.where("event_type = 'signup' and value > 95").select(F.col("event_id").alias("window_id"), F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 2 hours")).alias("b"))
    return I.window_join(e.select("event_id", "ts"), w, "ts", "a", "b", minutes=3).select("window_id", "event_id")


@query(with_model("page", then="""select 'https://x.org/wiki/' || replace(replace(page_title, '#', '%23'), '?', '%3F') as url from page where is_dab"""))
def exported_urls(spark, d):
    """Disambiguation pages as URLs."""
    return M.page(spark, d).where("is_dab").select(F.concat(F.lit("https://x.org/wiki/"), U.encoded_title(F.col("page_title"))).alias("url"))



@query("""with p as (select page_id, page_id % 5 as k, '10.' || (1000 + page_id % 9000) || '/abc.def-' || (1000000 + page_id) as doi from pages)
select page_id, case when k in (0, 1, 2) then doi end as doi from p""")
def page_dois(spark, d):
    """DOIs of whole pages: in a field, in a link, in the text; two of them or none give none."""
    n, k = F.col("page_id"), F.col("page_id") % 5
    doi = F.concat(F.lit("10."), (1000 + n % 9000).cast("string"), F.lit("/abc.def-"), (1000000 + n).cast("string"))
    put = F.when(k == 0, F.concat(F.lit('<meta name="citation_doi" content="doi:'), doi, F.lit('">'))).when(k == 1, F.concat(F.lit('<a href="http://dx.doi.org/'), doi, F.lit('">x</a>'))).when(k == 2, F.concat(F.lit("<p>doi:"), doi, F.lit(" </p>")))
    put = put.when(k == 3, F.concat(F.lit("<p>doi:"), doi, F.lit(" doi:"), doi, F.lit("0 </p>"))).otherwise("")
    return table(spark, d, "pages").select("page_id", T.doi(F.concat(F.coalesce("html", F.lit("")), put)).alias("doi"))


@query(r"""with t as (select p_partkey, case p_partkey % 11 when 0 then p_name when 1 then p_name || '#x' when 2 then ':' || p_name when 3 then '../' || p_name when 4 then p_name || '%20' when 5 then p_name || ' &amp; co' when 6 then repeat(p_name, 60) when 7 then 'Undefined' when 8 then 'File_talk:' || p_name when 9 then p_name || '/..' else '' end as title from part)
select p_partkey, title, p_partkey % 11 = 0 and not starts_with(title, 'red') as allowed from t""")
def title_blacklist(spark, d):
    """Titles that are valid and on no blacklist."""
    n, k = F.col("p_name"), F.col("p_partkey") % 11
    made = [n, F.concat(n, F.lit("#x")), F.concat(F.lit(":"), n), F.concat(F.lit("../"), n), F.concat(n, F.lit("%20")), F.concat(n, F.lit(" &amp; co")), F.repeat(n, F.lit(60)), F.lit("Undefined"), F.concat(F.lit("File_talk:"), n), F.concat(n, F.lit("/..")), F.lit("")]
    title = F.lit(None).cast("string")
    for i, c in enumerate(made):
        title = F.when(k == i, c).otherwise(title)
    rows = table(spark, d, "part").select("p_partkey", title.alias("title"))
    return rows.withColumn("allowed", N.allowed_title(F.col("title"), [r"^(?i:undefined|null)$", r"_talk:", r"^red"]))


@query("""with f as (select l_orderkey, l_linenumber, cast(round(l_extendedprice * 1000) as bigint) as size, cast(l_quantity * 40 as bigint) as w, cast(l_quantity * 30 as bigint) as h, l_returnflag as k, 8 as bits, case when l_linestatus = 'O' then 3 else 4 end as c from lineitem)
select l_orderkey, l_linenumber, size, case k when 'A' then 'jpeg' when 'N' then 'png' else 'gif' end as kind from f where (k = 'A' and size > 3 * w * h + 10485760) or (k = 'N' and size > 1.10::double * (10485760 + w * h * bits / 8 * c))""")
def oversized_media(spark, d):
    """Files with many more bytes than their pixels need, by kind."""
    q, k = F.col("l_quantity"), F.col("l_returnflag")
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 1000).cast("bigint").alias("size"), (q * 40).cast("bigint").alias("w"), (q * 30).cast("bigint").alias("h"), F.when(k == "A", "jpeg").when(k == "N", "png").otherwise("gif").alias("kind"), F.when(F.col("l_linestatus") == "O", 3).otherwise(4).alias("c"))
    return f.where(P.oversized(F.col("size"), F.col("w"), F.col("h"), F.col("kind"), F.lit(8), F.col("c"))).select("l_orderkey", "l_linenumber", "size", "kind")


@query(r"""with t as (select doc_id, regexp_replace(text, '([^\n]+)', '<!--\1-->\1', 'g') as t from documents)
select doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: case when starts_with(x, '<!--') and strpos(x, '-->') - 5 >= 250 then substr(x, strpos(x, '-->') + 3) else x end), chr(10)) as kept from t""")
def long_hidden_comments(spark, d):
    """Whole texts whose lines stand in comments before them; comments of 250 characters or more go."""
    t = F.regexp_replace("text", r"([^\n]+)", "<!--$1-->$1")
    return table(spark, d, "documents").select("doc_id", T.long_comments(t).alias("kept"))
