"""Reader and sink queries: tables written as files of the formats in the shared folder and read back, and functions over whole texts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as H
from ..functions import text as T
from ..functions import titles as N
from ..functions import urls as U
from ..session import ready_checkpoints, table, taken
from ..sources import model as M
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.model import with_model
from .base import Catalogue, rewritten, rewritten_sql

catalogue = Catalogue()
query = catalogue.query


def _folder(spark) -> str:
    ready_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query(r"""select o_orderkey, case when o_custkey % 3 > 0 then o_orderpriority || case o_custkey % 4 when 0 then chr(9) || 'tab' when 1 then '\back' when 2 then '' else ' "quote"' end end as remark, o_totalprice > 100000 as dear, length(o_orderpriority) as n from orders""")
def tsv_round_trip(spark, d):
    """Tab-separated rows with nulls, tabs, backslashes and quotes, written and loaded, with a computed column."""
    path, o = _folder(spark), table(spark, d, "orders")
    k = F.col("o_custkey") % 4
    remark = F.concat("o_orderpriority", F.when(k == 0, "\ttab").when(k == 1, "\\back").when(k == 2, "").otherwise(' "quote"'))
    K.write_tsv(o.select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, remark).alias("remark"), "o_totalprice", "o_orderpriority"), path)
    back = R.read_tsv(spark, path, "o_orderkey bigint, remark string, o_totalprice double, o_orderpriority string", sets={"dear": "o_totalprice > 100000", "n": "cast(length(o_orderpriority) as bigint)"})
    return taken(back.select("o_orderkey", "remark", "dear", "n"), path)


_HARD = "chr(9) || chr(10) || chr(13) || chr(8) || chr(22) || '\\' || chr(9) || '\\N\\t'"


@query(f"""select doc_id, md5(coalesce(text, '-')) as first, md5({_HARD} || coalesce(text, '')) as middle, md5(case when doc_id % 3 > 0 then coalesce(text, '') || {_HARD} || case doc_id % 4 when 0 then '\\' when 1 then chr(9) when 2 then chr(10) else '' end else 'null' end) as last from documents""")
def tsv_texts(spark, d):
    """Whole texts, with every byte that needs an escape put in, as the first, a middle and the last field of a line."""
    path, t = _folder(spark), F.col("text")
    hard = F.lit("\t\n\r\b\x16\\\t\\N\\t")
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, "\\").when(k == 1, "\t").when(k == 2, "\n").otherwise("")
    text = F.coalesce(t, F.lit(""))
    K.write_tsv(table(spark, d, "documents").select(t.alias("first"), F.concat(hard, text).alias("middle"), "doc_id", F.when(F.col("doc_id") % 3 > 0, F.concat(text, hard, tail)).alias("last")), path, compression="gzip")
    back = R.read_tsv(spark, path, "first string, middle string, doc_id bigint, last string")
    return taken(back.select("doc_id", F.md5(F.coalesce("first", F.lit("-"))).alias("first"), F.md5("middle").alias("middle"), F.md5(F.coalesce("last", F.lit("null"))).alias("last")), path)


@query("""select o_custkey, cast(count(*) as bigint) as orders, min(o_totalprice) as least, string_agg(o_orderstatus, '' order by o_orderkey) as states from orders group by o_custkey""")
def json_round_trip(spark, d):
    """Nested records, one object a line, written and read."""
    path = _folder(spark)
    few = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))).alias("orders"))  # a customer's orders
    K.write_json(few, path)
    back = spark.read.schema(few.schema).json(path)
    return taken(back.select("o_custkey", F.size("orders").cast("long").alias("orders"), F.array_min(F.col("orders.o_totalprice")).alias("least"), F.array_join("orders.o_orderstatus", "").alias("states")), path)


@query("""select 'ok' as kind, p_brand || ' ' || replace(p_name, ' ', '_') as line, cast(p_size as bigint) as views from part where p_partkey % 5 < 3 union all
select 'bad', p_brand || ' ' || p_name || ' x ' || p_size, null from part where p_partkey % 5 = 3 union all select 'bad', replace(p_name, ' ', '_') || ' ' || p_size, null from part where p_partkey % 5 = 4""")
def pagecount_files(spark, d):
    """Page-count logs, gzipped, and their malformed lines."""
    path, p = _folder(spark), table(spark, d, "part")
    k, name = F.col("p_partkey") % 5, F.replace("p_name", F.lit(" "), F.lit("_"))
    good = F.concat_ws(" ", "p_brand", name, F.col("p_size").cast("string"), F.lit("100"))
    line = F.when(k < 3, good).when(k == 3, F.concat("p_brand", F.lit(" "), "p_name", F.lit(" x "), F.col("p_size").cast("string"))).otherwise(F.concat_ws(" ", name, F.col("p_size").cast("string")))
    p.select(line.alias("value")).write.option("compression", "gzip").text(path)
    rows, bad = R.read_pagecounts(spark, path)
    return taken(rows.select(F.lit("ok").alias("kind"), F.concat_ws(" ", "project", "title").alias("line"), "views").unionAll(bad.select(F.lit("bad"), "value", F.lit(None).cast("long"))), path)


@query("""select 'T ' || doc_id as title, cast(doc_id % 3 as int) as ns, doc_id as page_id, cast(length(text) as bigint) as n from documents where doc_id % 3 < 2""")
def xml_dump(spark, d):
    """An XML dump of pages with whole texts, two of three namespaces kept while scanning."""
    path, doc = _folder(spark), table(spark, d, "documents")
    page = doc.select(F.concat(F.lit("T "), F.col("doc_id").cast("string")).alias("title"), (F.col("doc_id") % 3).cast("int").alias("ns"), F.col("doc_id").alias("id"), F.struct(F.concat(F.lit("|"), "text", F.lit("|")).alias("text")).alias("revision"))
    page.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    back = R.read_xml_dump(spark, path, F.col("ns") < 2)
    return taken(back.select("title", "ns", "page_id", (F.length("text") - 2).cast("long").alias("n")), path)


@query("""select strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') as stamp, cast(user_id as varchar) as who, event_type as what from events where event_type <> 'error' order by 1 desc, 2, 3""")
def log_lines(spark, d):
    """Fields of matching log lines, the newest first."""
    path = _folder(spark)
    e = table(spark, d, "events")
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] user="), F.col("user_id").cast("string"), F.when(F.col("event_type") == "error", " failed ").otherwise(" did "), "event_type")
    K.write_lines(e, path, line)
    return taken(R.read_log(spark, path, r"^\[([^\]]+)\] user=(\d+) did (\w+)$", ["stamp", "who", "what"]), path).orderBy(F.desc("stamp"), "who", "what")


@query("""select url, cast(page_id as varchar) as refId, cast(length(html) as varchar) as context, case when page_id % 2 = 0 then '200' else '404' end as status, case when page_id % 2 = 0 then null else 'Not Found' end as reason from pages where url is not null""")
def link_cache(spark, d):
    """The cache of checked links, ten fields a line."""
    path, p = _folder(spark), table(spark, d, "pages").where("url is not null")
    ok = F.col("page_id") % 2 == 0
    K.write_tsv(p.select("url", "page_id", F.length("html"), F.when(ok, "200").otherwise("404").alias("s"), F.when(~ok, "Not Found").alias("r"), *[F.lit("").alias(x) for x in "abcde"]), path)
    return taken(R.read_link_cache(spark, path).select("url", "refId", "context", "status", "reason"), path)


@query("""select s_suppkey % 3 = 0 as archived, cast(s_suppkey as varchar) as webcite_id, 'http://x.org/?a=' || s_suppkey || '&b=<' as original_url from supplier""")
def archive_results(spark, d):
    """Archive results as XML elements."""
    path, k = _folder(spark), F.col("s_suppkey").cast("string")
    rows = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "success").otherwise("failure").alias("status"), k.alias("webcite_id"), F.concat(F.lit("http://x.org/?a="), k, F.lit("&b=<")).alias("original_url"))
    rows.write.format("xml").option("rootTag", "resultset").option("rowTag", "result").save(path)
    return taken(R.read_results_xml(spark, path).select((F.col("status") == "success").alias("archived"), "webcite_id", "original_url"), path)


@query("""with s as (select page_id, unnest([page_id, page_id + 1]) as k from pages) select page_id, '2010' || lpad(cast(k as varchar), 10, '0') as stamp from s""")
def archive_listing(spark, d):
    """Timestamps of archived copies in listings."""
    def link(k):
        return F.concat(F.lit('<a href="/web/2010'), F.lpad(k.cast("string"), 10, "0"), F.lit('/http://x.org/">x</a> /web/12/ '))

    p = table(spark, d, "pages").select("page_id", F.concat(link(F.col("page_id")), F.coalesce("html", F.lit("")), link(F.col("page_id") + 1)).alias("html"))
    return R.archive_copies(p).select("page_id", "stamp")


@query(with_model("page", then="""select page_id, '{"page_id":' || page_id || ',"title":"' || page_title || '"}' as json, 'f({"page_id":' || page_id || ',"title":"' || page_title || '"})' as jsonp, page_title as title from page"""))
def result_formats(spark, d):
    """Rows as JSON, as a call with JSON, and as XML read back."""
    p = M.page(spark, d).select("page_id", F.col("page_title").alias("title"))
    xml = F.from_xml(F.to_xml(F.struct("page_id", "title"), {"rowTag": "row"}), "page_id long, title string", {"rowTag": "row"})
    jsonp = K.as_json(p, "jsonp", callback="f").withColumn("page_id", F.regexp_extract("jsonp", r"([0-9]+)", 1).cast("long"))
    return p.select("page_id", F.to_json(F.struct("page_id", "title")).alias("json"), xml["title"].alias("title")).join(jsonp, "page_id")


@query("""select c_nationkey, cast(count(*) as bigint) as n from customer group by c_nationkey""")
def table_swap(spark, d):
    """A table rebuilt under its name, twice; the second is read."""
    ready_checkpoints(spark)
    name = f"swap_{uuid.uuid4().hex[:12]}_t"
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    K.rebuild(spark, c.limit(1), name)
    K.rebuild(spark, c, name)
    out = spark.table(name).checkpoint()
    K.drop_rebuilt(spark, name)
    return out


@query("select l_suppkey, cast(count(*) as bigint) as n, sum(l_quantity) as quantity from lineitem group by l_suppkey")
def clustered_table(spark, d):
    """A table bucketed and sorted by a key and grouped by it without a shuffle."""
    ready_checkpoints(spark)
    name = f"clustered_{uuid.uuid4().hex[:12]}"
    K.clustered(table(spark, d, "lineitem").select("l_suppkey", "l_quantity"), name, "l_suppkey")
    out = spark.table(name).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).checkpoint()
    spark.sql(f"drop table {name}")
    return out


@query("""select 'f' || min(page_id % 16 + 10) as first, cast(count(*) as bigint) as n from pages where contains('http://x.org/' || page_id || '/', '7/')""")
def first_file(spark, d):
    """The first of sixteen files by name that holds a line with some text, and how many lines hold it."""
    path, p = _folder(spark), table(spark, d, "pages")
    line = F.concat(F.lit("http://x.org/"), F.col("page_id").cast("string"), F.lit("/"))
    p.select(line.alias("value"), F.concat(F.lit("f"), (F.col("page_id") % 16 + 10).cast("string")).alias("name")).write.partitionBy("name").text(path)
    file = R.first_file_with(spark, path, "7/").select(F.nullif(F.regexp_extract("file", "name=([a-z0-9]+)", 1), F.lit("")).alias("first"))
    return taken(file.withColumn("n", spark.read.text(path).where(F.contains("value", F.lit("7/"))).agg(F.count("*")).scalar()), path)


@query("""select 'orders_' || lower(o_orderstatus) as name, case when o_orderstatus <> 'P' then 'owner of ' || o_orderstatus end as owner, true as stored, false as stale, o_orderstatus = 'P' as orphan, false as missing from (select distinct o_orderstatus from orders) union all select 'gone', 'nobody', false, false, false, true""")
def table_report(spark, d):
    """Tables written by this query, one for each status of orders, beside a registry that lacks one and has one too many."""
    path, o = _folder(spark), table(spark, d, "orders")
    o.withColumn("t", F.concat(F.lit("orders_"), F.lower("o_orderstatus"))).write.partitionBy("t").parquet(f"{path}/tables")
    registry = o.select("o_orderstatus").distinct().where("o_orderstatus <> 'P'").select(F.concat(F.lit("orders_"), F.lower("o_orderstatus")).alias("name"), F.concat(F.lit("owner of "), "o_orderstatus").alias("owner"))
    registry = registry.unionByName(spark.createDataFrame([("gone", "nobody")], "name string, owner string"))
    stored = R.stored_tables(spark, f"{path}/tables").withColumn("name", F.regexp_replace("name", "^t=", ""))
    return taken(R.table_report(stored, registry).select("name", "owner", (F.col("bytes") > 0).alias("stored"), "stale", "orphan", "missing"), path)


# ----------------------------------------------------------------- selectors, parameters, sets


@query(with_model("page", "categorylinks", "pagelinks", "templatelinks", then="""picked as (select 'category' as kind, cl_from as id from categorylinks where cl_to = '1905_births' union select 'backlinks', pl_from from pagelinks where pl_to = 3 union select 'links', pl_to from pagelinks where pl_from = 5 union select 'embedded', tl_from from templatelinks where tl_title = 'AF'
  union select 'prefix', page_id from page where page_title like 'Topic\\_1\\_%' escape '\\' union (select 'newest', page_id from page order by page_id desc limit 7)
  union select 'weblink', page_id from pages where url like 'http%/a%' union select 'contribs', l_partkey from lineitem where l_suppkey = 4 union select 'file', page_id from page where page_title like '%5)')
select picked.kind, page_id, page_title from page join picked on page_id = id"""))
def page_selectors(spark, d):
    """Page sets by category, backlinks, links, template, prefix, age, external links, contributions and a list in a file."""
    p, links, path = M.page(spark, d), M.pagelinks(spark, d), _folder(spark)
    p.where(F.col("page_title").endswith("5)")).select(F.concat(F.lit("* [["), "page_title", F.lit("|x]] and [[no such page]] [["), "page_title", F.lit("]]")).alias("value")).write.text(path)
    sites = table(spark, d, "pages").select(F.col("page_id").alias("el_from"), F.col("url").alias("el_to"))
    edits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("rev_page"), F.col("l_suppkey").alias("rev_user"))
    sets = {
        "category": R.select_pages("category", p, M.categorylinks(spark, d), "1905_births"), "backlinks": R.select_pages("backlinks", p, links, 3), "links": R.select_pages("links_of", p, links, 5),
        "embedded": R.select_pages("embeddedin", p, M.templatelinks(spark, d), "AF"), "prefix": R.select_pages("prefixindex", p, "Topic_1_"), "newest": R.select_pages("newest", p, 7),
        "weblink": R.select_pages("weblink", p, sites, "http%/a%"), "contribs": R.select_pages("contribs", p, edits, 4), "file": R.select_pages("from_file", spark, p, path),
    }
    parts = [s.select(F.lit(k).alias("kind"), "page_id", "page_title") for k, s in sets.items()]
    return taken(reduce(DataFrame.unionAll, parts), path)


@query(with_model("page", "categorylinks", "pagelinks", then="""picked as (select cl_from as id from categorylinks where cl_to = '1905_births' union select pl_from from pagelinks where pl_to = 3 union (select page_id from page order by page_id desc limit 7))
select page_id, page_title from page where page_id in (select id from picked)"""))
def page_sets_in_one(spark, d):
    """Several page sets in one, each page once."""
    p = M.page(spark, d)
    sets = [R.select_pages("category", p, M.categorylinks(spark, d), "1905_births"), R.select_pages("backlinks", p, M.pagelinks(spark, d), 3), R.select_pages("newest", p, 7)]
    return R.combined(*sets).select("page_id", "page_title")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_custkey in (1, 4, 7, 10) and o_orderpriority <> 'it''s'")
def parameterised(spark, d):
    """SQL with named parameters and a list, over a table given by reference."""
    sql = "select o_orderkey, o_totalprice from {orders} where o_orderstatus = :status and array_contains(:keys, o_custkey) and o_orderpriority <> :other"
    return spark.sql(sql, args={"status": "F", "keys": F.array(*map(F.lit, (1, 4, 7, 10))), "other": "it's"}, orders=table(spark, d, "orders"))


@query("""select name from (select c_name as name from customer order by c_acctbal desc, c_custkey limit 10) union select name from (select s_name as name from supplier order by s_acctbal desc, s_suppkey limit 10) union select name from (select c_name as name from customer order by c_custkey limit 10)""")
def limited_union(spark, d):
    """The union of branches that each have a limit."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    rich, first = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10), c.orderBy("c_custkey").limit(10)
    return rich.select(F.col("c_name").alias("name")).union(s.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select("s_name")).union(first.select("c_name")).distinct()


@query("""with t as (select p_partkey, case p_partkey % 4 when 0 then 'The_' || p_name when 1 then 'A_' || p_name when 2 then replace(p_name, ' ', '_&_') else replace(p_name, ' ', '_and_') end as t from part),
b as (select p_partkey, t, case when starts_with(t, 'The_') then t[5:] when starts_with(t, 'A_') then t[3:] else t end as bare from t)
select p_partkey, unnest(list_distinct([t, bare, 'The_' || bare, 'A_' || bare, replace(bare, '_&_', '_and_'), replace(bare, '_and_', '_&_')])) as prefix from b""")
def prefix_algebra(spark, d):
    """The set of prefixes a title is looked up by: with and without articles, with either form of `and`."""
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    t = F.when(k == 0, F.concat(F.lit("The_"), n)).when(k == 1, F.concat(F.lit("A_"), n)).when(k == 2, F.replace(n, F.lit(" "), F.lit("_&_"))).otherwise(F.replace(n, F.lit(" "), F.lit("_and_")))
    return table(spark, d, "part").select("p_partkey", F.explode(N.prefixes(t)).alias("prefix"))


# ----------------------------------------------------------------- functions over whole texts


@query("""with t as (select doc_id, regexp_replace(text, '[._]', '-', 'g') as t from documents) select doc_id, replace(replace(replace(url_encode(replace(t, ' ', '_')), '~', '%7E'), '%3A', ':'), '%', '.') as anchor, t as back from t""")
def anchors(spark, d):
    """Section anchors of whole texts, and back."""
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[._]", "-").alias("t"))
    return t.select("doc_id", U.anchor(F.col("t")).alias("anchor"), U.unanchor(U.anchor(F.col("t"))).alias("back"))


_ENTITIES = [(r"([ \n])([A-Z][a-z]+) ", "\\1<\\2 & '\"> "), (r", ", " &amp; &lt;")]


@query(rf"""with t as (select doc_id, {rewritten_sql("text", _ENTITIES)} as t from documents) select doc_id, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as encoded, t as back, replace(replace(t, '&lt;', '<'), '&amp;', '&') as decoded from t""")
def entities(spark, d):
    """Whole texts with entities encoded, and decoded by two ways."""
    t = rewritten(F.col("text"), _ENTITIES)
    return table(spark, d, "documents").select("doc_id", N.encode_entities(t).alias("encoded"), H.unescape(N.encode_entities(t)).alias("back"), N.decode_entities(t).alias("decoded"))


@query(r"""with t as (select doc_id, regexp_replace(text, '([aeiou])', '\1''\\_%', 'g') as t from documents) select doc_id, '''' || replace(replace(replace(t, '\', '\\'), '''', '\'''), chr(10), '\n') || '''' as quoted, replace(replace(replace(t, '\', '\\'), '%', '\%'), '_', '\_') as pattern, regexp_replace(t, '[^A-Za-z0-9._]', '', 'g') as name from t""")
def escapes(spark, d):
    """Whole texts as string literals, as LIKE patterns and as safe names."""
    t = F.regexp_replace("text", "([aeiou])", r"$1'\\_%").alias("t")
    return table(spark, d, "documents").select("doc_id", t).select("doc_id", T.quoted(F.col("t")).alias("quoted"), U.like_escape(F.col("t")).alias("pattern"), U.safe_name(F.col("t")).alias("name"))


@query(with_model("page", then=r"""select page_id, '[' || upper(page_title[1]) || lower(page_title[1]) || ']' || regexp_replace(regexp_replace(page_title[2:], '([\\.\[\]{}()*+?^$|])', '\\\1', 'g'), '[ _]+', '[ _]+', 'g') as pattern, true as fits, false as other from page"""))
def title_patterns(spark, d):
    """Patterns for links to a title; each fits the title with blanks and a small first letter, and not the title with a letter more before it."""
    t = F.col("page_title")
    spoken = F.concat(F.lower(F.substring(t, 1, 1)), F.replace(F.substring(t, 2, 1 << 30), F.lit("_"), F.lit(" ")))
    p = M.page(spark, d).select("page_id", N.title_regex(t).alias("pattern"), spoken.alias("spoken"))
    return p.select("page_id", "pattern", F.expr("spoken rlike concat('^', pattern, '$')").alias("fits"), F.expr("concat('x', spoken) rlike concat('^', pattern, '$')").alias("other"))


@query(rf"""with t as (select doc_id, regexp_replace(text, ' (th[a-z]+) ', ' <!-- \1 --><nowiki>\1</nowiki>\1 ', 'g') as t from documents), p as (select doc_id, t, instr(t, 'nowiki') as spot from t)
select doc_id, cast(spot as bigint) as spot, true as inside, false as first from p where spot > 0""")
def disabled_places(spark, d):
    """Whether a place lies in a disabled part: just inside the first nowiki, and at the text's start."""
    t = F.regexp_replace("text", " (th[a-z]+) ", " <!-- $1 --><nowiki>$1</nowiki>$1 ")
    rows = table(spark, d, "documents").select("doc_id", t.alias("t")).withColumn("spot", F.instr("t", "nowiki").cast("long")).where("spot > 0")
    return rows.select("doc_id", "spot", H.is_disabled(F.col("t"), (F.col("spot") + 6).cast("int")).alias("inside"), H.is_disabled(F.col("t"), F.lit(0)).alias("first"))


@query("select doc_id, text from documents")
def charsets(spark, d):
    """Whole texts from bytes: UTF-8 found by trial, by a header, UTF-16 by its mark, and by a meta element's claim Latin-1, or UTF-8 where a text has other characters."""
    t, k = F.col("text"), F.col("doc_id") % 4
    latin = ~t.rlike("[^\\x00-\\xFF]")
    claimed = F.when(latin, F.encode(F.concat(F.lit("<meta charset=iso-8859-1>"), t), "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit("<meta charset=utf-8>     "), t), "UTF-8"))
    body = F.when(k < 2, F.encode(t, "UTF-8")).when(k == 2, F.encode(t, "UTF-16")).otherwise(claimed)
    got = H.detected_text(body, F.when(k == 1, "text/html; charset=utf-8").otherwise(""))
    return table(spark, d, "documents").select("doc_id", F.when(k == 3, F.substring(got, 26, 1 << 30)).otherwise(got).alias("text"))


@query(r"""with c as (select page_id, cast(len(regexp_extract_all(html, '<li><a\b')) as bigint) as n, cast(len(regexp_extract_all(html, '<ul\b')) as bigint) as lists from pages) select page_id, n as linked_items, lists from c where n > 0""")
def soup_search(spark, d):
    """Links that are children of list items, and the lists above these items."""
    nodes = H.node_rows(table(spark, d, "pages"))
    items = H.find_all(nodes, "li")
    links = H.find_all(H.children(nodes, items), "a", "href").groupBy("page_id").agg(F.count("*").alias("linked_items"))
    lists = H.find_all(H.parents(nodes, items), "ul").groupBy("page_id").agg(F.count("*").alias("lists"))
    return links.join(lists, "page_id")


@query(r"""select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<script>.*?</script>', '', 'g'), '<b>', '', 'g') as html from pages where not contains(html, '</b>')""")
def soup_without(spark, d):
    """Whole pages with navigation and scripts cut out."""
    pages = table(spark, d, "pages").where(~F.contains("html", F.lit("</b>"))).withColumn("html", F.replace("html", F.lit("<b>"), F.lit("")))
    return H.without_nodes(pages, ["nav", "script"]).select("page_id", "html")
