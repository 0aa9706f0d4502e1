"""Scalar-function queries: strings, numbers, dates, URLs, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles as N
from ..functions import urls as U
from ..session import table
from ..sources import model as M
from ..sources.model import with_model
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query(r"""select p_partkey, upper(p_name) as up, lower(p_name) as low, replace(p_name, ' ', '_') as under, left(p_name, 4) as head, substr(p_name, 3) as tail, trim(both 'a' from p_name) as trimmed, cast(strlen(p_name) as bigint) as bytes, reverse(p_name) as turned,
split_part(p_name, ' ', 1) as first, cast(instr(p_name, 'e') as bigint) as e_at, regexp_replace(p_name, '([a-z])([a-z]*)', '\2\1', 'g') as swapped, md5(p_name) as digest, upper(hex(p_name)) as hexed from part""")
def string_functions(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.lower(n).alias("low"), F.replace(n, F.lit(" "), F.lit("_")).alias("under"), F.left(n, F.lit(4)).alias("head"), F.substring(n, 3, 1 << 30).alias("tail"), F.expr("trim(both 'a' from p_name)").alias("trimmed"),
        F.octet_length(n).cast("long").alias("bytes"), F.reverse(n).alias("turned"), F.substring_index(n, " ", 1).alias("first"), F.instr(n, "e").cast("long").alias("e_at"), F.regexp_replace(n, "([a-z])([a-z]*)", "$2$1").alias("swapped"), F.md5(n.cast("binary")).alias("digest"), F.hex(n).alias("hexed"),
    )


@query("""select l_orderkey, l_linenumber, cast(floor(l_extendedprice) as bigint) as low, cast(ceil(l_extendedprice) as bigint) as high, round(ln(l_quantity), 9) as ln, round(log2(l_quantity), 9) as log2, round(log10(l_quantity), 9) as log10, round(log(l_quantity) / log(5), 9) as log5, round(l_extendedprice / 7, 3) as part, least(l_quantity, l_discount * 100) as least, l_partkey % 7 as rest, l_partkey // 7 as whole from lineitem""")
def math_functions(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(p).alias("low"), F.ceil(p).alias("high"), F.round(F.ln(q), 9).alias("ln"), F.round(F.log2(q), 9).alias("log2"), F.round(F.log10(q), 9).alias("log10"), F.round(F.log10(q) / F.log10(F.lit(5.0)), 9).alias("log5"), F.round(p / 7, 3).alias("part"),
        F.least(q, F.col("l_discount") * 100).alias("least"), (F.col("l_partkey") % 7).alias("rest"), F.expr("l_partkey div 7").alias("whole"),
    )


@query("""select o_orderkey, strftime(o_orderdate, '%b %Y') as month, strftime(o_orderdate, '%Y%m%d%H%M%S') as stamp, cast(o_orderdate as date) as day, date_diff('day', timestamp '1992-01-01', o_orderdate) as since, cast(epoch(o_orderdate) as bigint) as unix, o_orderdate + interval 32 hour as due, strptime(strftime(o_orderdate, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') as back, cast(year(o_orderdate) as int) as year from orders""")
def date_functions(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format(t, "MMM yyyy").alias("month"), F.date_format(t, "yyyyMMddHHmmss").alias("stamp"), F.to_date(t).alias("day"), F.expr("datediff(o_orderdate, date'1992-01-01')").cast("long").alias("since"), F.unix_timestamp(t).alias("unix"), (t + F.expr("interval 32 hours")).alias("due"),
        F.expr("to_timestamp_ntz(date_format(o_orderdate, 'yyyyMMddHHmmss'), 'yyyyMMddHHmmss')").alias("back"), F.year(t).alias("year"),
    )


@query("""select o_orderkey, case when o_totalprice > 250000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band, coalesce(nullif(o_orderstatus, 'F'), 'done') as status, o_orderpriority like '1-%' as urgent, o_orderpriority not like '%LOW%' as not_low, o_custkey in (1, 2, 3) as known, regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$') as plain, o_totalprice between 1000 and 50000 as small, try_cast(substr(o_orderpriority, 1, 1) as int) as grade from orders""")
def predicates(spark, d):
    p, o = F.col("o_totalprice"), F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(p > 250000, "high").when(p > 100000, "mid").otherwise("low").alias("band"), F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("done")).alias("status"), o.startswith("1-").alias("urgent"), (~o.like("%LOW%")).alias("not_low"), F.col("o_custkey").isin(1, 2, 3).alias("known"),
        o.rlike("^[0-9]-[A-Z]+$").alias("plain"), p.between(1000, 50000).alias("small"), F.substring(o, 1, 1).try_cast("int").alias("grade"),
    )


@query("select p_partkey, p_name from part where p_name like any (values ('%green%'), ('a%'), ('%y'))".replace("like any (values ('%green%'), ('a%'), ('%y'))", "like '%an%' or p_name like 's%' or p_name like '%e'"))
def like_any(spark, d):
    """Many patterns at once."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.where(F.expr("p_name like any ('%an%', 's%', '%e')"))


@query(r"""with u as (select page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1) as rest from pages)
select page_id, host, case when scheme <> '' then scheme || array_to_string(list_reverse(string_split(host, '.')), '.') || '.' || rest end as reversed from u""")
def url_host_reversed(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.host(u).alias("host"), U.reversed_host(u).alias("reversed"))


@query(r"""with q as (select page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) as p from pages)
select page_id, split_part(p, '=', 1) as key, case when contains(p, '=') then regexp_replace(p, '^[^=]*=', '') else '' end as value from q where p <> ''""")
def url_params(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(U.query_parameters(F.col("url"))).alias("p")).select("page_id", "p.key", "p.value")


@query(r"""select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '(?i)([?&])(?:utm_[a-z]+|fbclid|gclid|ref)=[^&#]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+(#|$)', '\1', 'g') as clean from pages""")
def tracking_stripped(spark, d):
    return table(spark, d, "pages").select("page_id", U.without_tracking(F.col("url")).alias("clean"))


@query(with_model("page", then=r"""select page_id, upper(substr(t, 1, 1)) || substr(t, 2) as title from (select page_id, trim(regexp_replace(regexp_replace(lower(page_title) || '#part', '#.*$', ''), '[_\s]+', ' ', 'g')) as t from page)"""))
def title_canonical(spark, d):
    p = M.page(spark, d)
    return p.select("page_id", N.canonical_title(F.concat(F.lower("page_title"), F.lit("#part"))).alias("title"))


@query("""select n_nationkey, case n_nationkey % 6 when 0 then n_name when 1 then 'Talk:' || n_name when 2 then 'User:' || n_name when 3 then 'User_talk:' || n_name when 4 then 'Project:' || n_name else 'Project_talk:' || n_name end as title from nation""")
def full_title_namespace(spark, d):
    return table(spark, d, "nation").select("n_nationkey", N.full_title(F.col("n_nationkey") % 6, F.col("n_name")).alias("title"))


@query("""with k as (select p_partkey as cl_from, p_partkey % 14 as k, 1500 + (p_partkey * 37) % 520 as y from part)
select cl_from, case when k in (0, 1, 2, 12, 13) then cast(y as varchar) when k = 3 then '?' when k in (4, 5) then y % 90 + 10 || ' BC' when k = 6 then y // 10 * 10 || 's' end as birth,
  case when k = 0 then cast(y + 50 as varchar) when k in (1, 12) then case when y > 1600 and y < 1899 then '?' else '' end when k = 2 then case when y > 1600 and y < 1899 then '?' end when k = 3 then cast(y as varchar) when k = 4 then '5 BC' when k = 5 then '12' when k = 7 then cast(y as varchar) when k = 8 then '?' when k = 13 then '?' end as death,
  case when k = 0 then y || '–' || (y + 50) when k in (1, 2, 12) then case when y > 1600 and y < 1899 then y || '–?' else 'born ' || y end when k = 3 then case when y < 2014 then 'died ' || y else '?–' || y end when k = 4 then (y % 90 + 10) || '–5 BC' when k = 5 then (y % 90 + 10) || ' BC–12 AD'
    when k = 6 then 'born ' || (y // 10 * 10) || 's' when k = 7 then 'died ' || y when k = 13 then y || '–?' else '' end as life,
  case when k = 9 then y || ' ' || (y + 1) else '' end as debut from k where k not in (10, 11)""")
def category_lifespans(spark, d):
    """Lives and debuts read from categories: years, decades, centuries, eras, living, missing and unknown."""
    k, y = F.col("p_partkey") % 14, (1500 + (F.col("p_partkey") * 37) % 520)
    yt, early = y.cast("string"), (y % 90 + 10).cast("string")
    born, died = (lambda t: F.concat(t, F.lit("_births"))), (lambda t: F.concat(t, F.lit("_deaths")))
    none = F.lit("Towns_of_1875")
    groups = [
        (born(yt), died((y + 50).cast("string"))), (born(yt), F.lit("Living_people")), (born(yt), none), (F.lit("Year_of_birth_unknown"), died(yt)), (born(F.concat(early, F.lit("_BC"))), F.lit("5_BC_deaths")), (born(F.concat(early, F.lit("_BC"))), F.lit("12_deaths")),
        (born(F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s"))), none), (died(yt), none), (F.lit("Year_of_death_missing"), F.lit("Articles_of_1875")), (F.concat(yt, F.lit("_albums")), F.concat((y + 1).cast("string"), F.lit("_live_albums"))), (F.lit("2nd-century_births"), none), (none, none),
        (born(yt), F.lit("Missing_people")), (born(yt), F.lit("Year_of_death_unknown")),
    ]
    both = F.lit(None).cast("array<string>")
    for i, g in enumerate(groups):
        both = F.when(k == i, F.array(*g, F.lit("Some_place"))).otherwise(both)
    links = table(spark, d, "part").select(F.col("p_partkey").alias("cl_from"), F.explode(both).alias("cl_to"))
    return N.category_lifespans(links, 2024)


@query("""select p_partkey, case when p_size < 10 then '(' || (1900 + p_size) || '–' || (1950 + p_size) || ')' when p_size < 30 then '(born ' || (1900 + p_size) || ')' when p_size < 40 then '(' || (1800 + p_size) || '–?)' when p_size < 45 then '(died ' || (1900 + p_size) || ')' else '' end as life from part""")
def lifespan_text(spark, d):
    s = F.col("p_size")
    births = F.when(s < 30, 1900 + s).when(s < 40, 1800 + s)
    deaths = F.when(s < 10, 1950 + s).when((s >= 40) & (s < 45), 1900 + s)
    return table(spark, d, "part").select("p_partkey", N.lifespan(births, deaths, F.lit(False), 2024).alias("life"))


@query(r"""with n as (select p_partkey, case p_partkey % 4 when 0 then upper(p_name[1]) || replace(p_name[2:], ' ', 'The') when 1 then p_name when 2 then replace(p_name, ' ', '_-') || '.com' else replace(p_name, ' ', '') || '!' end as n from part),
h as (select *, regexp_replace(regexp_replace(n, '([a-z])([A-Z])', '\1.\2', 'g'), '[ _-]+', '.', 'g') as dotted from n)
select p_partkey, case when dotted <> n then dotted else n[:length(n) // 2] || '.' || n[length(n) // 2 + 1:] end as no_ping, translate(replace(replace(replace(replace(lower(n), '.com', ''), 'www.', ''), 'the', ''), '.org', ''), '[]{}\|''!,.', '') as loose from h""")
def name_keys(spark, d):
    """Names in camel case, of two words, with marks and of one word, made harmless and comparable."""
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    camel = F.concat(F.upper(F.substring(n, 1, 1)), F.replace(F.substring(n, 2, 1 << 30), F.lit(" "), F.lit("The")))
    name = F.when(k == 0, camel).when(k == 1, n).when(k == 2, F.concat(F.replace(n, F.lit(" "), F.lit("_-")), F.lit(".com"))).otherwise(F.concat(F.replace(n, F.lit(" "), F.lit("")), F.lit("!")))
    return table(spark, d, "part").select("p_partkey", N.no_ping(name).alias("no_ping"), N.loose_key(name).alias("loose"))


@query("""with n as (select c_custkey, c_custkey % 6 as k, ['de', 'zh_min_nan', 'en', 'commons', 'fr', 'meta'][c_custkey % 6 + 1] as lang, ['wiktionary', 'wiki', 'wikisource', 'wiki', 'wiki', 'wiki'][c_custkey % 6 + 1] as family from customer)
select c_custkey, replace(lang, '_', '-') as language, case when k in (3, 5) then 'wikimedia' when family = 'wiki' then 'wikipedia' else family end as family, case when k in (3, 5) then lang || '.wikimedia.org' else replace(lang, '_', '-') || '.' || case when family = 'wiki' then 'wikipedia' else family end || '.org' end as host from n""")
def db_names(spark, d):
    """Names of databases of several families, with long language codes and special sites, as language, family and host."""
    names = F.array(*map(F.lit, ("dewiktionary_p", "zh_min_nanwiki_p", "enwikisource", "commonswiki_p", "frwiki_p", "metawiki")))
    parts = N.db_parts(F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int")))
    return table(spark, d, "customer").select("c_custkey", parts.alias("p")).select("c_custkey", "p.language", "p.family", "p.host")


@query(r"""select p_partkey, regexp_replace(p_name, '([0-9]+)', '0000\1', 'g') as padded from part""")
def number_padding(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", "([0-9]+)", "0000$1").alias("padded"))


@query("select doc_id, source, url_encode(text) as encoded, text as back from documents")
def percent_decode(spark, d):
    """Percent encoding and back, of whole texts."""
    encoded = U.percent_encoded(F.col("text"))
    return table(spark, d, "documents").select("doc_id", "source", encoded.alias("encoded"), U.percent_decoded(encoded).alias("back"))


@query("""with n as (select p_partkey, case p_partkey % 3 when 0 then p_name when 1 then upper(p_name[1]) || p_name[2:] else replace(p_name, ' ', '-') || ' of 5' end as n from part),
w as (select *, array_to_string(list_transform(string_split(lower(n), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as words from n)
select p_partkey, unnest(list_distinct([n, lower(n), upper(n), words, upper(n[1]) || n[2:], lower(n[1]) || n[2:]])) as v from w""")
def case_variants(spark, d):
    """Spellings to look up, one row each, of names of several words."""
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    name = F.when(k == 0, n).when(k == 1, F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1 << 30))).otherwise(F.concat(F.replace(n, F.lit(" "), F.lit("-")), F.lit(" of 5")))
    return table(spark, d, "part").select("p_partkey", F.explode(N.case_variants(name)).alias("v"))


@query("""with n as (select l_orderkey, l_linenumber, l_orderkey * 1000003 + l_linenumber as n from lineitem)
select *, ltrim(array_to_string(list_transform(range(10, -1, -1), lambda i: '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'[cast((n::hugeint // cast(62 as hugeint) ** i) % 62 as bigint) + 1]), ''), '0') as digits, n as back from n""".replace("cast(62 as hugeint) ** i", "[1, 62, 3844, 238328, 14776336, 916132832, 56800235584, 3521614606208, 218340105584896, 13537086546263552, 839299365868340224][i + 1]"))
def base62(spark, d):
    """Numbers to base 62 and back."""
    n = F.col("l_orderkey") * 1000003 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), N.base62(n).alias("digits")).withColumn("back", N.unbase62(F.col("digits")))


@query("""with m as (select n_regionkey, list(n_name order by n_name) filter (n_nationkey % 7 < n_regionkey) as m from nation group by n_regionkey)
select n_regionkey, case when m is null then '' when len(m) = 1 then m[1] when len(m) = 2 then m[1] || ' and ' || m[2] else array_to_string(m[:-2], ', ') || ', and ' || m[-1] end as members from m""")
def list_text(spark, d):
    """The nations of a region, no more than a few, as a list in a sentence."""
    few = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 7 < F.col("n_regionkey"), F.col("n_name")))).alias("m"))
    return few.select("n_regionkey", N.english_list(F.col("m")).alias("members"))


_SPACES = ", ".join(f"({n}, '{name}')" for n, name in N.NAMESPACES.items())


@query(f"""with ns(id, name) as (values {_SPACES}) select c_custkey, case when name is null then '{{ns:' || c_custkey % 130 || '}}:' || c_name when name = '' then c_name else replace(name, ' ', '_') || ':' || c_name end as title, case when name is not null and name <> '' then cast(id as bigint) else 0 end as ns, case when name is null then '{{ns:' || c_custkey % 130 || '}}:' || c_name else c_name end as rest from customer left join ns on id = c_custkey % 130""")
def namespace_join(spark, d):
    """Full titles by a join with the table of namespaces, unknown ones too, and split again."""
    names = spark.createDataFrame(list(N.NAMESPACES.items()), "id long, name string")
    c = table(spark, d, "customer").withColumn("id", F.col("c_custkey") % 130).join(names, "id", "left")
    name = F.coalesce("name", F.concat(F.lit("{ns:"), F.col("id").cast("string"), F.lit("}")))
    title = F.when(name == "", F.col("c_name")).otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit(":"), "c_name"))
    return c.select("c_custkey", title.alias("title")).withColumn("p", N.split_namespace(F.col("title"))).select("c_custkey", "title", F.col("p.ns").cast("long").alias("ns"), "p.rest")


@query("select max(ts) as newest, cast(date_diff('second', date_trunc('second', max(ts)), timestamp '2024-03-01 00:00:00') as bigint) as lag_s, date_diff('second', date_trunc('second', max(ts)), timestamp '2024-03-01 00:00:00') > 300 as stale from events")
def freshness(spark, d):
    """The newest row, how far it lies behind, and whether that is over five minutes."""
    from ..sources import readers as R

    return R.freshness(table(spark, d, "events"), "ts", "2024-03-01 00:00:00").withColumn("stale", F.col("lag_s") > 300)


@query("""select p_partkey, p_name from part where p_name like 'red%' or p_name like '%\\_ring' escape '\\' or p_name like '% bolt' or p_name like 'The red%' or p_name like 'small%' or p_name like 'The small%' """)
def title_likes(spark, d):
    """Pages whose titles fit any of the patterns made of two titles, with and without an article, or of a suffix in which an underscore is itself."""
    from ..operators import predicates as P

    p = table(spark, d, "part")
    return p.where(P.any_like("p_name", ["red", "small"], suffixes=["_ring", " bolt"])).select("p_partkey", "p_name")
