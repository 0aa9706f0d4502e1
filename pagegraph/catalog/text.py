"""Text and markup queries over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup as H
from ..functions import text as T
from ..functions import titles as N
from ..session import table
from ..sources import readers as R
from .base import Catalogue, rewritten, rewritten_sql

catalogue = Catalogue()
query = catalogue.query


@query(r"""select page_id, trim(regexp_replace(regexp_extract(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g')) as title from pages""")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query(r"""select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)', 1)) as href from pages""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.html_links(F.col("html"))).alias("href"))


@query(r"""select page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>', 1)) as heading from pages""")
def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.headings(F.col("html"))).alias("heading"))


@query(r"""with t as (select page_id, trim(regexp_replace(regexp_extract(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g')) as title from pages)
select page_id, title = '' or regexp_matches(title, '(?i)\b(?:404|not found|untitled|error|log ?in|sign ?in|access denied|page unavailable|under construction|forbidden)\b') as bad from t""")
def bad_title_filter(spark, d):
    return table(spark, d, "pages").select("page_id", T.bad_title(T.html_title(F.col("html"))).alias("bad"))


@query(r"""select page_id, cast(length(regexp_replace(html, '(?is)<!--.*?-->', '', 'g')) as bigint) as rest from pages""")
def strip_disabled(spark, d):
    """Characters left without disabled parts."""
    return table(spark, d, "pages").select("page_id", F.length(T.strip_disabled(F.col("html"))).cast("long").alias("rest"))


@query("select o_orderkey, cast(o_orderdate as date) as found from orders")
def date_extract(spark, d):
    """The only date of a text that gives it in the six forms that every day has."""
    o = table(spark, d, "orders")
    t = F.concat(F.lit("Printed "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(", online "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("; "), *(F.date_format("o_orderdate", f) for f in ("d-MMM-yyyy'; 'EEEE, d MMM. yyyy'; '", "MMMM d, yyyy'; 'yyyyMMdd'101500.'")))
    return o.select("o_orderkey", T.only_date(t).alias("found"))


@query(r"""with n as (select doc_id, doc_id % 13 as k, cast(make_date(2001 + (doc_id // 400) % 15, 1 + doc_id % 12, 13 + doc_id % 16) as date) as d from documents)
select doc_id, case when k < 11 then d end as found from n""")
def date_in_documents(spark, d):
    """The only date of whole documents, whose digits are gone, with dates put into their middle: one in a form by turns, the same in two forms, two different ones, none."""
    docs = table(spark, d, "documents")
    text = F.translate(F.coalesce("text", F.lit("")), "0123456789", "##########")
    n = F.col("doc_id")
    day = F.make_date((2001 + F.floor(n / 400) % 15).cast("int"), (1 + n % 12).cast("int"), (13 + n % 16).cast("int"))
    forms = ["d-MMM-yyyy", "EEEE, d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyy/dd/MM", "yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-M-d", "yyyyMMdd'101500'"]
    put = [F.date_format(day.cast("timestamp"), f) for f in forms]
    both = F.concat(put[2], F.lit(" and "), put[5])
    k = F.lit("")
    for i, c in enumerate([*put, both, F.concat(both, F.lit("; 3 May 1999")), F.lit("")]):
        k = F.when(n % 13 == i, c).otherwise(k)
    half = (F.length(text) / 2).cast("int")
    whole = F.concat(F.substring(text, F.lit(1), half), F.lit(" | "), k, F.lit(" | "), F.substring(text, half + 1, F.length(text)))
    return docs.select("doc_id", T.only_date(whole).alias("found"))


@query(r"""select doc_id, cast(length(regexp_replace(left_text, '[^A-Z]', '', 'g')) as bigint) as capitals, cast(length(regexp_replace(left_text, '[^A-Za-z]', '', 'g')) as bigint) as letters from (select doc_id, text as left_text from documents)""")
def capital_ratio(spark, d):
    """Capitals and letters of a text."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(t, "[^A-Z]", "")).cast("long").alias("capitals"), F.length(F.regexp_replace(t, "[^A-Za-z]", "")).cast("long").alias("letters"))


#: A page of rules, a name and a pattern a line.
_RULES = """blog: ^http://blog\\.
org: \\.org/
ref: ref=
digits: /[a-z]+/[0-9]{2,}
secure: ^https
none: ^ftp
not a rule"""


@query(r"""with r as (select split_part(x, ': ', 1) as name, split_part(x, ': ', 2) as pattern from (select unnest(string_split($rules$, chr(10))) as x) where contains(x, ':')),
m as (select name, page_id, row_number() over (partition by name order by page_id) as rn from pages join r on regexp_matches(url, pattern))
select name, cast(count(*) as bigint) as n, string_agg(cast(page_id as varchar), ',' order by page_id) filter (rn <= 33) as samples from m group by name""".replace("$rules$", "'" + _RULES + "'"))
def regex_rule_tally(spark, d):
    """Links per rule of a page of rules, with 33 samples. Each rule is a literal pattern, compiled once, so pages are read once for all rules and nothing is crossed."""
    listed = R.rules(spark, _RULES).collect()  # no more than a page's lines
    names = F.array_compact(F.array(*[F.when(F.col("url").rlike(r.pattern), r.name) for r in listed]))
    m = table(spark, d, "pages").select("page_id", F.explode(names).alias("name"))
    n = m.groupBy("name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("name").orderBy("page_id")
    top = m.withColumn("rn", F.row_number().over(w)).where("rn <= 33").groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("samples"))
    return n.join(top, "name")


@query()
def soup_nodes(spark, d):
    """All nodes of all pages."""
    return H.node_rows(table(spark, d, "pages")).withColumn("attributes", F.to_json("attributes"))


@query()
def fuzzy_anchor(spark, d):
    """Names within a brand that are alike by the exact ratio, each name once, with how many parts have it; lengths rule pairs out before the ratio is taken."""
    p = table(spark, d, "part").groupBy("p_brand", F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    a, b = p.select("p_brand", F.col("name").alias("a"), F.col("n").alias("n_a")), p.select("p_brand", F.col("name").alias("b"), F.col("n").alias("n_b"))
    shorter, both = F.least(F.length("a"), F.length("b")), F.length("a") + F.length("b")
    c = a.join(b, "p_brand").where("a < b").where(2 * shorter >= 0.5 * both)
    return c.withColumn("ratio", F.round(H.similarity(F.col("a"), F.col("b")), 6)).where("ratio >= 0.5")


@query("""with n as (select c_custkey, count(o_orderkey) filter (o_orderstatus <> 'P') as a, count(o_orderkey) filter (o_orderstatus = 'P') as t, c_custkey % 3 as d from customer left join orders on o_custkey = c_custkey group by 1)
select c_custkey, 'linked from ' || case when a = 1 then '1 article' else a || ' articles' end || case when t = 0 then '' when t = 1 then ' and 1 template' else ' and ' || t || ' templates' end || case d when 0 then '' when 1 then '; deleted 1 time' else '; deleted 2 times' end as sentence from n""")
def red_sentences(spark, d):
    """What links to a missing page, by articles and templates, and how often it was deleted."""
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    n = c.groupBy("c_custkey").agg(F.count_if(F.col("o_orderstatus") != "P").alias("a"), F.count_if(F.col("o_orderstatus") == "P").alias("t"))
    return n.select("c_custkey", T.red_sentence(F.col("a"), F.col("t"), F.col("c_custkey") % 3).alias("sentence"))


@query(r"""select page_id, cast(len(regexp_extract_all(html, '(?i)<p\b')) as bigint) as p, cast(len(regexp_extract_all(html, '(?i)<li\b')) as bigint) as li, cast(len(regexp_extract_all(html, '(?i)<a\b')) as bigint) as a from pages""")
def soup_counts(spark, d):
    """Elements of the parsed trees, counted where the page is."""
    n = H.element_counts(table(spark, d, "pages"), ("p", "li", "a"))
    return n.select("page_id", *[F.col(f"n.{t}").alias(t) for t in ("p", "li", "a")])


_CLASSED = [("<p>([A-Z][a-z]+) ", r"<p><span class='x ad'>\1 <b>of</b></span> "), ("<li>", "<li class=ad>")]


@query(rf"""with h as (select page_id, {rewritten_sql("html", _CLASSED)} as h from pages)
select page_id, unnest(list_transform(regexp_extract_all(h, '(?s)<div class="ad">.*?</div>|<span class=''x ad''>.*?</span>|<li class=ad>.*?</li>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))) as text from h""")
def class_texts(spark, d):
    """The text of all elements of a class, in pages into which more of them were put."""
    pages = table(spark, d, "pages").select("page_id", rewritten(F.col("html"), _CLASSED).alias("html"))
    return H.class_texts(pages, "ad").select("page_id", "text")


@query(r"""with u as (select page_id, regexp_extract(url, '^(\w+://[^/]+)', 1) as site, url from pages where regexp_matches(url, '^\w+://[^/]+/[^/]'))
select page_id, case page_id % 6 when 0 then 'root' when 1 then 'root' when 2 then 'error page' when 3 then 'error page' end as fault from u where not regexp_matches(url, '(?i)\D404(\D|$)|error|not.{0,3}found')""")
def redirect_faults(spark, d):
    """Links that end at their site's root or at an error page, elsewhere on it, or at another site's root."""
    site, k = F.regexp_extract("url", r"^(\w+://[^/]+)", 1), F.col("page_id") % 6
    final = F.when(k == 0, F.concat(site, F.lit("/"))).when(k == 1, F.concat(site, F.lit("/index.php"))).when(k == 2, F.concat(site, F.lit("/404.html"))).when(k == 3, F.concat(site, F.lit("/Not_Found"))).when(k == 4, F.concat(site, F.lit("/moved/here"))).otherwise("http://elsewhere.org/")
    p = table(spark, d, "pages").where(F.col("url").rlike(r"^\w+://[^/]+/[^/]") & ~F.col("url").rlike(r"(?i)\D404(\D|$)|error|not.{0,3}found"))
    return p.select("page_id", T.redirect_fault(F.col("url"), final).alias("fault"))
