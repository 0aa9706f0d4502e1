"""URL filters with redirect equivalence, in DataFrame operations only.

A rule (verdict, host, path) fits its host and subdomains where the URL's path
starts with the rule's; the longest wins (ties: block before allow, then by
name). Pages that redirect to each other or name each other canonical are
aliases: connected components over those edges. A page that no rule fits takes
over a block from any alias, unless an alias is explicitly allowed; its own
rule always stands first.

Edges come from <link rel=canonical> and <meta http-equiv=refresh> of the
pages, and from an optional table of redirects. Relative targets are resolved;
fragments and the case of A-Z in hosts do not tell URLs apart.

Defined results: a null URL, or one without '://', has empty host and path, no
rule, no aliases and the verdict allow; a null html has no edges; repeated rows
stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ready_checkpoints
from .components import connected_components, dealt

#: Fixed values: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def match_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, fit) of the pairs (host, path) that a row (verdict, host, path) of a rule table of any size fits.

    Hosts meet rules in an equi-join on their suffixes, as many as a host has labels.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("_s"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    found = pairs.select("host", "path").distinct().withColumn("_s", F.explode(suffixes)).join(r, "_s").where(F.startswith("path", F.col("_p")))
    best = F.max(F.struct(F.length(F.concat("_s", "_p")).alias("n"), (F.col("_v") == "block").alias("b"), F.col("_s"), F.col("_p"), F.col("_v"))).alias("m")
    return found.groupBy("host", "path").agg(best).select("host", "path", F.struct(F.concat("m._s", "m._p").alias("rule"), F.col("m._v").alias("verdict")).alias("fit"))


def with_fit(df: DataFrame, rules) -> DataFrame:
    """df, which has host and path, with the struct fit; rules: (verdict, host, path) tuples or a table of them."""
    if isinstance(rules, DataFrame):
        return df.join(match_rules(df, rules), ["host", "path"], "left")
    return df.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))


def url_node(url: Column) -> Column:
    """The URL without fragment and with A-Z of scheme and host lower-cased; null without '://'."""
    head = F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1)
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(head != "", F.concat(F.translate(head, UPPER, LOWER), F.when(rest == "", "/").otherwise(rest)))


#: Character references that URLs in attributes may hold; the ampersand's own ones come last.
_REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#58;", ":"), ("&#x3a;", ":"), ("&#x3A;", ":"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def without_dots(path: Column) -> Column:
    """An absolute path without its segments `.` and `..`."""
    segments = F.split(path, "/")
    inner = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
    kept = F.aggregate(inner, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    folder = F.element_at(segments, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""))


def resolve(target: Column, base: Column) -> Column:
    """The absolute URL that a link target on a page means."""
    t = target
    for name, c in _REFERENCES:
        t = F.replace(t, F.lit(name), F.lit(c))
    t = F.trim(t)
    path, rest = F.regexp_extract(t, "(?s)^([^?#]*)", 1), F.regexp_extract(t, "(?s)^[^?#]*(.*)$", 1)
    scheme = F.regexp_extract(base, "(?s)^(.*?:)//", 1)
    site = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    own = url_path(base)
    folder = F.regexp_extract(own, "(?s)^(.*/)", 1)
    return (
        F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), t).when(t.startswith("//"), F.concat(scheme, t)).when(t.startswith("/"), F.concat(site, without_dots(path), rest))
        .when((t == "") | t.startswith("#"), base).when(path == "", F.concat(site, own, rest)).otherwise(F.concat(site, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), rest))
    )


#: What holds no tags, whatever it looks like.
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template)\b.*?(?:</\1\s*>|\z)"


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): a page's node and those it redirects to or calls canonical, by tags outside comments and scripts."""
    few = pages.where(F.col(html_col).rlike("(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), F.regexp_replace(html_col, _UNREAD, " ").alias("html"))
    canonical = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
    refresh = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"))
    named = F.transform(canonical, lambda x: F.regexp_extract(x, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    sent = F.transform(refresh, lambda x: F.regexp_extract(x, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    found = few.select("url", F.explode(F.concat(named, sent)).alias("target")).where("target <> ''")
    return found.select(url_node(F.col("url")).alias("u"), url_node(resolve(F.col("target"), F.col("url"))).alias("v")).where("u is not null and v is not null")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, by ('rule', 'alias' or 'default'). redirects: optional (src, dst) URLs; rules: tuples or a table (verdict, host, path)."""
    ready_checkpoints(pages.sparkSession)
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(url_node(F.col("src")).alias("u"), url_node(F.col("dst")).alias("v")).where("u is not null and v is not null"))
    members = connected_components(edges)
    judged = with_fit(members.select("component", url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path")), rules)
    inherited = judged.withColumn("own", F.col("fit.verdict")).groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
    blocked = members.join(dealt(inherited.where("blocked = 1 and coalesce(allowed, 0) = 0"), "component"), "component").select("node")
    few = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    judged = few.select(id_col, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_node(F.col("url")).alias("node"))
    judged = with_fit(judged, rules).join(blocked.withColumn("alias", F.lit(True)), "node", "left")
    return judged.select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("alias"), "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("fit").isNotNull(), "rule").when(F.col("alias"), "alias").otherwise("default").alias("by"),
    )
