"""Protected and nested spans in whole documents into which markup was put."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as P
from ..session import bounded_batches, table
from .base import Catalogue, rewritten, rewritten_sql

catalogue = Catalogue()
query = catalogue.query

#: Markup of every kind of span, nested, within each other, and left open.
KINDS = [
    (r" (of) ", r" {{of|\1 {{in|{{x}} y}} [[z}} "), (r" (th[a-z]+) ", r" <nowiki>{{\1</nowiki> "), (r" (er[a-z]*) ", r" <!-- [[\1]] {{ --> "), (r" (an[a-z]*) ", r" <ref name=x>\1 {{c|{{d}}}}</ref> "), (r", (in[a-z]*)", r", <math>\1 <!-- </math>"),
    (r"\. ([A-Z])", ".\n{|\n| \\1\n{|\n|x {{y}}\n|}\n|}\n \\1 begins so\n"), (r" (on[a-z]*) ", r" [[\1|label}} of]] <pre>\1</pre> <source lang=x>\1</source> "), (r" (he[a-z]*) ", r" http://x.org/\1?a=1. <gallery>\1</gallery> <timeline>\1</timeline> "),
    (r" (es) ", r" <includeonly>\1</includeonly><noinclude>[[\1</noinclude> <table><tr><table>\1</table></table> "), (r" (la) ", r" {{\1 <ref>open "), (r" (die) ", r" }} ]] </ref> \1 |} "), (r" (le[a-z]*) ", r" {{a|{{b|{{c|{{\1}}}}}}}} "),
]
#: Templates in templates, some left open and some ends without a beginning.
TEMPLATES = [(r" (of|de|die) ", r" {{\1|{{in|{{x}} y}} z}} "), (r", ([a-z]+) ", r", {{open \1 "), (r"\. ", ". }} "), (r" (th[a-z]+|le) ", r" {{\1}}{{b}} ")]


def marked(spark, d, rules):
    return table(spark, d, "documents").select("doc_id", rewritten(F.col("text"), rules).alias("wikitext"))


@query()
def protected_spans(spark, d):
    """A row for each span of any of fifteen kinds."""
    kinds = [k for k in P.KINDS if k not in ("header", "inputbox")]
    return P.span_rows(marked(spark, d, KINDS), "doc_id", "wikitext", *kinds).drop("span")


@query()
def masked_edit(spark, d):
    """Words in capitals outside all spans, by tokens: taken out, edited, put back."""
    bounded_batches(spark, 256)
    t = marked(spark, d, KINDS).withColumn("m", P.mask("nowiki", "comment", "template", "table", "link", "ref")(F.col("wikitext")))
    return t.select("doc_id", F.size("m.parts").cast("bigint").alias("parts"), P.unmask(F.upper("m.masked"), F.col("m.parts")).alias("edited"))


@query(rf"""with t as (select doc_id, {rewritten_sql("text", TEMPLATES)} as t from documents),
b as (select doc_id, string_split_regex(t, '\{{\{{|\}}\}}') as gaps, regexp_extract_all(t, '\{{\{{|\}}\}}') as tokens from t),
r as (select doc_id, unnest(range(1, len(tokens) + 1)) as place, unnest(list_transform(gaps[: len(tokens)], lambda g: length(g))) as gap, unnest(tokens) as token from b),
s as (select *, case when token = '{{{{' then 1 else -1 end as step, sum(gap + 2) over w as stop, sum(case when token = '{{{{' then 1 else -1 end) over w as total from r window w as (partition by doc_id order by place)),
l as (select *, least(0, min(total) over (partition by doc_id order by place)) as low from s),
k as (select *, step < 0 and total < coalesce(lag(low) over (partition by doc_id order by place), 0) as stray, total - low + case when step < 0 then 1 else 0 end as depth from l),
p as (select *, lead(step) over (partition by doc_id, depth order by place) as next_step, lead(stop) over (partition by doc_id, depth order by place) as next_stop from k where not stray)
select doc_id, cast(depth as int) as depth, cast(stop - 2 as bigint) as start, cast(next_stop - stop + 2 as bigint) as length from p where step > 0 and next_step < 0""")
def nested_templates(spark, d):
    """Templates at any depth, with ends that match."""
    found = P.bracket_spans(marked(spark, d, TEMPLATES), "doc_id", "wikitext")
    return found.select("doc_id", F.col("depth").cast("int").alias("depth"), F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"))
