"""Full-text search, blame and closures over links."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import blame as B
from ..operators import fulltext as X
from ..session import ready_checkpoints, table, taken
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

BOOLEAN = '+the -und ~onth "of the" an* and "the the"'
NATURAL = "the und les onth nowhere"


def _search(spark, d, text, natural=False):
    """Builds the index of whole documents in the shared folder and searches it."""
    ready_checkpoints(spark)
    folder, docs = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}", table(spark, d, "documents")
    X.write_index(docs, "doc_id", "text", folder)
    return taken(X.search(X.read_index(spark, folder), docs.count(), text, natural).withColumnRenamed("doc", "doc_id"), folder)


@query(r"""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
n as (select doc_id, len(list_filter(w, lambda x: x = 'the')) as a, len(list_filter(w, lambda x: x = 'und')) as b, len(list_filter(w, lambda x: x = 'onth')) as c, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) as e, len(list_filter(w, lambda x: starts_with(x, 'an'))) as f, len(list_filter(w, lambda x: x = 'and')) as g, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' and w[i + 1] = 'the')) as h from w),
t as (select count(*) as d, count_if(a > 0) as a, count_if(c > 0) as c, count_if(e > 0) as e, count_if(f > 0) as f, count_if(g > 0) as g, count_if(h > 0) as h from n),
idf as (select coalesce(power(log10(d / nullif(a, 0)), 2), 0) as a, coalesce(power(log10(d / nullif(c, 0)), 2), 0) as c, coalesce(power(log10(d / nullif(e, 0)), 2), 0) as e, coalesce(power(log10(d / nullif(f, 0)), 2), 0) as f, coalesce(power(log10(d / nullif(g, 0)), 2), 0) as g, coalesce(power(log10(d / nullif(h, 0)), 2), 0) as h from t)
select doc_id, cast(n.a + n.c + n.e + n.f + n.g + n.h as bigint) as occurrences, n.a * idf.a - n.c * idf.c + n.e * idf.e + n.f * idf.f + n.g * idf.g + n.h * idf.h as relevance from n, idf where n.a > 0 and n.b = 0""")
def fulltext_boolean(spark, d):
    """Must, must not, lowered, phrases and prefixes, with relevance."""
    return _search(spark, d, BOOLEAN)


@query(r"""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
p as (select doc_id, q, cast(count(*) as bigint) as n from (select doc_id, unnest(w) as q from w) where q in ('the', 'und', 'les', 'onth', 'nowhere') group by all),
idf as (select q, power(log10((select count(*) from documents) / count(*)), 2) as idf from p group by q)
select doc_id, cast(sum(n) as bigint) as occurrences, sum(n * idf) as relevance from p join idf using (q) group by doc_id""")
def fulltext_natural(spark, d):
    """Any of some words, by relevance."""
    return _search(spark, d, NATURAL, natural=True)


@query()
def blame_words(spark, d):
    """For each word of a conversation's last text the turn that brought it."""
    return B.blame_words(table(spark, d, "conversations"), "conv_id", "turn", "text")
