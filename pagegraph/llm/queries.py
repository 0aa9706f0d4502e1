"""One query for each operator of this subpackage, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import avi, chat_format, decontaminate, fill_middle, html_extract, license_scan, packing, quality, simhash, suffix_dedup, url_filter, whitening, window_packing


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The tokenizer file; another path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).drop("by")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = avi.store_as_avi(table(spark, sf_dir, "documents"))
    return rows.withColumn("clips", F.to_json("clips"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack_windows(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("form"), F.col("output"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP1_SQL = r"""
with spoken as (
  select conv_id, cast(turn as bigint) as turn, coalesce(nullif(role, ''), 'unknown') as speaker, coalesce(text, '') as text from conversations),
people as (select distinct conv_id, speaker as perspective from spoken where speaker <> 'system'),
seen as (
  select s.conv_id, p.perspective, s.turn, s.speaker, md5(s.speaker || chr(10) || s.text) as tie, s.text,
    case when s.speaker = 'system' then 'system' when s.speaker = p.perspective then 'assistant' else 'user' end as chat_role,
    '<|' || case when s.speaker = 'system' then 'system' when s.speaker = p.perspective then 'assistant' else 'user name=' || s.speaker end || '|>' || chr(10) as head
  from spoken s left join people p on s.conv_id is not distinct from p.conv_id),
sized as (select *, length(head) + length(text) + 8 as size from seen),
placed as (
  select *, cast(coalesce(sum(size) over (partition by conv_id, perspective order by turn nulls first, tie, speaker, text rows between unbounded preceding and 1 preceding), 0) as bigint) as seg_start from sized)
select conv_id, perspective, turn, speaker, chat_role, head || text || '<|end|>' || chr(10) as segment, seg_start,
  case when chat_role = 'assistant' then seg_start + length(head) end as loss_start,
  case when chat_role = 'assistant' then seg_start + size - 1 end as loss_end,
  cast(chat_role = 'assistant' as int) as loss_mask
from placed
"""

_RULES_SQL = "(values " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES) + ") as rules(verdict, host, path)"

OP3_SQL = r"""
with doc as (
  select row_number() over () as n, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
item as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
sizes as (select distinct least(10, len(w)) as k from item where len(w) > 0),
windows as (select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as s from item, range(1, greatest(1, len(w) - 9) + 1) as t(i) where len(w) > 0),
places as (select n, i, k, array_to_string(w[i : i + k - 1], ' ') as s from doc, sizes, range(1, len(w) - k + 2) as t(i)),
hits as (select n, i, k, item_id from places join windows using (k, s)),
covered as (select n, count(distinct j) as n_hit from (select n, i + o as j from (select distinct n, i, k from hits), range(0, k) as t(o)) group by n),
named as (select n, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct n, item_id from hits) group by n)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join covered using (n) left join named using (n)
"""

OP5_SQL = rf"""
with recursive page as (
  select page_id, url, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
target as (
  select distinct url, regexp_extract(tag, '(?is)href\s*=\s*["'']?\s*([^"''\s>]+)', 1) as t from (select url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) as tag from page) where regexp_matches(tag, '(?is)\brel\s*=\s*["'']?\s*canonical\b')),
edge as (
  select distinct regexp_replace(url, '#.*$', '') as a, regexp_replace(t, '#.*$', '') as b from target where regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://')),
both_ways as (select a, b from edge union select b, a from edge),
reach(a, b) as (select a, a from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
fit as (
  select x.url, max_by(struct_pack(verdict := r.verdict, rule := r.host || r.path), length(r.host || r.path)) as f
  from (select url from page union select b from both_ways) x
  join {_RULES_SQL} on (regexp_extract(lower(x.url), '://([^/?#]*)', 1) = r.host or ends_with(regexp_extract(lower(x.url), '://([^/?#]*)', 1), '.' || r.host)) and starts_with(regexp_extract(x.url, '://[^/?#]*([^?#]*)', 1), r.path)
  group by x.url),
spread as (select r.a, bool_or(f.f.verdict = 'block') as blocked, bool_or(f.f.verdict = 'allow') as allowed from reach r join fit f on f.url = r.b group by r.a)
select page_id, page.host, page.path, fit.f.rule as rule, coalesce(fit.f.verdict, case when spread.blocked and not spread.allowed then 'block' end, 'allow') as verdict
from page left join fit on fit.url = page.url left join spread on spread.a = regexp_replace(page.url, '#.*$', '')
""".replace("as rules(", "as r(")


OP12_SQL = r"""
with doc as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
cut as (
  select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from doc),
sized as (
  select *, len(units) as n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from cut),
parts as (
  select *, array_to_string(units[1 : least(h1 % (n + 1), h2 % (n + 1))], '') as p, array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') as m, array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 :], '') as s from sized)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(p || m || s) as restored_sha256
from parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op3_decontamination": OP3_SQL, "op5_url_filters": OP5_SQL, "op12_fill_in_middle": OP12_SQL}
