"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import divergence, interactions, mixing, packing, quality, secrets, sentencepieces, sharding, simhash, suffixes, topk, toxicity, urls
from palimpsest.llm.common import documents, table


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.sampled_segmentations(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_report(documents(spark, sf_dir))


def op3_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_report(documents(spark, sf_dir))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(documents(spark, sf_dir))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.interaction_report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_gumbel_segmentations": op1_gumbel_segmentations,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_vector_sharding": op3_vector_sharding,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_bit_sliced_topk": op5_bit_sliced_topk,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_secret_scan": op7_secret_scan,
        "op8_toxic_segments": op8_toxic_segments,
        "op9_url_filter": op9_url_filter,
        "op10_quality_rules": op10_quality_rules,
        "op11_source_mix": op11_source_mix,
        "op12_source_divergence": op12_source_divergence,
        "op13_filter_interactions": op13_filter_interactions,
        "pipeline": corpus_pipeline.run,
    }


#: Exact integer inner products of quantised vectors; vectors with a null or non-finite component take no part.
_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

def _sql_without_dots(path: str) -> str:
    """A rooted path less its dot segments."""
    parts = f"string_split(regexp_replace({path}, '/(\\.\\.?)$', '/\\1/'), '/')[2:]"
    fold = "lambda own, x: CASE WHEN x[1] = '..' THEN own[1:greatest(len(own) - 1, 0)] WHEN x[1] = '.' THEN own ELSE list_concat(own, x) END"
    return f"'/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({parts}, lambda x: [x])), {fold}), '/')"


_SQL_LINK = "target"
for _name, _character in urls.REFERENCES:
    _SQL_LINK = f"replace({_SQL_LINK}, '{_name}', '{_character.replace(chr(39), chr(39) * 2)}')"
_SQL_LINK = f"trim(regexp_replace({_SQL_LINK}, '#.*$', ''))"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Rules, then decisions of the component reached over canonical links and refreshes.
_URL_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, html, rest, {_LOW.format("coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM p
), named AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS root FROM h),
links AS (
  SELECT host, root, host || root || query AS src, unnest([
    regexp_replace(regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*[\s"'']rel\s*=\s*(?:(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?'')[^>]*>|canonical(?:[\s/][^>]*)?>)'),
      '(?i)[\s"'']href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g'),
    regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*[\s"'']http-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target
  FROM named WHERE rest IS NOT NULL AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))
), plain AS (SELECT host, root, src, {_SQL_LINK} AS link FROM links WHERE target <> ''),
full_links AS (
  SELECT *, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(link, strpos(link, '://') + 3) WHEN link LIKE '//%' THEN substr(link, 3) END AS far,
    regexp_extract(link, '^[^?]*') AS near FROM plain WHERE link <> ''
), ends AS (
  SELECT src, CASE WHEN far IS NOT NULL THEN {_LOW.format("regexp_extract(far, '^[^/?]*')")} ELSE host END AS dst_host,
    CASE WHEN far IS NOT NULL THEN CASE WHEN regexp_extract(far, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(far, '^[^/?]*([^?]*)', 1) END
      WHEN near = '' THEN root WHEN near LIKE '/%' THEN near ELSE regexp_replace(root, '[^/]*$', '') || near END AS dst_path,
    regexp_extract(link, '\?.*$') AS dst_query
  FROM full_links WHERE far IS NOT NULL OR NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:')
), e AS (SELECT src, dst_host || {_sql_without_dots("dst_path")} || dst_query AS dst FROM ends),
both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach AS (SELECT src AS node, src AS other FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.other = b.src),
nodes AS (SELECT node, other, regexp_extract(other, '^([^/?#]*)', 1) AS host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
rules(rule, verdict, rule_host, rule_path) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
node_verdict AS (
  SELECT node, other, arg_max(verdict, length(rule)) AS verdict FROM nodes JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY node, other
), shared AS (SELECT node, min(verdict) AS verdict FROM node_verdict GROUP BY node),
own AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT h.page_id, h.host, h.path, own.rule, coalesce(own.verdict, shared.verdict, 'allow') AS verdict,
       own.verdict IS NULL AND shared.verdict IS NOT NULL AS by_alias
FROM named h LEFT JOIN own USING (page_id) LEFT JOIN shared ON h.rest IS NOT NULL AND shared.node = h.host || h.root || h.query
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_bit_sliced_topk": _TOPK_SQL, "op9_url_filter": _URL_SQL, "op11_source_mix": mixing.SQL, "op12_source_divergence": divergence.SQL, "op13_filter_interactions": interactions.SQL}
