"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import language_id, quality
from foliant.llm.chat_repair import repair_chats
from foliant.llm.common import id_crc, read_table
from foliant.llm.decontaminate import contamination
from foliant.llm.exact_dedup import exact_groups
from foliant.llm.filter_audit import audit
from foliant.llm.jaccard_join import jaccard_components
from foliant.llm.license_scan import licenses
from foliant.llm.mixing import mix
from foliant.llm.pii import personal_data
from foliant.llm.sharding import assign
from foliant.llm.token_alignment import align
from foliant.llm.url_filter import judge_urls


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    dictionaries = language_id.train(docs.filter(~held_out))
    found = language_id.identify(docs, dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "draws")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    model = quality.train(docs, labels.filter(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(read_table(spark, sf_dir, "conversations"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_language_id, op2_mixing, op3_decontamination, op4_ngram_jaccard, op5_url_filter, op6_quality, op7_exact_dedup, op8_chat_format,
            op9_personal_data, op10_licenses, op11_token_alignment, op12_filter_audit, op13_sharding,
        )
    }


ALPHA = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {ALPHA}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH item AS (SELECT item_id, {WORDS} AS w FROM benchmark),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
  FROM item, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM doc, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)
),
found AS (SELECT DISTINCT spot.doc_id, i, spot.n, item_id FROM spot JOIN win USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP4 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ALPHA}), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k
  FROM doc, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM sh a JOIN sh b USING (k) JOIN size sa ON sa.doc_id = a.doc_id JOIN size sb ON sb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(sa.n, sb.n) >= 90 * greatest(sa.n, sb.n)
  GROUP BY a.doc_id, b.doc_id, sa.n, sb.n HAVING 100 * count(*) >= 90 * (sa.n + sb.n - count(*))
),
reach AS (
  SELECT x AS doc_id, y AS other FROM link
  UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON reach.other = link.x
)
SELECT doc.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(doc.doc_id, coalesce(min(other), doc.doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY doc.doc_id
"""

OP7 = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
),
best AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS r FROM norm),
grp AS (SELECT text_sha256, min(doc_id) FILTER (WHERE r = 1) AS keep_id, count(*) AS group_size FROM best GROUP BY text_sha256)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
FROM norm JOIN grp USING (text_sha256)
"""


OP12 = r"""
WITH doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS f
  FROM doc
),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
cell AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failing LEFT JOIN lab USING (doc_id) GROUP BY part, f
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
),
place AS (
  SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS x, left(filter_order, CAST(step AS INT) - 1) AS earlier
  FROM orders, unnest(range(1, 6)) AS u(step)
),
asked AS (
  SELECT part, filter_order, step, x, n, good, toxic, f, contains(f, x) AS own, translate(earlier, f, '') = earlier AS came FROM place, cell
),
answer AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE came AND NOT own), 0) AS kept, coalesce(sum(n) FILTER (WHERE came AND own), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE own AND NOT came), 0) AS redundant, coalesce(sum(n) FILTER (WHERE f = x), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE came AND own), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE came AND own), 0) AS toxic_lost
  FROM asked GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM answer
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3, "op4_ngram_jaccard": OP4, "op7_exact_dedup": OP7, "op12_filter_audit": OP12}
