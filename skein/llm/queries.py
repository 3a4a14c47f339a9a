"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import read
from skein.llm.decontaminate import decontaminate
from skein.llm.filter_audit import audit_filters
from skein.llm.fingerprints import fingerprint_documents
from skein.llm.gru_lm import score_documents
from skein.llm.jaccard_join import jaccard_join
from skein.llm.license_scan import scan_licenses
from skein.llm.periodic_runs import run_digests
from skein.llm.pieces import encode_documents
from skein.llm.quality_classifier import classify
from skein.llm.quality_rules import quality_rules
from skein.llm.secret_scan import find_secrets
from skein.llm.substring_dedup import repeated_documents
from skein.llm.token_counts import count_tokens


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_documents(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))



def op7_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), with_ids=False)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_gru_scores": op7_gru_scores,
    "op8_pieces": op8_pieces,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fingerprints": op13_fingerprints,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_MARKS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op11_filter_audit": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, part, t, {_MARKS} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (
  SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
x(k, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT p.k || q.k || r.k || s.k || u.k AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([p.b, q.b, r.b, s.b, u.b]) AS bit,
    unnest([0, p.b, p.b + q.b, p.b + q.b + r.b, p.b + q.b + r.b + s.b]) AS before
  FROM x p JOIN x q ON q.k <> p.k JOIN x r ON r.k NOT IN (p.k, q.k) JOIN x s ON s.k NOT IN (p.k, q.k, r.k) JOIN x u ON u.k NOT IN (p.k, q.k, r.k, s.k)),
rows AS (
  SELECT part, filter_order, step, bit, n, good, toxic, mask, (mask & bit) > 0 AS fails, (mask & before) > 0 AS gone FROM c, o),
steps AS (
  SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM rows GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM steps""",
    "op4_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_FOLDED} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM patterns) WHERE len(w) >= size),
hits AS (SELECT p.r, p.s, p.size, q.item_id FROM places p JOIN patterns q ON q.size = p.size AND q.k = array_to_string(p.w[p.s : p.s + p.size - 1], ' ')),
words AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(s, s + size)) AS place FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated, coalesce(items.ids, '') AS item_ids
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN items ON items.r = d.r""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[s : s + 3], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
texts AS (SELECT min(r) AS t, array_to_string(w, ' ') AS body FROM d WHERE len(w) > 0 GROUP BY body),
pairs AS (
  SELECT x.r AS a, y.r AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.k = y.k AND x.r < y.r
  WHERE x.r IN (SELECT t FROM texts) AND y.r IN (SELECT t FROM texts) GROUP BY x.r, y.r),
near AS (SELECT a, b FROM pairs JOIN sizes s ON s.r = a JOIN sizes m ON m.r = b WHERE 100 * pairs.n >= 85 * (s.n + m.n - pairs.n)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT t AS a, t AS b FROM texts UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
rows AS (SELECT d.doc_id, d.r, texts.t FROM d LEFT JOIN texts ON len(d.w) > 0 AND array_to_string(d.w, ' ') = texts.body),
least AS (SELECT reach.a AS t, min(rows.doc_id) AS doc_id FROM reach JOIN rows ON rows.t = reach.b GROUP BY reach.a)
SELECT rows.doc_id, coalesce(sizes.n, 0) AS n_shingles, CASE WHEN rows.t IS NULL THEN rows.doc_id ELSE least.doc_id END AS component_id
FROM rows LEFT JOIN sizes ON sizes.r = rows.r LEFT JOIN least ON least.t = rows.t""",
}
