"""The queries of this subpackage for __spark_entry__.py, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgram.llm import decontaminate, folds, langid, lines, mixing, quality, simhash, suffixes, toxicity, urls, warc
from siftgram.llm.shared import scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), to)
    got = warc.read_archives(spark, to, manifest, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP1 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
FROM q
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, langid.train(docs))
    return got.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"), "fail_bits",
    )


_OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), t AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines
  FROM d LEFT JOIN n ON d.doc_id = n.doc_id
), b AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END
         + CASE WHEN 10 * n_symbols > 4 * n_words THEN 16 ELSE 0 END
         + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END AS bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed,
       (bits & 51) = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits
FROM b
"""

def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.dropped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


_OP5 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1:' || md5(coalesce(text, ''))) AS hk
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight, 2 * source_size AS cap FROM s
), b AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, CAST(total * 150 - 100 * cap_before AS DOUBLE) / (100 * (all_weight - weight_before)) AS level FROM b
), f AS (
  SELECT *, cap <= level * weight AS full_, arg_min(level, CAST(cap AS DOUBLE) / weight) FILTER (WHERE NOT (cap <= level * weight)) OVER () AS shared FROM l
), g AS (
  SELECT source, source_size, CASE WHEN full_ THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), shared * weight) END AS target FROM f
), h AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM g
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY hk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM d
)
SELECT p.doc_id, p.size, h.source_size, h.target,
       CAST(h.epochs * p.size + greatest(0, least(p.size, h.budget - h.epochs * h.source_size - p.prefix)) AS BIGINT) AS taken
FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source
"""


_OP10 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages
), d AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
), v AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS decided FROM d
), sd AS (
  SELECT k.kind, host, count(*) FILTER (decided = k.kind) AS m FROM v, (VALUES ('allow'), ('block')) k(kind) WHERE host <> ''
  GROUP BY ALL HAVING 2 * count(*) FILTER (decided = k.kind) > count(*)
), e AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
), w AS (
  SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM (SELECT 'allow' AS kind, src, dst, n FROM e UNION ALL SELECT 'block', dst, src, n FROM e)
), s AS (
  SELECT 0 AS i, kind, host, m / sum(m) OVER (PARTITION BY kind) AS t FROM sd
  UNION ALL
  SELECT any_value(s.i) + 1, w.kind, w.dst, sum(s.t * w.share * 0.85) FROM s JOIN w ON s.kind = w.kind AND s.host = w.src WHERE s.i < 57 GROUP BY w.kind, w.dst
), r AS (
  SELECT kind, host, sum(t) / sum(sum(t)) OVER (PARTITION BY kind) AS rank FROM s GROUP BY kind, host
), b AS (
  SELECT host FROM r GROUP BY host HAVING coalesce(sum(rank) FILTER (kind = 'block'), 0) > 0.5 * sum(rank)
)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup, "op4_line_dedup": op4_line_dedup, "op8_language_id": op8_language_id, "op6_toxicity": op6_toxicity, "op7_simhash_dedup": op7_simhash_dedup, "op1_warc": op1_warc, "op2_decontamination": op2_decontamination, "op5_mixing": op5_mixing, "op9_quality_rules": op9_quality_rules, "op10_url_filters": op10_url_filters}
ORACLES = {"op1_warc": _OP1, "op2_decontamination": _OP2, "op5_mixing": _OP5, "op9_quality_rules": _OP9, "op10_url_filters": _OP10}
