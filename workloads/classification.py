"""Classification over all documents, with answers derived from the labels; without a label, none came."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from letterlens.operators.classify import (
    KEYS, by_confidence, candidates, classification_log, confidence_band, cost_projection, final_attempts,
    parsed_attempts, route_counts, routed, token_totals, user_message,
)
from letterlens.sources.mime import with_headers, with_parts
from workloads import table
from workloads.mail import document_mail

PRICES = [("low", 0.15, 0.60), ("mid", 2.50, 10.00), ("high", 10.00, 30.00)]


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded attempts: every label gets an answer; some first answers are unusable, and some of
    those stay unusable at the second attempt. All rows are kept, the cases only differ in content."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    rows = docs.join(table(spark, folder, "labels"), "doc_id")
    case = F.col("n_chars") % 10
    good = F.format_string(
        '{"is_match": %s, "confidence": 0.%02d, "reasoning": "quality %d, toxic %d"}',
        (F.col("quality") == 1).cast("string"), F.col("n_chars") % 100, "quality", "toxic",
    )
    first = (
        F.when(case == 0, F.lit("no json"))
        .when(case == 1, F.lit('{"confidence": 0.5}'))
        .when(case == 2, F.lit('{"is_match": "false", "confidence": 1.0}'))
        .when(case == 3, F.lit('{"is_match": null, "confidence": 0.29}'))
        .when(case == 4, F.lit('{"is_match": 0, "confidence": 0.57, "reasoning": "none"}'))
        .otherwise(good)
    )
    second = F.when(case == 0, F.lit('{"is_match": true}')).when(case == 1, good)
    answers = F.array(
        F.struct(F.lit(0).alias("attempt"), first.alias("content"), F.lit(300).cast("bigint").alias("prompt_tokens")),
        F.struct(F.lit(1).alias("attempt"), second.alias("content"), F.lit(310).cast("bigint").alias("prompt_tokens")),
    )
    made = rows.select(
        F.col("source").alias("archive"), F.col("doc_id").alias("msg_index"), F.inline(answers)
    ).filter(F.col("content").isNotNull())
    return made.select(
        *KEYS, "attempt", "content", "prompt_tokens", F.length("content").cast("bigint").alias("completion_tokens"),
        F.lit(None).cast("string").alias("error"),
    )


def routes(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates(with_parts(with_headers(document_mail(spark, folder))))
    return routed(found, final_attempts(parsed_attempts(recorded(spark, folder))))


def classify_candidates(spark, folder):
    found = candidates(with_parts(with_headers(document_mail(spark, folder))))
    return found.select("msg_index", F.sha2(user_message("Is this about work?"), 256).alias("prompt_digest"))


def classify_log(spark, folder):
    log = classification_log(routes(spark, folder))
    return log.select(
        "filename", "llm_decision", F.round("confidence", 4).alias("confidence"), "reasoning", "prompt_tokens",
        "completion_tokens", "total_tokens", "error_message", "from_address", "subject", "output_filename", "attempts",
    )


def classify_routes(spark, folder):
    return routes(spark, folder).groupBy("route").agg(
        F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens")
    )


def route_quality(spark, folder):
    return route_counts(routes(spark, folder))


def classify_cost(spark, folder):
    totals = token_totals(recorded(spark, folder))
    return totals.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


def cost_per_thousand(spark, folder):
    projected = cost_projection(token_totals(recorded(spark, folder)), PRICES)
    return projected.withColumn("cost_usd", F.round("cost_usd", 6))


def confidence_bands(spark, folder):
    rows = routes(spark, folder).filter("route <> 'failed'")
    return rows.groupBy(confidence_band(F.col("confidence")).cast("bigint").alias("band")).agg(F.count("*").alias("n"))


def most_confident(spark, folder):
    top = by_confidence(routes(spark, folder), 20)
    return top.select("archive", "msg_index", F.round("confidence", 4).alias("confidence"))


QUERIES = {
    "classify_candidates": classify_candidates,
    "classify_log": classify_log,
    "classify_routes": classify_routes,
    "route_quality": route_quality,
    "classify_cost": classify_cost,
    "cost_per_thousand": cost_per_thousand,
    "confidence_bands": confidence_bands,
    "most_confident": most_confident,
}

GOOD = """'{"is_match": ' || (quality = 1)::VARCHAR || ', "confidence": 0.' || lpad((n_chars % 100)::VARCHAR, 2, '0')
  || ', "reasoning": "quality ' || quality || ', toxic ' || toxic || '"}'"""
RECORDED = f"""
WITH d AS (SELECT d.doc_id, d.source, d.text, d.n_chars, l.quality, l.toxic,
             CASE WHEN l.doc_id IS NULL THEN -1 ELSE n_chars % 10 END AS k
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
made AS (
  SELECT *, 0 AS attempt, 300 AS tokens_in, CASE k
    WHEN 0 THEN 'no json' WHEN 1 THEN '{{"confidence": 0.5}}' WHEN 2 THEN '{{"is_match": "false", "confidence": 1.0}}'
    WHEN 3 THEN '{{"is_match": null, "confidence": 0.29}}'
    WHEN 4 THEN '{{"is_match": 0, "confidence": 0.57, "reasoning": "none"}}' ELSE {GOOD} END AS content FROM d WHERE k >= 0
  UNION ALL
  SELECT *, 1, 310, CASE k WHEN 0 THEN '{{"is_match": true}}' ELSE {GOOD} END FROM d WHERE k IN (0, 1)),
final AS (
  SELECT doc_id, source, k, CASE WHEN k <= 0 THEN 'failed' WHEN k = 2 THEN 'matched' WHEN k IN (3, 4) THEN 'rejected'
      WHEN quality = 1 THEN 'matched' ELSE 'rejected' END AS route,
    CASE k WHEN -1 THEN 0.0 WHEN 0 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.29 WHEN 4 THEN 0.57 ELSE (n_chars % 100) / 100.0 END::DOUBLE
      AS confidence,
    CASE k WHEN -1 THEN 'error' WHEN 0 THEN 'error' WHEN 2 THEN 'false' WHEN 3 THEN 'none' WHEN 4 THEN '0'
      ELSE (quality = 1)::VARCHAR END AS label,
    CASE WHEN k IN (-1, 0, 2, 3) THEN '' WHEN k = 4 THEN 'none' ELSE 'quality ' || quality || ', toxic ' || toxic END
      AS reasoning,
    CASE k WHEN -1 THEN 0 WHEN 0 THEN 0 WHEN 1 THEN 310 ELSE 300 END AS tokens_in,
    CASE k WHEN -1 THEN 0 WHEN 0 THEN 0 ELSE length((SELECT m.content FROM made m WHERE m.doc_id = d.doc_id
      AND m.attempt = CASE k WHEN 1 THEN 1 ELSE 0 END)) END AS tokens_out
  FROM d)
"""
SPACES = "chr(9) || chr(10) || chr(13) || ' ' || chr(160)"
SENT = f"""WITH s AS (SELECT d.*, 'Is this about work?' AS criteria,
    strftime(TIMESTAMP '2024-01-01' + to_days((d.doc_id % 3650)::INTEGER), '%a, %d %b %Y %H:%M:%S') || ' +0100' AS sent,
    CASE WHEN length(trim(text, {SPACES})) < 20 THEN text ELSE trim(text, {SPACES}) END AS reply
  FROM documents d)
"""
PROMPT_DIGEST = """sha256(criteria || chr(10) || chr(10) || 'EMAIL TO ANALYZE:' || chr(10)
  || 'From: Účastník <' || source || '@docs.example.com>' || chr(10) || 'Date: ' || sent || chr(10)
  || 'Subject: Dokument ' || doc_id || chr(10) || chr(10) || substring(reply, 1, 4000) || chr(10) || chr(10)
  || 'Respond with JSON only:' || chr(10)
  || '{"is_match": true/false, "confidence": 0.95, "reasoning": "brief explanation"}')"""

SQL = {
    "classify_candidates": f"""
{SENT}SELECT doc_id AS msg_index, {PROMPT_DIGEST} AS prompt_digest
FROM s""",
    "classify_log": RECORDED + """
SELECT 'd' || doc_id || '.eml' AS filename, label AS llm_decision, round(confidence, 4) AS confidence, reasoning,
  tokens_in::BIGINT AS prompt_tokens, tokens_out::BIGINT AS completion_tokens,
  (tokens_in + tokens_out)::BIGINT AS total_tokens,
  CASE WHEN k = -1 THEN 'No response' WHEN k = 0 THEN 'Invalid JSON structure' ELSE '' END AS error_message,
  'Účastník <' || source || '@docs.example.com>' AS from_address, 'Dokument ' || doc_id AS subject,
  CASE WHEN k <= 0 THEN 'failed' ELSE lpad(floor(confidence * 100)::INTEGER::VARCHAR,
    CASE WHEN confidence >= 1 THEN 3 ELSE 2 END, '0') END || '_d' || doc_id || '.eml' AS output_filename,
  CASE WHEN k = -1 THEN 0 WHEN k IN (0, 1) THEN 2 ELSE 1 END::BIGINT AS attempts
FROM final""",
    "classify_routes": RECORDED + """
SELECT route, count(*) AS n, sum(tokens_in)::BIGINT AS prompt_tokens FROM final GROUP BY route""",
    "route_quality": RECORDED + """
SELECT count(*) AS processed, count(*) FILTER (WHERE route = 'matched') AS matched,
  count(*) FILTER (WHERE route = 'rejected') AS rejected, count(*) FILTER (WHERE route = 'failed') AS failed,
  round(count(*) FILTER (WHERE route = 'matched') * 100.0 / count(*), 1)::DOUBLE AS matched_pct,
  round(count(*) FILTER (WHERE route = 'rejected') * 100.0 / count(*), 1)::DOUBLE AS rejected_pct,
  round(count(*) FILTER (WHERE route = 'failed') * 100.0 / count(*), 1)::DOUBLE AS failed_pct FROM final""",
    "classify_cost": RECORDED + """
SELECT sum(tokens_in)::BIGINT AS input_tokens, sum(length(content))::BIGINT AS output_tokens, count(*) AS calls,
  (sum(tokens_in) + sum(length(content)))::BIGINT AS total_tokens,
  round(sum(tokens_in)::DOUBLE / 1e6 * 0.15 + sum(length(content))::DOUBLE / 1e6 * 0.60, 6) AS total_cost_usd FROM made""",
    "cost_per_thousand": RECORDED + """
SELECT price_list, round((sum(tokens_in)::DOUBLE / 1e6 * p_in + sum(length(content))::DOUBLE / 1e6 * p_out) * 1000
  / count(*), 6) AS cost_usd
FROM made, (VALUES ('low', 0.15::DOUBLE, 0.60::DOUBLE), ('mid', 2.50, 10.00), ('high', 10.00, 30.00))
  AS prices(price_list, p_in, p_out) GROUP BY price_list, p_in, p_out""",
    "confidence_bands": RECORDED + """
SELECT CASE WHEN confidence >= 0.9 THEN 1 WHEN confidence >= 0.7 THEN 2 WHEN confidence >= 0.5 THEN 3 ELSE 4 END::BIGINT
  AS band, count(*) AS n FROM final WHERE route <> 'failed' GROUP BY band""",
    "most_confident": RECORDED + """
SELECT source AS archive, doc_id AS msg_index, round(confidence, 4) AS confidence FROM final
ORDER BY confidence DESC, source, doc_id LIMIT 20""",
}
