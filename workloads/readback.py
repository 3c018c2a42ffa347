"""Logs, reports and stores of whole jobs over the given tables, read back from their files."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from letterlens.operators.selection import select_routed
from letterlens.plans.attachment_export import find_attachments, run_attachments
from letterlens.plans.classification import run_classification, with_bytes
from letterlens.scale import scratch_path
from letterlens.sinks.logs import write_json
from letterlens.sinks.messages import read_routes, write_routes
from letterlens.sources.lists import read_patterns
from letterlens.sources.messages import read_message_files
from letterlens.sources.mime import with_headers
from workloads import table
from workloads.classification import RECORDED, recorded, routes
from workloads.mail import document_mail
from workloads.messages import PAGE_NAMES, PAGES, exported_files, parsed_pages
from workloads.stores import MATCHED, extracted

FIRST, LAST = "2025-01-10", "2029-06-30"
LEAST, MOST = 0.3, 0.9
CASES = "^P|\\.HTML$|7"
FILES = 200


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def select_confident(spark, folder):
    """Matched documents of a range of dates and confidences, from the store of routes."""
    path = scratch_path(spark, "routes")
    write_routes(with_bytes(with_headers(document_mail(spark, folder)), routes(spark, folder)), path)
    chosen = select_routed(read_routes(spark, path), ["matched"], LEAST, MOST, FIRST, LAST)
    doc_id = F.regexp_extract("file_name", r"_d(\d+)\.eml$", 1).cast("bigint")
    return chosen.select(doc_id.alias("doc_id"), "sender", F.round("confidence", 4).alias("confidence"))


def _classified(spark: SparkSession, folder: str) -> str:
    output = scratch_path(spark, "classification")
    mail = with_headers(document_mail(spark, folder))
    run_classification(mail, "system", "criteria", output, responses=recorded(spark, folder)).collect()
    return output


def classification_csv(spark, folder):
    """The classification log as written to CSV."""
    rows = _csv(spark, f"{_classified(spark, folder)}/log_csv")
    return rows.select(
        "filename", "llm_decision", F.round(F.col("confidence").cast("double"), 4).alias("confidence"),
        F.col("total_tokens").cast("bigint").alias("total_tokens"), "output_filename",
    )


def classification_report(spark, folder):
    """The JSON report of a run; its clock readings are left out."""
    report = spark.read.json(f"{_classified(spark, folder)}/report")
    counts = ("total_processed", "matched", "rejected", "failed", "input_tokens", "output_tokens", "total_tokens")
    return report.select(
        *(F.col(f"summary.{c}").cast("bigint").alias(c) for c in counts), "summary.total_cost_usd", "configuration.user_prompt"
    )


def extraction_csv(spark, folder):
    """The extraction log as written to CSV."""
    return _csv(spark, f"{extracted(spark, folder)}/log_csv").select("filename", "matched_keywords", "match_positions", "collision")


def extraction_json(spark, folder):
    """The extraction log as JSON lines, its lists unfolded."""
    path = scratch_path(spark, "json")
    write_json(spark.read.parquet(f"{extracted(spark, folder)}/log"), path)
    pairs = F.arrays_zip("matched_keywords", "match_positions")
    return spark.read.json(path).select("filename", F.inline(pairs)).select(
        "filename", F.col("matched_keywords").alias("keyword"), F.col("match_positions").alias("pos")
    )


def attachment_csv(spark, folder):
    """The attachment log as written to CSV."""
    output = scratch_path(spark, "attachments")
    run_attachments(parsed_pages(spark, folder), PAGE_NAMES, output).collect()
    rows = _csv(spark, f"{output}/log_csv")
    return rows.select(
        "message_id", "subject", F.col("attachment_count").cast("bigint").alias("attachment_count"), "attachment_names",
        "attachment_sizes", F.col("total_size_bytes").cast("bigint").alias("total_size_bytes"),
    )


def case_switch(spark, folder):
    """Pages by the name of their attachment, with letter case minded and not."""
    mail = parsed_pages(spark, folder)
    found = [
        find_attachments(mail, CASES, case_sensitive=minded, fold=False).select(F.lit(minded).alias("minded"), F.col("msg_index").alias("page_id"))
        for minded in (True, False)
    ]
    return found[0].unionByName(found[1])


def pattern_files(spark, folder):
    """First words of the test items as a folder of pattern files, with comments, blank lines and margins, read back."""
    path = scratch_path(spark, "patterns")
    words = table(spark, folder, "benchmark").select(F.regexp_extract("text", "[A-Za-z]+", 0).alias("word")).filter("word <> ''").distinct()
    lines = F.concat(F.lit("# "), "word", F.lit("\n\n  "), "word", F.lit("\t"))
    words.repartitionByRange(4, "word").sortWithinPartitions("word").select(lines.alias("value")).write.text(path)
    return read_patterns(spark, path)


def first_files(spark, folder):
    """The first files of a folder in path order."""
    found = read_message_files(spark, exported_files(spark, folder), limit=FILES)
    return found.select("file_name", "subject")


QUERIES = {
    f.__name__: f
    for f in (
        select_confident, classification_csv, classification_report, extraction_csv, extraction_json, attachment_csv, case_switch,
        pattern_files, first_files,
    )
}

NAMED = """
SELECT f.conv_id, f.turn, f.pattern_id, f.keyword, f.pos, strftime(TIMESTAMP '2024-01-01' + to_days((f.conv_id % 3650)::INTEGER) + to_minutes(f.turn), '%Y%m%d_%H%M%S')
  || '_' || role || f.conv_id || '_c' || f.conv_id || 't' || f.turn || '_' || CASE WHEN f.turn > 0 THEN 'Re_' ELSE '' END || 'Vlákno_' || f.conv_id || '.eml' AS filename
FROM firsts f JOIN conversations c ON f.conv_id = c.conv_id AND f.turn = c.turn WHERE nth = 1"""

SQL = {
    "select_confident": RECORDED + f"""
SELECT doc_id, lower(source) || '@docs.example.com' AS sender, round(confidence, 4) AS confidence FROM final
WHERE route = 'matched' AND confidence BETWEEN {LEAST} AND {MOST}
  AND (TIMESTAMP '2024-01-01' + to_days((doc_id % 3650)::INTEGER))::DATE BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
    "classification_csv": RECORDED + """
SELECT 'd' || doc_id || '.eml' AS filename, label AS llm_decision, round(confidence, 4) AS confidence,
  (tokens_in + tokens_out)::BIGINT AS total_tokens,
  CASE WHEN k <= 0 THEN 'failed' ELSE lpad(floor(confidence * 100)::INTEGER::VARCHAR,
    CASE WHEN confidence >= 1 THEN 3 ELSE 2 END, '0') END || '_d' || doc_id || '.eml' AS output_filename
FROM final""",
    "classification_report": RECORDED + """,
spent AS (SELECT sum(tokens_in)::BIGINT AS input_tokens, sum(length(content))::BIGINT AS output_tokens FROM made)
SELECT count(*) AS total_processed, count(*) FILTER (WHERE route = 'matched') AS matched,
  count(*) FILTER (WHERE route = 'rejected') AS rejected, count(*) FILTER (WHERE route = 'failed') AS failed,
  any_value(input_tokens) AS input_tokens, any_value(output_tokens) AS output_tokens,
  any_value(input_tokens + output_tokens) AS total_tokens,
  any_value(round(input_tokens / 1e6 * 0.15 + output_tokens / 1e6 * 0.60, 4)) AS total_cost_usd, 'criteria' AS user_prompt
FROM final, spent""",
    "extraction_csv": MATCHED + f"""
SELECT filename, string_agg(keyword, ', ' ORDER BY pattern_id, pos) AS matched_keywords,
  string_agg(pos::VARCHAR, ', ' ORDER BY pattern_id, pos) AS match_positions, 'False' AS collision FROM ({NAMED}) GROUP BY filename""",
    "extraction_json": MATCHED + f"SELECT filename, keyword, pos FROM ({NAMED})",
    "attachment_csv": PAGES + """
SELECT '<p' || page_id || '@example.com>' AS message_id, url AS subject, 1::BIGINT AS attachment_count, name AS attachment_names,
  size::VARCHAR AS attachment_sizes, size AS total_size_bytes FROM att""",
    "case_switch": PAGES + f"""
SELECT true AS minded, page_id FROM named WHERE size > 0 AND regexp_matches(name, '{CASES}')
UNION ALL SELECT false, page_id FROM named WHERE size > 0 AND regexp_matches(name, '{CASES}', 'i')""",
    "pattern_files": """
SELECT row_number() OVER (ORDER BY word) - 1 AS pattern_id, word AS pattern
FROM (SELECT DISTINCT regexp_extract(text, '[A-Za-z]+', 0) AS word FROM benchmark) WHERE word <> ''""",
    "first_files": f"""
SELECT 'c' || conv_id || '_t' || turn || '.eml' AS file_name, CASE WHEN turn > 0 THEN 'Re: ' ELSE '' END || 'Vlákno ' || conv_id AS subject
FROM conversations ORDER BY file_name LIMIT {FILES}""",
}
