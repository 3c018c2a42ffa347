"""Logs and reports."""

from pyspark.sql import DataFrame, functions as F

from letterlens.fixed_values import ATTACHMENT_LOG, CLASSIFICATION_LOG, EXTRACTION_LOG
from letterlens.functions.text import subject_or_default
from letterlens.operators.keywords import joined_keywords, joined_positions


def extraction_log(matches: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The typed extraction log; sender, recipient and date are the raw headers."""
    narrow = matches.select(
        *keys, F.coalesce("date_raw", F.lit("")).alias("date"), F.coalesce("from_raw", F.lit("")).alias("from_address"),
        F.coalesce("to_raw", F.lit("")).alias("to"), subject_or_default(F.col("subject")).alias("subject"),
        F.transform("hits", lambda h: h["keyword"]).alias("matched_keywords"),
        F.transform("hits", lambda h: h["pos"]).alias("match_positions"),
    )
    named = names.select(*keys, F.col("file_name").alias("filename"), F.col("base").alias("original_filename"), "collision")
    return narrow.join(named, keys).select(*EXTRACTION_LOG)


def attachment_log(summary: DataFrame, key: str = "uuid") -> DataFrame:
    """The typed attachment log over an attachment summary that carries the header columns."""
    return summary.select(
        F.col(key).alias("uuid"),
        F.concat(F.col(key), F.lit(".eml")).alias("eml_filename"),
        F.coalesce("date_raw", F.lit("")).alias("date"),
        F.coalesce("from_raw", F.lit("")).alias("from_address"),
        # Only a missing subject gets the default here; a blank one stays blank.
        F.when(F.col("subject_raw").isNull(), "(No Subject)").otherwise(F.col("subject")).alias("subject"),
        F.coalesce("message_id", F.lit("")).alias("message_id"),
        *ATTACHMENT_LOG[6:11],
        F.lit(None).cast("bigint").alias("processing_time_ms"),
    )


def _csv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_extraction_csv(log: DataFrame, path: str) -> None:
    """Appends; lists become comma-joined text and the flag the words True and False."""
    flat = log.withColumns(
        {
            "matched_keywords": F.array_join("matched_keywords", ", "),
            "match_positions": F.array_join(F.col("match_positions").cast("array<string>"), ", "),
            "collision": F.initcap(F.col("collision").cast("string")),
        }
    )
    _csv(flat.select(*EXTRACTION_LOG), path, "append")


def write_attachment_csv(log: DataFrame, path: str) -> None:
    """Appends; lists are joined by a bar."""
    lists = ("attachment_names", "attachment_sizes", "attachment_types")
    flat = log.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " | ") for c in lists})
    _csv(flat.select(*ATTACHMENT_LOG), path, "append")


def write_classification_csv(log: DataFrame, path: str) -> None:
    """Overwrites."""
    _csv(log.select(*CLASSIFICATION_LOG), path, "overwrite")


def run_report(routes: DataFrame, totals: DataFrame, elapsed: float, configuration: dict[str, str]) -> DataFrame:
    """One row: summary and configuration structs, as written to the JSON report."""
    sums = routes.select("processed", "matched", "rejected", "failed", F.lit(1).alias("one"))
    both = sums.join(totals.withColumn("one", F.lit(1)), "one")
    seconds = F.lit(float(elapsed))
    return both.select(
        F.struct(
            F.col("processed").alias("total_processed"), "matched", "rejected", "failed", "total_tokens",
            "input_tokens", "output_tokens", F.round("total_cost_usd", 4).alias("total_cost_usd"),
            F.round(seconds, 2).alias("processing_time_seconds"),
            F.round(F.try_divide(F.col("processed"), seconds), 2).alias("average_speed_emails_per_sec"),
        ).alias("summary"),
        F.struct(*[F.lit(v).alias(k) for k, v in configuration.items()]).alias("configuration"),
    )


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_json(log: DataFrame, path: str) -> None:
    """A log as JSON lines; lists stay lists."""
    log.write.mode("append").json(path)


def keyword_columns(matches: DataFrame) -> DataFrame:
    """Joined keyword and position text, for consumers of the flat log."""
    return matches.withColumns(
        {"matched_keywords": joined_keywords(F.col("hits")), "match_positions": joined_positions(F.col("hits"))}
    )
