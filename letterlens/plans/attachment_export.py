"""Attachment extraction over archives."""

from pyspark.sql import DataFrame, functions as F

from letterlens.functions.names import message_key
from letterlens.operators.attachments import attachment_rows, attachment_summary, late_attachments, named_attachments
from letterlens.operators.counters import attachment_counters
from letterlens.scale import materialize
from letterlens.sinks.logs import attachment_log, write_attachment_csv
from letterlens.sinks.messages import write_attachments, write_quarantine
from letterlens.sources.archives import first_messages

KEYS = ["archive", "msg_index"]
LOG_HEADERS = ["uuid", "date_raw", "from_raw", "subject_raw", "subject", "message_id"]


def attachment_outcomes(
    messages: DataFrame, pattern: str, limit: int | None = None, with_payload: bool = False, **options
) -> DataFrame:
    """Every message with its key, matching attachments, and stage and reason where something could not be read. Payloads
    are decoded for matching names only."""
    seen = first_messages(messages, limit).withColumn("uuid", message_key(F.col("archive"), F.col("msg_index")))
    sound = F.col("header_error").isNull()
    found = late_attachments(seen, pattern, with_payload=with_payload, where=sound, **options)
    return found.withColumns(
        {"stage": F.when(sound, F.col("stage")).otherwise("header"), "reason": F.coalesce("header_error", "reason")}
    )


def find_attachments(
    messages: DataFrame, pattern: str, limit: int | None = None, with_payload: bool = False, **options
) -> DataFrame:
    """Messages with matching attachments and a message key; payload bytes only on request."""
    found = attachment_outcomes(messages, pattern, limit, with_payload, **options)
    return found.filter(F.size("attachments") > 0).drop("stage", "reason")


def count_attachments(messages: DataFrame, pattern: str, limit: int | None = None, **options) -> DataFrame:
    """Dry run: counters per archive and in total (null archive)."""
    return attachment_counters(attachment_outcomes(messages, pattern, limit, **options))


def run_attachments(
    messages: DataFrame, pattern: str, output: str, limit: int | None = None, **options
) -> DataFrame:
    """Write matched messages, attachments, the log and the messages that could not be read in whole, with stage and
    reason; return the counters per archive and in total. Archives are read once. Of other messages only what is
    counted is stored."""
    judged = attachment_outcomes(messages, pattern, limit, with_payload=True, **options)
    kept = (F.size("attachments") > 0) | F.col("stage").isNotNull()
    counted = ("archive", "attachments", "stage")
    stored = materialize(
        judged.select(*(c if c in counted else F.when(kept, F.col(c)).alias(c) for c in judged.columns)), "attachments"
    )
    found = stored.filter(F.size("attachments") > 0)
    rows = attachment_rows(found, ["uuid"])
    write_attachments(named_attachments(rows, F.col("uuid")), f"{output}/attachments")
    found.select(F.concat("uuid", F.lit(".eml")).alias("file_name"), "raw").write.mode("append").parquet(
        f"{output}/messages"
    )
    log = attachment_log(attachment_summary(found, LOG_HEADERS))
    log.write.mode("append").parquet(f"{output}/log")
    write_attachment_csv(log, f"{output}/log_csv")
    write_quarantine(stored, KEYS, f"{output}/failed")
    return attachment_counters(stored)
