"""Mail made from the given tables by native expressions: whole tables, whole texts."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from letterlens.scale import scratch_path
from letterlens.sinks.messages import write_archive
from letterlens.sources.mime import with_headers
from workloads import text_table

DAYS = 3650


def encoded(text: Column) -> Column:
    """A header value as one encoded word."""
    return F.concat(F.lit("=?utf-8?B?"), _base64(text), F.lit("?="))


def _base64(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "utf-8")), r"\s", "")


def mail_date(day: Column, minute: Column) -> Column:
    days = F.pmod(day, F.lit(DAYS)).cast("int")
    moment = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(days, F.lit(0), minute.cast("int"))
    return F.concat(F.date_format(moment, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0100"))


def headers(sender: Column, to: Column, subject: Column, date: Column, message_id: Column) -> Column:
    return F.concat(
        F.lit("From: "), encoded(F.lit("Účastník")), F.lit(" <"), sender, F.lit(">\nTo: "), to,
        F.lit("\nSubject: "), encoded(subject), F.lit("\nDate: "), date,
        F.lit("\nMessage-ID: "), message_id, F.lit("\nMIME-Version: 1.0\n"),
    )


def text_part(text: Column, kind: str = "plain", extra: Column | None = None) -> Column:
    extra = F.lit("") if extra is None else extra
    return F.concat(
        F.lit(f"Content-Type: text/{kind}; charset=utf-8\nContent-Transfer-Encoding: base64\n"), extra,
        F.lit("\n"), _base64(text), F.lit("\n"),
    )


def as_bytes(message: Column) -> Column:
    return F.encode(message, "utf-8")


def role_address(role: Column) -> Column:
    return F.concat(role, F.col("conv_id").cast("string"), F.lit("@mail.example.com"))


def other_role() -> Column:
    return F.when(F.col("role") == "user", F.lit("assistant")).otherwise(F.lit("user"))


def conversation_subject() -> Column:
    thread = F.concat(F.lit("Vlákno "), F.col("conv_id").cast("string"))
    return F.when(F.col("turn") > 0, F.concat(F.lit("Re: "), thread)).otherwise(thread)


def conversation_raw(body: Column) -> Column:
    message_id = F.format_string("<c%d.t%d@example.com>", "conv_id", "turn")
    head = headers(
        role_address(F.col("role")), role_address(other_role()), conversation_subject(),
        mail_date(F.col("conv_id"), F.col("turn")), message_id,
    )
    return as_bytes(F.concat(head, text_part(body)))


def conversation_mail(spark: SparkSession, folder: str) -> DataFrame:
    """One message per turn: archive is the thread, msg_index the turn."""
    rows = text_table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return rows.select(
        F.col("conv_id").cast("string").alias("archive"), F.col("turn").alias("msg_index"),
        "conv_id", "turn", "role", conversation_raw(F.col("text")).alias("raw"),
    )


def parsed_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return with_headers(conversation_mail(spark, folder))


def conversation_archive(spark: SparkSession, folder: str) -> str:
    """Write the conversation mail as archive files in the shared folder; returns the path."""
    path = scratch_path(spark, "archive")
    write_archive(conversation_mail(spark, folder), path, ["conv_id", "turn"])
    return path


def document_mail(spark: SparkSession, folder: str) -> DataFrame:
    """One message per document; archive is the source, msg_index the document."""
    rows = text_table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    address = F.concat(F.col("source"), F.lit("@docs.example.com"))
    message_id = F.format_string("<d%d@example.com>", "doc_id")
    head = headers(
        address, F.concat(F.col("lang"), F.lit("@docs.example.com")), F.concat(F.lit("Dokument "), F.col("doc_id")),
        mail_date(F.col("doc_id"), F.lit(0)), message_id,
    )
    raw = as_bytes(F.concat(head, text_part(F.col("text"))))
    return rows.select(
        F.col("source").alias("archive"), F.col("doc_id").alias("msg_index"),
        F.format_string("d%d.eml", "doc_id").alias("file_name"), raw.alias("raw"),
    )


def page_mail(spark: SparkSession, folder: str) -> DataFrame:
    """One multipart message per page: a text part, and the page as an attachment named by the end of
    its address. archive is the part of the address up to the host."""
    rows = text_table(spark, folder, "pages", "page_id", "url", "html").withColumn("page_name", F.element_at(F.split("url", "/"), -1))
    head = headers(
        F.lit("crawler@web.example.com"), F.lit("archive@web.example.com"), F.col("url"),
        mail_date(F.col("page_id"), F.lit(0)), F.format_string("<p%d@example.com>", "page_id"),
    )
    named = F.concat(F.lit('Content-Disposition: attachment; filename="'), encoded(F.col("page_name")), F.lit('"\n'))
    raw = as_bytes(
        F.concat(
            head, F.lit('Content-Type: multipart/mixed; boundary="=_page"\n\n--=_page\n'),
            text_part(F.concat(F.lit("Saved from "), F.col("url"))), F.lit("\n--=_page\n"),
            text_part(F.col("html"), "html", named), F.lit("\n--=_page--\n"),
        )
    )
    return rows.select(
        F.element_at(F.split("url", "/"), 3).alias("archive"), F.col("page_id").alias("msg_index"), raw.alias("raw")
    )
