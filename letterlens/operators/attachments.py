"""Attachments selected by file name."""

from pyspark.sql import Column, DataFrame, functions as F

from letterlens.functions.names import attachment_file_name
from letterlens.functions.regex import compile_check, java_pattern
from letterlens.functions.text import fold_european
from letterlens.sources.mime import with_part_names, with_payloads


def matching_parts(
    pattern: str, case_sensitive: bool = False, fold: bool = True, parts: str = "parts"
) -> Column:
    """The matching attachments of a message, numbered from 1 in part order.

    Names are folded to lower case before the match, so a case-sensitive pattern with capitals
    finds nothing unless fold=False.
    """
    named = _is_named(pattern, case_sensitive, fold)
    found = F.filter(F.col(parts), lambda p: named(p) & (p["size"] > 0))
    return F.transform(found, lambda p, i: _attachment(p, i, p["size"], p["payload"]))


def _is_named(pattern: str, case_sensitive: bool, fold: bool):
    compile_check([pattern])

    def named(part: Column) -> Column:
        name = fold_european(part["filename"]) if fold else part["filename"]
        return (
            (part["main_type"] != "multipart")
            & (F.coalesce(part["filename"], F.lit("")) != "")
            & name.rlike(java_pattern(pattern, case_sensitive))
        )

    return named


def _attachment(part: Column, i: Column, size: Column, payload: Column) -> Column:
    return F.struct(
        (i + 1).alias("ordinal"),
        fold_european(part["filename"]).alias("folded_name"),
        part["filename"].alias("filename"),
        part["content_type"].alias("content_type"),
        size.alias("size"),
        payload.alias("payload"),
    )


def late_attachments(
    messages: DataFrame, pattern: str, case_sensitive: bool = False, fold: bool = True, with_payload: bool = False,
    where: Column | None = None,
) -> DataFrame:
    """messages with attachments, stage and reason. Names are read and matched first; only the parts whose name matches are
    decoded, and only their bytes leave the parser, if asked for. Parts without content are no attachments.

    A fault in a name ends the list of names, one in a payload the list of payloads; what was found before it stays, and
    stage ("names" or "payload") and reason tell. With a condition, other messages are not parsed and have none."""
    kept = messages.columns
    named = with_part_names(messages, where)
    named = named.withColumn("named", F.filter("parts", _is_named(pattern, case_sensitive, fold))).drop("parts", "is_multipart")
    loaded = with_payloads(named, F.transform("named", lambda p: p["ord"]), with_payload)
    # The payload pass keeps the order of the names, and stops early at a fault.
    both = F.filter(F.arrays_zip("named", "loaded"), lambda b: b["loaded"]["size"] > 0)
    items = F.transform(both, lambda b, i: _attachment(b["named"], i, b["loaded"]["size"], b["loaded"]["payload"]))
    error = F.coalesce("parse_error", "load_error")
    stage = F.when(F.col("parse_error").isNotNull(), "names").when(F.col("load_error").isNotNull(), "payload")
    return loaded.select(*kept, F.coalesce(items, F.array()).alias("attachments"), stage.alias("stage"), error.alias("reason"))


def with_attachments(messages: DataFrame, pattern: str, **options) -> DataFrame:
    """Messages with at least one matching attachment; parts are replaced by attachments."""
    kept = [c for c in messages.columns if c not in ("parts", "is_multipart", "parse_error")]
    found = messages.withColumn("attachments", matching_parts(pattern, **options))
    return found.filter(F.size("attachments") > 0).select(*kept, "attachments")


def attachment_rows(matched: DataFrame, keys: list[str]) -> DataFrame:
    """One row per attachment."""
    return matched.select(*keys, F.inline("attachments"))


def named_attachments(rows: DataFrame, message_key: Column) -> DataFrame:
    return rows.withColumn("file_name", attachment_file_name(message_key, F.col("ordinal"), F.col("filename")))


def attachment_summary(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Count, names, sizes, types and total size per message; no shuffle, the list is in the row."""
    items = F.col("attachments")
    return matched.select(
        *keys,
        F.size(items).alias("attachment_count"),
        F.transform(items, lambda a: a["filename"]).alias("attachment_names"),
        F.transform(items, lambda a: a["size"]).alias("attachment_sizes"),
        F.transform(items, lambda a: a["content_type"]).alias("attachment_types"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, a: acc + a["size"]).alias("total_size_bytes"),
    )


def of_types(rows: DataFrame, content_types: list[str]) -> DataFrame:
    return rows.filter(F.col("content_type").isin([t.lower() for t in content_types]))


def of_sizes(rows: DataFrame, smallest: int = 0, largest: int | None = None) -> DataFrame:
    kept = rows.filter(F.col("size") >= smallest)
    return kept if largest is None else kept.filter(F.col("size") <= largest)


def distinct_contents(rows: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """One row per distinct content: digest, the first key as kept, and the number of copies.

    Only digests and keys are shuffled, after counting per task, so many copies cost little.
    """
    return (
        rows.select(F.sha2(F.col(content), 256).alias("digest"), F.struct(*keys).alias("key"))
        .groupBy("digest")
        .agg(F.min("key").alias("kept"), F.count("*").alias("copies"))
        .select("digest", "kept.*", "copies")
    )
