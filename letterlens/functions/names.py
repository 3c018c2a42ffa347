"""File names and tokens derived from message fields."""

from pyspark.sql import Column, functions as F

from letterlens.fixed_values import (
    FILE_NAME_LENGTH, FORBIDDEN_IN_NAMES, MESSAGE_ID_LENGTH, NAME_PART_LENGTH,
)
from letterlens.functions.regex import SPACE
from letterlens.functions.text import is_blank


def safe_name_part(text: Column, length: int = 50) -> Column:
    """Text usable in a file name; the cut comes after the underscore trim."""
    replaced = F.translate(F.coalesce(text, F.lit("")), FORBIDDEN_IN_NAMES, "_" * len(FORBIDDEN_IN_NAMES))
    joined = F.regexp_replace(replaced, f"(?U)(?:{SPACE}|_)+", "_")
    part = F.substring(F.btrim(joined, F.lit("_")), 1, length)
    return F.when(part == "", F.lit("unknown")).otherwise(part)


def message_id_token(message_id: Column) -> Column:
    bare = F.split_part(F.btrim(message_id, F.lit("<>")), F.lit("@"), F.lit(1))
    token = F.substring(F.regexp_replace(bare, "[^a-zA-Z0-9]", ""), 1, MESSAGE_ID_LENGTH)
    return F.when(F.coalesce(message_id, F.lit("")) == "", F.lit("nomsgid")).otherwise(token)


def date_token(date_wall: Column) -> Column:
    # Made from the written digits: formatting would pass through the session's time zone.
    return F.coalesce(F.translate(date_wall.cast("string"), " -:", "_"), F.lit("00000000_000000"))


def message_file_name(date_wall: Column, from_addrs: Column, message_id: Column, subject: Column) -> Column:
    """Date, sender's local part, Message-ID token and subject, joined into an .eml name."""
    local_part = F.split_part(F.get(from_addrs, F.lit(0)), F.lit("@"), F.lit(1))
    sender = F.when(F.size(from_addrs) > 0, safe_name_part(local_part, NAME_PART_LENGTH)).otherwise("unknown")
    topic = F.when(is_blank(subject), F.lit("no_subject")).otherwise(safe_name_part(subject, NAME_PART_LENGTH))
    name = F.concat(
        F.concat_ws("_", date_token(date_wall), sender, message_id_token(message_id), topic), F.lit(".eml")
    )
    cut = F.concat(F.substring(name, 1, FILE_NAME_LENGTH - 4), F.lit(".eml"))
    return F.when(F.length(name) > FILE_NAME_LENGTH, cut).otherwise(name)


def extension(file_name: Column) -> Column:
    """The part from the last dot on; empty when the name has none besides leading dots."""
    return F.regexp_extract(file_name, r"[^/.][^/]*(\.[^./]*)\z", 1)


def attachment_file_name(message_key: Column, ordinal: Column, original_name: Column) -> Column:
    ext = extension(original_name)
    return F.format_string(
        "%s_%03d%s", message_key, ordinal.cast("int"), F.when(ext == "", F.lit(".bin")).otherwise(ext)
    )


def message_key(archive: Column, msg_index: Column) -> Column:
    """A key that is the same on every run, unlike a random one."""
    return F.sha2(F.concat_ws("|", archive, msg_index.cast("string")), 256)


def confidence_name(confidence: Column, file_name: Column) -> Column:
    """The whole percentage before the name; truncated on the double, as int() does."""
    return F.format_string("%02d_%s", (confidence.cast("double") * 100).cast("int"), file_name)


def numbered_name(file_name: Column, repeat: Column) -> Column:
    """file.eml, file_001.eml, file_002.eml for repeat 0, 1, 2."""
    ext = extension(file_name)
    stem = F.left(file_name, F.length(file_name) - F.length(ext))
    return F.when(repeat == 0, file_name).otherwise(
        F.concat(stem, F.format_string("_%03d", repeat.cast("int")), ext)
    )
