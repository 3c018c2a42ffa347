"""Text columns: folding, trimming, HTML stripping, search text, immediate reply."""

import re

from pyspark.sql import Column, functions as F

from letterlens.fixed_values import (
    CZECH_ASCII, CZECH_LETTERS, EUROPEAN_ASCII, EUROPEAN_LETTERS, MIN_BODY_LENGTH, MIN_REPLY_LENGTH,
    QUOTE_LINE_PATTERNS, WHITESPACE,
)
from letterlens.functions.arrays import let
from letterlens.functions.regex import FLAGS_IGNORE_CASE, SPACE


def fold_czech(text: Column) -> Column:
    """Lower case without Czech diacritics; null becomes empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), CZECH_LETTERS, CZECH_ASCII)


def fold_european(text: Column) -> Column:
    """Lower case without common European diacritics; null becomes empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), EUROPEAN_LETTERS, EUROPEAN_ASCII)


def strip(text: Column) -> Column:
    """Remove all Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return strip(F.coalesce(text, F.lit(""))) == ""


def strip_tags(html: Column) -> Column:
    """Replace tags by spaces, collapse whitespace, trim. Script text and entities stay."""
    spaced = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")
    return strip(F.regexp_replace(spaced, f"(?U){SPACE}+", " "))


def subject_or_default(subject: Column) -> Column:
    return F.when(is_blank(subject), F.lit("(No Subject)")).otherwise(subject)


def search_text(subject: Column, body: Column) -> Column:
    """Subject and body joined by a space; the subject alone when the body is next to empty."""
    subject = subject_or_default(subject)
    return let(
        F.coalesce(body, F.lit("")),
        lambda b: F.when(F.length(strip(b)) < MIN_BODY_LENGTH, subject).otherwise(F.concat(subject, F.lit(" "), b)),
    )


def _within_line(pattern: str) -> str:
    """A line pattern for use inside a longer text: whitespace must not run over the line end."""
    return pattern.removeprefix("^").replace(r"\s", r"[\s\x1c-\x1f&&[^\n]]")


QUOTE_LINE = FLAGS_IGNORE_CASE + "(?:" + "|".join(QUOTE_LINE_PATTERNS) + ")"
QUOTED_TAIL = (
    "(?idUm)^(?:" + "|".join(_within_line(p) for p in QUOTE_LINE_PATTERNS) + ")(?s:.*)"
)


def is_quote_line(line: Column) -> Column:
    """True for a line that opens or belongs to quoted history."""
    return line.rlike(QUOTE_LINE)


def immediate_reply(body: Column) -> Column:
    """The text above the first quote line; see the README for the length rules."""

    def chosen(body: Column, head: Column, reply: Column) -> Column:
        quoted = F.length(head) < F.length(body)
        kept = F.when(quoted, F.when(reply == "", body).otherwise(reply)).otherwise(
            F.when(F.length(reply) < MIN_REPLY_LENGTH, body).otherwise(reply)
        )
        return F.when(F.length(strip(body)) < MIN_BODY_LENGTH, body).otherwise(kept)

    def above_quotes(body: Column) -> Column:
        head = F.regexp_replace(body, QUOTED_TAIL, "")
        return let(head, lambda h: let(strip(h), lambda reply: chosen(body, h, reply)))

    return let(body, above_quotes)


def body_lines(body: Column) -> Column:
    return F.split(body, "\n", -1)

