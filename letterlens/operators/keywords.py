"""Keyword search over messages or any text column."""

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from letterlens.functions.anchors import grams, required_literal
from letterlens.functions.matching import (
    NOT_INSIDE_A_PAIR, PATTERNS_PER_GUARD, first_hits, hit_keywords, hit_positions, hits_of_rows, keyword_hits,
)
from letterlens.functions.regex import FLAGS_IGNORE_CASE, compile_check, matches_any, to_java
from letterlens.functions.text import (
    body_lines, fold_czech, immediate_reply, is_quote_line, search_text,
)
from letterlens.scale import materialize
from letterlens.sources.mime import body_text

PATTERNS_PER_PASS = 500
# So many different grams of patterns go to every task (8 bytes each), which then passes on no others; beyond, all are joined.
ANCHORS_SENT = 1_000_000
LISTS = 16


def searchable(messages: DataFrame, reply_only: bool = False, html_mode: str = "visible") -> DataFrame:
    """Replace the part columns by the folded text that is searched. The body pass is a barrier for
    filters: select messages by their headers before with_parts."""
    body = body_text(html_mode)
    body = immediate_reply(body) if reply_only else body
    kept = [c for c in messages.columns if c not in ("parts", "is_multipart", "parse_error")]
    return (
        messages.withColumn("body", body)
        .withColumn("folded", fold_czech(search_text(F.col("subject"), F.col("body"))))
        .select(*kept, "folded")
    )


def keyword_matches(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """Rows whose text matches any pattern, with hits: the first one per distinct keyword.

    A single alternation rejects most rows; offsets are worked out for the rest only.
    """
    compile_check(patterns)
    found = df.filter(matches_any(F.col(text), patterns))
    return found.withColumn("hits", first_hits(keyword_hits(F.col(text), patterns)))


def flagged_matches(df: DataFrame, text: str, patterns: list[str], where: Column) -> DataFrame:
    """All rows, with matched and hits (null where not matched) in place of the text. Only rows that the condition holds
    for are searched, and only those that match have offsets worked out."""
    compile_check(patterns)
    kept = [c for c in df.columns if c not in (text, "matched", "hits")]
    flag = F.coalesce(F.when(where, matches_any(F.col(text), patterns)), F.lit(False))
    judged = df.withColumn("matched", flag)
    return judged.select(*kept, "matched", F.when(F.col("matched"), first_hits(keyword_hits(F.col(text), patterns))).alias("hits"))


def all_hits(df: DataFrame, keys: list[str], text: str, patterns: list[str]) -> DataFrame:
    """Every hit in long form: keys, pattern_id, keyword, pos."""
    compile_check(patterns)
    hits = keyword_hits(F.col(text), patterns)
    if len(patterns) > PATTERNS_PER_GUARD:
        hits = F.when(matches_any(F.col(text), patterns), hits)
    return hit_rows(df.withColumn("hits", hits), keys)


def hit_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """The hits column in long form. The outer form keeps Spark from inferring a filter on the number
    of hits, which would work them out a second time."""
    return found.select(*keys, F.inline_outer("hits")).filter(F.col("keyword").isNotNull())


def keyword_counts(hits: DataFrame) -> DataFrame:
    """Hits per keyword; counted before the shuffle, so one frequent keyword does no harm."""
    return hits.groupBy("keyword").agg(F.count("*").alias("n_hits"))


def pattern_table_hits(df: DataFrame, keys: list[str], text: str, patterns: DataFrame) -> DataFrame:
    """Every hit of a pattern table (pattern_id, pattern) of any length, as keys, pattern_id,
    keyword, pos; rows with equal or null ids are patterns of their own.

    Patterns are indexed by a run of letters that every match must hold: only pairs of a text and a pattern whose run the
    text holds are searched. Patterns without such a run are searched in all texts, in passes of bounded length."""
    stored = _anchored(patterns)
    indexed = _indexed_hits(df, keys, text, stored.filter(F.col("gram").isNotNull()))
    return reduce(DataFrame.unionByName, _passes(df, keys, text, stored.filter(F.col("gram").isNull())), indexed)


def _passes(df: DataFrame, keys: list[str], text: str, patterns: DataFrame) -> list[DataFrame]:
    rows_left = patterns.select("pattern_id", "pattern").orderBy("pattern_id").toLocalIterator()
    passes = []
    while rows := list(islice(rows_left, PATTERNS_PER_PASS)):
        ids = F.split(F.lit(" ".join(str(r["pattern_id"]) for r in rows)), " ")
        hits = all_hits(df, keys, text, [r["pattern"] for r in rows])
        passes.append(hits.withColumn("pattern_id", F.get(ids, F.col("pattern_id")).try_cast("bigint")))
    return passes


def _anchored(patterns: DataFrame) -> DataFrame:
    """Stored: (uid, pattern_id, pattern, literal, gram, plain, guarded). literal is what every match holds, gram the piece of it
    that fewest patterns have; plain and guarded are the Java spellings. An invalid pattern ends the job by name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("pattern").to_pylist()
            compile_check(texts)
            java = [to_java(p) for p in texts]
            literals = [required_literal(p) for p in texts]
            found = [grams(literal or "") for literal in literals]
            yield pa.record_batch(
                [
                    batch.column("pattern_id"), batch.column("pattern"), pa.array(literals, pa.string()), pa.array(found, pa.list_(pa.int64())),
                    pa.array([FLAGS_IGNORE_CASE + p for p in java], pa.string()),
                    pa.array([f"{FLAGS_IGNORE_CASE}{NOT_INSIDE_A_PAIR}(?:{p})" for p in java], pa.string()),
                ],
                ["pattern_id", "pattern", "literal", "grams", "plain", "guarded"],
            )

    rows = patterns.select(F.col("pattern_id").cast("bigint").alias("pattern_id"), "pattern").filter(F.col("pattern").isNotNull())
    read_rows = rows.mapInArrow(read, "pattern_id bigint, pattern string, literal string, grams array<bigint>, plain string, guarded string")
    read_rows = materialize(read_rows.withColumn("uid", F.monotonically_increasing_id()), "patterns")
    each = read_rows.select("uid", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "gram").groupBy("uid").agg(F.min(F.struct("n", "gram")).alias("best")).select("uid", "best.gram")
    return materialize(read_rows.drop("grams").join(rarest, "uid", "left"), "anchors")


def _indexed_hits(df: DataFrame, keys: list[str], text: str, anchored: DataFrame) -> DataFrame:
    """Hits of patterns that have a gram. Grams of the texts meet those of the patterns in one join; patterns are
    then gathered per text in lists of bounded length and searched where the text is. A text is named by a hash: if
    two share it, each is searched with the patterns of both, which changes nothing."""
    texts = df.select(*keys, F.col(text).alias("text"), F.xxhash64(*keys, text).alias("name"))
    anchors = anchored.select("gram").distinct()
    few = anchors.limit(ANCHORS_SENT + 1).count() <= ANCHORS_SENT
    sent = np.sort(anchors.toArrow()["gram"].to_numpy()) if few else None

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("text")):
                found = grams(value.as_py() or "")
                if sent is not None:
                    found = found[np.isin(found, sent, assume_unique=True)]
                if len(found):
                    yield pa.record_batch([pa.array(np.full(len(found), name)), pa.array(found)], ["name", "gram"])

    # A gram that a third of all texts hold meets few patterns, as each pattern stands at its rarest; Spark splits what is left.
    pairs = texts.select("name", "text").mapInArrow(held, "name bigint, gram bigint").distinct().join(anchored, "gram")
    lists = pairs.groupBy("name", F.pmod("uid", F.lit(LISTS)).alias("list"), (F.col("uid") / F.lit(LISTS * PATTERNS_PER_PASS)).cast("bigint").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("uid", "pattern_id", "literal", "plain", "guarded"))).alias("patterns")
    )
    found = texts.join(lists.select("name", "patterns"), "name").withColumn("hits", hits_of_rows(F.col("text"), F.col("patterns")))
    return hit_rows(found.select(*keys, "hits"), keys)


def joined_keywords(hits: Column) -> Column:
    return F.array_join(hit_keywords(hits), ", ")


def joined_positions(hits: Column) -> Column:
    return F.array_join(hit_positions(hits).cast("array<string>"), ", ")


def quote_lines(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """One row per body line: keys, line_no (0-based), line, is_quote."""
    lines = df.select(*keys, F.posexplode(body_lines(F.col(body))).alias("line_no", "line"))
    return lines.withColumn("is_quote", is_quote_line(F.col("line")))
