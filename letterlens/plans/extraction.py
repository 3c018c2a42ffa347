"""Keyword extraction over archives."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from letterlens.functions.names import message_file_name
from letterlens.operators.counters import SEARCH_COUNTERS, observed, search_counters, search_metrics
from letterlens.operators.keywords import flagged_matches, keyword_matches, searchable
from letterlens.operators.naming import unique_names
from letterlens.operators.participants import involves, of_target
from letterlens.sinks.logs import extraction_log, write_extraction_csv
from letterlens.sinks.messages import split_failures, write_messages, write_quarantine
from letterlens.sources.archives import first_messages
from letterlens.sources.mime import with_parts

KEYS = ["archive", "msg_index"]


@dataclass(frozen=True)
class Search:
    """What to look for; the options of one run."""

    patterns: list[str]
    target: str | None = None
    from_only: bool = False
    reply_only: bool = False
    limit: int | None = None
    html_mode: str = "visible"


def outcomes(messages: DataFrame, search: Search) -> DataFrame:
    """Every message with what the search makes of it: matched, hits and base_name, and for those that could not be read
    in whole the stage ("header" or "body") and the reason.

    One pass over the headers and one over the bodies; messages that the header rules out have no body parsed. A message
    whose body faults is searched as far as it could be read, so it may be matched and still bear a reason."""
    seen = first_messages(messages, search.limit)
    kept = seen.columns
    wanted = F.col("header_error").isNull()
    if search.target:
        wanted = wanted & involves(search.target, search.from_only)
    seen = seen.withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    parsed = with_parts(seen, where=F.col("wanted")).withColumn("body_error", F.col("parse_error"))
    texts = searchable(parsed, search.reply_only, search.html_mode)
    judged = flagged_matches(texts, "folded", search.patterns, F.col("wanted"))
    base = message_file_name(F.col("date_wall"), F.col("from_addrs"), F.col("message_id"), F.col("subject"))
    stage = F.when(F.col("header_error").isNotNull(), "header").when(F.col("body_error").isNotNull(), "body")
    return judged.select(
        *kept, "matched", "hits", F.when(F.col("matched"), base).alias("base_name"), stage.alias("stage"),
        F.coalesce("header_error", "body_error").alias("reason"),
    )


def find_matches(messages: DataFrame, search: Search) -> DataFrame:
    """Messages that involve the target and hold a keyword. The header filter runs before any body
    is parsed, the alternation before any offset is worked out."""
    seen = first_messages(messages, search.limit)
    sound, _ = split_failures(seen, "header_error")
    involved = of_target(sound, search.target, search.from_only)
    texts = searchable(with_parts(involved), search.reply_only, search.html_mode)
    matched = keyword_matches(texts, "folded", search.patterns)
    base = message_file_name(F.col("date_wall"), F.col("from_addrs"), F.col("message_id"), F.col("subject"))
    return matched.withColumn("base_name", base).drop("folded")


def count_matches(messages: DataFrame, search: Search, by: list[str] | None = None) -> DataFrame:
    """Dry run: the counters only, nothing written."""
    return search_counters(outcomes(messages, search), by)


def run_extraction(
    messages: DataFrame, search: Search, output: str, prior_log: DataFrame | None = None
) -> DataFrame:
    """Write matched messages, the log (Parquet and CSV) and the messages that could not be read in whole, with stage and
    reason; return the counters.

    Archives are read once: the job that stores matches and failures counts what passes by. Other messages are not
    stored."""
    spark = messages.sparkSession
    kept = F.col("matched") | F.col("stage").isNotNull()
    stored, counted = observed(outcomes(messages, search), search_metrics(), kept, "outcomes")
    matches = stored.filter("matched")
    names = unique_names(matches, KEYS, "base_name", prior_log)
    log = extraction_log(matches, names, KEYS)
    write_messages(matches, names, KEYS, f"{output}/messages")
    log.write.mode("append").parquet(f"{output}/log")
    write_extraction_csv(log, f"{output}/log_csv")
    write_quarantine(stored, KEYS, f"{output}/failed")
    return spark.createDataFrame([tuple(counted[c] for c in SEARCH_COUNTERS)], " long, ".join(SEARCH_COUNTERS) + " long")
