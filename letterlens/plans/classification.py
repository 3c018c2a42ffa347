"""Classification of candidate messages."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from letterlens.operators.classify import (
    KEYS, candidates, classification_log, final_attempts, parsed_attempts, route_counts, routed, score,
    score_batches, token_totals,
)
from letterlens.scale import join_counted, materialize
from letterlens.sinks.logs import run_report, write_classification_csv, write_report
from letterlens.sinks.messages import write_routes
from letterlens.sources.mime import with_parts


def classify(found: DataFrame, responses: DataFrame, match_key: str = "is_match", strict: bool = False) -> DataFrame:
    """Candidates with their route, from recorded attempts."""
    return routed(found, final_attempts(parsed_attempts(responses, match_key, strict)))


def with_bytes(messages: DataFrame, rows: DataFrame) -> DataFrame:
    """Routed messages as write_routes takes them. Only keys, routes and names travel; the messages stay where they are
    read, unless there are more than BROADCAST_ROWS of them."""
    narrow = materialize(rows.select(*KEYS, "route", F.col("output_name").alias("file_name"), "confidence"), "routes")
    sender = F.lower(F.try_element_at("from_addrs", F.lit(1)))
    whole = messages.select(*KEYS, sender.alias("sender"), "date_wall", "raw")
    return join_counted(whole, narrow, KEYS)


def run_classification(
    messages: DataFrame, system_prompt: str, criteria: str, output: str,
    scorer: Callable[[str, str], tuple[str, int, int]] | None = None, responses: DataFrame | None = None,
    configuration: dict[str, str] | None = None, match_key: str = "is_match", strict: bool = False, retries: int = 1,
    batch_scorer: Callable[[str, list[str]], list] | None = None,
) -> DataFrame:
    """Score (or replay recorded responses), route, and write routes, log and report. A batch scorer keeps its attempts in
    the output folder, and a run that broke off goes on from there."""
    started = time.monotonic()
    found = materialize(candidates(with_parts(messages)), "candidates")
    if responses is None and batch_scorer:
        responses = score_batches(
            found, system_prompt, criteria, batch_scorer, f"{output}/attempts", retries, match_key, strict
        )
    elif responses is None:
        responses = score(found, system_prompt, criteria, scorer, retries, match_key, strict)
    rows = materialize(classify(found, responses, match_key, strict), "routed")
    write_routes(with_bytes(messages, rows), f"{output}/routes")
    log = classification_log(rows)
    log.write.mode("overwrite").parquet(f"{output}/log")
    write_classification_csv(log, f"{output}/log_csv")
    settings = configuration or {"system_prompt": system_prompt, "user_prompt": criteria, "output_dir": output}
    report = run_report(route_counts(rows), token_totals(responses), time.monotonic() - started, settings)
    write_report(report, f"{output}/report")
    return report
