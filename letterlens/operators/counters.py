"""Run counters and totals."""

from pyspark.sql import Column, DataFrame, Observation, functions as F

from letterlens.scale import materialize


SEARCH_COUNTERS = ("processed", "matched", "failed")


def search_metrics() -> dict[str, Column]:
    """What a search counts over its outcomes. A message may be matched and failed: its body faulted, and what could be
    read of it holds a keyword."""
    counts = (F.count("*"), F.count_if(F.col("matched")), F.count_if(F.col("stage").isNotNull()))
    return dict(zip(SEARCH_COUNTERS, counts))


def attachment_metrics() -> dict[str, Column]:
    return {
        "processed": F.count("*"),
        "matched": F.count_if(F.size("attachments") > 0),
        "attachments": F.coalesce(F.sum(F.size("attachments")), F.lit(0)),
        "failed": F.count_if(F.col("stage").isNotNull()),
    }


def search_counters(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """processed, matched and failed of a table of outcomes; per archive and in total when by=["archive"]."""
    return _counters(judged, search_metrics(), by or [])


def attachment_counters(judged: DataFrame) -> DataFrame:
    """processed, matched, attachments and failed, per archive and, with a null archive, in total."""
    return _counters(judged, attachment_metrics(), ["archive"])


def _counters(judged: DataFrame, metrics: dict[str, Column], by: list[str]) -> DataFrame:
    """One aggregate per group over one pass, then the total of the groups."""
    counted = judged.groupBy(*by).agg(*(column.alias(name) for name, column in metrics.items()))
    if not by:
        return counted
    return counted.rollup(*by).agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in metrics))


def observed(judged: DataFrame, metrics: dict[str, Column], kept: Column, label: str) -> tuple[DataFrame, dict[str, int]]:
    """(stored rows that are kept, metrics over all rows). One job stores and counts: no message is read twice. The job has
    no shuffle, so every row is counted by the one task that succeeds with it."""
    watch = Observation()
    counted = judged.observe(watch, *(column.alias(name) for name, column in metrics.items()))
    return materialize(counted.filter(kept), label), watch.get


def with_speed(counters: DataFrame, elapsed_seconds: float) -> DataFrame:
    """Add the run's own time: messages per second and seconds per match."""
    elapsed = F.lit(float(elapsed_seconds))
    return counters.withColumns(
        {
            "elapsed": elapsed,
            "per_second": F.try_divide(F.col("processed"), elapsed),
            "seconds_per_match": F.try_divide(elapsed, F.col("matched")),
        }
    )


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("processed", "failed", "skipped")])
