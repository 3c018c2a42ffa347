"""Single-message files into archives."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from letterlens.sinks.messages import append_archive
from letterlens.sources.messages import read_message_tree


def repack(spark: SparkSession, source: str, archive: str, name_pattern: str | None = None) -> DataFrame:
    """Append all .eml files below source, in path order, as one run of the archive; return processed, failed and skipped.

    processed comes from the manifest of the run, failed is what was listed and did not arrive there."""
    messages, files = read_message_tree(spark, source)
    chosen = F.col("is_message")
    if name_pattern:
        messages = messages.filter(F.col("file_name").rlike(name_pattern))
        chosen = chosen & F.element_at(F.split("path", "/"), -1).rlike(name_pattern)
    # The listing reads names only, and counts both kinds in one pass.
    listed, passed = files.agg(F.count_if(chosen), F.count_if(~F.col("is_message"))).first()
    done = append_archive(messages, archive, ["archive"]).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return spark.createDataFrame([(done, listed - done, passed)], "processed long, failed long, skipped long")


def name_prefix(prefixes: list[str]) -> str:
    """A pattern for names that start with one of the given texts, e.g. ["9", "100"] for confidence
    0.90 and more, or ["202401"] for a month."""
    quoted = ["".join(f"\\{c}" if not c.isalnum() else c for c in p) for p in prefixes]
    return "^(?:" + "|".join(quoted) + ")"
