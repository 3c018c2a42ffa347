"""Small configuration inputs: pattern files and prompt files."""

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from letterlens.fixed_values import DEFAULT_SEARCH_PATTERNS
from letterlens.functions.regex import compile_check
from letterlens.functions.text import strip
from letterlens.scale import materialize, ordered_rank


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern_id, pattern) from a file or a folder of files: one pattern per line, # comments and blanks left out. Files
    follow by path and lines by their place, however the files are split over tasks."""
    places = ("file_path", "file_block_start", "line")
    lines = spark.read.text(path).select(
        strip(F.col("value")).alias("pattern"), "_metadata.file_path", "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("line"),
    )
    kept = materialize(lines.filter((F.col("pattern") != "") & ~F.col("pattern").startswith("#")), "patterns")
    ranks = ordered_rank(kept, [], list(places), "nth")
    return kept.join(ranks, list(places)).select((F.col("nth") - 1).alias("pattern_id"), "pattern")


def pattern_list(patterns: DataFrame) -> list[str]:
    """The patterns in order, as job configuration."""
    return [row["pattern"] for row in patterns.orderBy("pattern_id").collect()]


def choose_patterns(
    spark: SparkSession, custom: str | None = None, default: str | None = None
) -> list[str]:
    """The first non-empty of: custom file, default file, built-in list. An unreadable file counts
    as empty."""
    for path in (custom, default):
        if path:
            try:
                found = pattern_list(read_patterns(spark, path))
            except PySparkException:
                continue
            if found:
                compile_check(found)
                return found
    return list(DEFAULT_SEARCH_PATTERNS)


def read_prompt(spark: SparkSession, path: str) -> str:
    """A prompt file as one stripped text."""
    return spark.read.text(path, wholetext=True).first()["value"].strip()
