"""Archive files: many messages per file, each opened by a line starting "From "."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from letterlens.scale import join_counted, materialize
from letterlens.sources.mime import with_placed_headers

SEPARATOR = "\nFrom "
HAS_SUFFIX = r"(?s)^.+\.[^.]+$"


def read_archives(
    spark: SparkSession, paths: str | list[str], every_file: bool = False, indexed: bool = True
) -> DataFrame:
    """Messages of all archives under the given files or folders, with header columns.

    A folder contributes its *.mbox files and those files without a suffix that open with "From ";
    every_file=True takes all of its files. Key: (archive, msg_index). With indexed=False the key
    is (archive, block_start, block_pos), which has the same order and saves the pass that counts.
    No message is stored: numbers come from counts per file block.
    """
    paths = visible(spark, paths)
    records = scan_records(spark.read, paths)
    if every_file:
        messages = with_placed_headers(records)
    else:
        messages = _of_archives(records, paths)
    return index_messages(messages, block_offsets(records)) if indexed else messages


def matching_files(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(address, whether it is a folder) of the files and folders that a path or a glob names, in any file system that Spark
    reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return [(re.sub("^file:/+", "file:/", f.getPath().toUri().toString()), f.isDirectory()) for f in found or ()]


def visible(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The paths, with those that numbered appends have filled replaced by the runs that their manifest lists."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        done = [address for address, _ in matching_files(spark, f"{path.rstrip('/')}/_manifest/run=*/_SUCCESS")]
        runs = [f"{path.rstrip('/')}/{address.split('/')[-2]}" for address in sorted(done)]
        found += runs or [path]
    return found


def scan_records(reader, paths: str | list[str]) -> DataFrame:
    """One row per record, from a batch or a stream reader. Large files are split over tasks."""
    lines = reader.option("lineSep", SEPARATOR).text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("archive"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("value").startswith("From ").alias("opens_file"),
        _without_envelope(F.col("value")).alias("raw"),
    )


def _without_envelope(record: Column) -> Column:
    """The bytes after the envelope line. The separator took the last line end with it."""
    first_line = F.octet_length(F.substring_index(record, "\n", 1))
    content = F.substr(record.cast("binary"), first_line + 2)
    ended = (F.octet_length(content) == 0) | (F.substr(content, F.lit(-1)) == F.lit(b"\n"))
    return F.when(ended, content).otherwise(F.concat(content, F.lit(b"\n")))


def _of_archives(records: DataFrame, paths: list[str]) -> DataFrame:
    """Messages of the files that count as archives. Files without a suffix are judged by their
    opening bytes; that join comes last, as the header pass needs the records in scan order."""
    name = F.element_at(F.split("archive", "/"), -1)
    by_name = name.endswith(".mbox") | F.col("archive").rlike(r"\.mbox/(run=\d+/)?part-[^/]+$")
    named = []
    for path in paths:
        found = matching_files(records.sparkSession, path)
        if not found:
            raise FileNotFoundError(path)
        named += [uri for uri, is_folder in found if not is_folder]
    by_name = by_name | F.regexp_replace("archive", "^file:/+", "file:/").isin(named)
    bare = ~by_name & ~name.rlike(HAS_SUFFIX)
    messages = with_placed_headers(records.filter(by_name | bare))
    listed = records.sparkSession.createDataFrame([(f,) for f in records.inputFiles()], "archive string")
    if listed.filter(bare).isEmpty():
        return messages
    heads = (
        records.filter(bare & (F.col("block_start") == 0))
        .select("archive", "opens_file", F.monotonically_increasing_id().alias("place"))
        .groupBy("archive")
        .agg(F.min_by("opens_file", "place").alias("is_archive"))
    )
    archives = materialize(heads.filter("is_archive"), "archives")
    return join_counted(messages, archives, ["archive"], "left").filter(by_name | F.col("is_archive")).drop(
        "is_archive"
    )


def block_offsets(records: DataFrame) -> DataFrame:
    """Stored: (archive, block_start, before, in_archive), one row per file block. Records are counted per block and the
    counts added up, so no archive is numbered in one task; text before the first envelope line is no message."""
    counts = (
        records.select("archive", "block_start", "opens_file", F.monotonically_increasing_id().alias("place"))
        .groupBy("archive", "block_start")
        .agg(F.count("*").alias("n"), F.min_by("opens_file", "place").alias("opens"))
        .withColumn("n", F.col("n") - ((F.col("block_start") == 0) & ~F.col("opens")).cast("long"))
    )
    archive = Window.partitionBy("archive")
    return materialize(
        counts.select(
            "archive", "block_start", (F.sum("n").over(archive.orderBy("block_start")) - F.col("n")).alias("before"),
            F.sum("n").over(archive).alias("in_archive"),
        ),
        "offsets",
    )


def index_messages(messages: DataFrame, offsets: DataFrame) -> DataFrame:
    """Replace (block_start, block_pos) by msg_index, the 0-based place in the archive.

    What lies before a block does not depend on where the block ends. A block that begins where none was counted, because files or
    split settings changed since, ends the job."""
    placed = join_counted(messages, offsets, ["archive", "block_start"], "left")
    unknown = F.raise_error(F.concat(F.lit("archive changed since it was counted: "), "archive")).cast("long")
    index = F.coalesce(F.col("before"), unknown) + F.col("block_pos")
    # The empty line that closes an archive belongs to no message.
    closing = (index == F.col("in_archive") - 1) & (
        (F.substr("raw", F.lit(-2)) == F.lit(b"\n\n")) | (F.col("raw") == F.lit(b"\n"))
    )
    raw = F.when(closing, F.substring("raw", 1, F.octet_length("raw") - 1)).otherwise(F.col("raw"))
    rest = [c for c in messages.columns if c not in ("archive", "block_start", "block_pos", "raw")]
    return placed.select("archive", index.alias("msg_index"), raw.alias("raw"), *rest)


def first_messages(messages: DataFrame, n: int | None) -> DataFrame:
    """The first n messages of every archive, counted before any other filter; 0 or None is all."""
    return messages.filter(F.col("msg_index") < n) if n else messages
