"""Message bytes, attachments and archives."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from letterlens.operators.naming import failure_names
from letterlens.sources.archives import matching_files, scan_records


def write_messages(messages: DataFrame, names: DataFrame, keys: list[str], path: str) -> None:
    """(file_name, raw) of the named messages; the original bytes, unchanged."""
    named = names.select(*keys, "file_name")
    messages.select(*keys, "raw").join(named, keys).select("file_name", "raw").write.mode("append").parquet(path)


def write_attachments(rows: DataFrame, path: str) -> None:
    rows.select("file_name", "payload", "size").write.mode("append").parquet(path)


ROUTED = (
    "file_name string, sender string, date_wall timestamp_ntz, confidence double, raw binary, route string, month string"
)


def write_routes(rows: DataFrame, path: str) -> None:
    """One folder per route (matched, rejected, failed) and month of writing, ordered by falling confidence, so that
    selections by route and date leave out folders and those by confidence parts of files. rows: the columns of ROUTED
    without month. A message without a date has no month."""
    dated = rows.withColumn("month", F.date_format("date_wall", "yyyy-MM"))
    kept = dated.select([field.split()[0] for field in ROUTED.split(", ")])
    in_order = kept.sortWithinPartitions("route", "month", F.desc("confidence"), "file_name")
    in_order.write.mode("overwrite").partitionBy("route", "month").parquet(path)


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ROUTED, as write_routes has stored them."""
    return spark.read.schema(ROUTED).parquet(path)


def split_failures(rows: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows, failed rows with their reason)."""
    return rows.filter(F.col(error).isNull()), rows.filter(F.col(error).isNotNull())


def quarantine_rows(judged: DataFrame, keys: list[str]) -> DataFrame:
    """(file_name, keys, stage, reason, raw) of the messages that bear a stage and a reason, numbered in key order."""
    failed = judged.filter(F.col("stage").isNotNull()).select(*keys, "stage", "reason", "raw")
    return failed.join(failure_names(failed, keys), keys).select("file_name", *keys, "stage", "reason", "raw")


def write_quarantine(judged: DataFrame, keys: list[str], path: str, mode: str = "append") -> None:
    """Messages that a stage could not read; nothing if there are none. judged: a stored table."""
    if not judged.filter(F.col("stage").isNotNull()).isEmpty():
        quarantine_rows(judged, keys).write.mode(mode).parquet(path)


def archive_record(raw: Column, envelope: Column) -> Column:
    """A message as archive text: envelope line, lines starting "From " marked, a line end. Works on bytes: what is
    not UTF-8 stays as it is."""
    text = raw.cast("string")
    marked = F.replace(F.concat(F.lit("\n"), text), F.lit("\nFrom "), F.lit("\n>From "))
    ended = F.when(text.endswith("\n"), F.lit("")).otherwise(F.lit("\n"))
    return F.concat(envelope, marked, ended)


DEFAULT_ENVELOPE = "From MAILER-DAEMON Thu Jan  1 00:00:00 1970"


def write_archive(messages: DataFrame, path: str, order: list[str], mode: str = "append") -> None:
    """Messages as archive files in key order: one file per range of keys, each a valid archive. Give the
    folder a name that ends in .mbox, and the archive reader takes its parts as archives."""
    record = archive_record(F.col("raw"), F.lit(DEFAULT_ENVELOPE))
    in_order = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    in_order.select(record.alias("value")).write.mode(mode).text(path)


def append_archive(messages: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Append messages in key order as one numbered run, and return its manifest: run, part, rows, digest.

    Runs stand in folders whose names sort by number, so two appends keep their order. The manifest is written last: readers
    take listed runs only, so one that broke off leaves nothing visible, and its number is not used again."""
    spark = messages.sparkSession
    found = [address.rsplit("=", 1)[1] for address, _ in matching_files(spark, f"{path}/run=*")]
    run = f"run={max(map(int, found), default=0) + 1:06d}"
    write_archive(messages, f"{path}/{run}", order, "errorifexists")
    records = scan_records(spark.read, f"{path}/{run}").select(
        F.element_at(F.split("archive", "/"), -1).alias("part"), F.xxhash64("raw").alias("name")
    )
    manifest = records.groupBy("part").agg(F.count("*").alias("rows"), F.bit_xor("name").alias("digest"))
    manifest.select(F.lit(run).alias("run"), "part", "rows", "digest").coalesce(1).write.parquet(f"{path}/_manifest/{run}")
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest/{run}")


MANIFEST = "run string, part string, rows long, digest long"


def export_files(rows: DataFrame, content: str, folder_uri: str) -> int:
    """Write one file per row (file_name, content) below a folder that all executors reach, in any
    file system Arrow knows. Returns the number of files."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder_uri)
        system.create_dir(root)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)
            yield pa.RecordBatch.from_pydict({"saved": [batch.num_rows]}, pa.schema([("saved", pa.int64())]))

    saved = rows.select("file_name", content).mapInArrow(save, "saved long")
    return saved.agg(F.coalesce(F.sum("saved"), F.lit(0))).first()[0]
