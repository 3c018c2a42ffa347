"""New archive files as a stream: the same transforms as in batch, resumed from a checkpoint."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from letterlens.functions.names import message_file_name
from letterlens.operators.keywords import keyword_matches, searchable
from letterlens.operators.participants import of_target
from letterlens.operators.naming import unique_names
from letterlens.plans.extraction import Search, outcomes
from letterlens.scale import materialize
from letterlens.sinks.messages import quarantine_rows
from letterlens.sources.archives import matching_files, scan_records
from letterlens.sources.mime import with_parts, with_placed_headers

KEYS = ["archive", "block_start", "block_pos"]


def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of the files that arrive in a folder. Key: archive, block_start, block_pos."""
    return with_placed_headers(scan_records(spark.readStream, folder))


def stream_matches(messages: DataFrame, search: Search) -> DataFrame:
    """Stateless search; base_name is the file name before collisions are settled. A limit counts messages of
    an archive, which a stream sees in parts, so it is refused."""
    if search.limit:
        raise ValueError("a stream has no first messages; leave Search.limit unset")
    base = message_file_name(F.col("date_wall"), F.col("from_addrs"), F.col("message_id"), F.col("subject"))
    texts = searchable(with_parts(of_target(messages, search.target, search.from_only)), search.reply_only, search.html_mode)
    return keyword_matches(texts, "folded", search.patterns).drop("folded").withColumn("base_name", base)


def stream_outcomes(messages: DataFrame, search: Search) -> DataFrame:
    """As stream_matches, with the messages that could not be read in whole as well: matched, stage and reason tell."""
    if search.limit:
        raise ValueError("a stream has no first messages; leave Search.limit unset")
    return outcomes(messages, search).filter(F.col("matched") | F.col("stage").isNotNull())


def start_intake(matches: DataFrame, table: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Append matches to a Parquet table. By default takes what has arrived and stops."""
    writer = matches.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": "1 minute"} if continuous else {"availableNow": True}
    return writer.outputMode("append").trigger(**trigger).start()


def start_named_intake(matches: DataFrame, table: str, checkpoint: str, failed: str | None = None) -> StreamingQuery:
    """Append matches with names that collide neither within a batch nor with earlier batches. With a folder for failures,
    takes outcomes: matches go to the table, messages that could not be read in whole to the folder, with stage and reason. Both
    belong to one batch number, and a batch that is run again after a failure replaces its own parts of both."""

    def save(batch: DataFrame, batch_id: int) -> None:
        stored = materialize(batch, "batch")
        if failed:
            rows = quarantine_rows(stored, KEYS)
            rows.write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")
            stored = stored.filter("matched").drop("matched", "stage", "reason")
        names = unique_names(stored, KEYS, "base_name", _names_before(batch.sparkSession, table, batch_id))
        named = names.select(*KEYS, F.col("file_name").alias("filename"), "collision")
        stored.join(named, KEYS).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = matches.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _names_before(spark: SparkSession, table: str, batch_id: int) -> DataFrame | None:
    if not matching_files(spark, f"{table}/batch=*"):
        return None
    return spark.read.parquet(table).filter(F.col("batch") < batch_id).select("filename")
