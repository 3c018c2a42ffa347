"""Single-message files: one .eml file per message."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from letterlens.scale import gather
from letterlens.sources.mime import with_headers


def read_message_files(
    spark: SparkSession, path: str, recursive: bool = False, limit: int | None = None
) -> DataFrame:
    """Messages of the *.eml files in a folder, with header columns. A limit takes the first files
    in path order. Key: (archive, msg_index), with the file as the archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = gather(files.option("pathGlobFilter", "*.eml").load(path))
    if limit:
        files = files.join(files.select("path").orderBy("path").limit(limit), "path", "left_semi")
    return with_headers(_messages(files))


def read_message_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """For re-packing: (messages, files). Messages are all .eml files below a folder in any letter case; files has the path of
    every file, and whether it is a message. Files whose content cannot be read are listed and bring no message."""
    files = gather(
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(path)
    )
    is_message = F.lower("path").endswith(".eml")
    return _messages(files.filter(is_message)), files.select("path", is_message.alias("is_message"))


def _messages(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path").alias("archive"),
        F.lit(0).cast("bigint").alias("msg_index"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("content").alias("raw"),
    )
