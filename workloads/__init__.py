"""Queries over the given tables: each in Spark, and where possible in SQL for comparison."""

from pyspark.sql import DataFrame, SparkSession

from letterlens.scale import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table whose texts are costly to work on."""
    return spread(table(spark, folder, name).select(*columns))
