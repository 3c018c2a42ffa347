import pytest
from pyspark.sql import types as T


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with extra columns whose names clash with results."""

    def make(rows, key="doc_id"):
        schema = T.StructType([
            T.StructField(key, T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
            *(T.StructField(name, T.StringType()) for name in EXTRA),
        ])
        rows = [(*row, *[None] * (3 - len(row)), *["x"] * len(EXTRA)) for row in rows]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


EXTRA = ("id", "uid", "n", "node", "component", "size", "shard", "slot", "place", "target", "copies", "number", "slice", "spans",
         "items", "n_words", "kept", "base", "failed_bits", "lang", "key", "line", "arc", "value")
