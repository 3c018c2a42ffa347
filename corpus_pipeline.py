"""From documents to token files: quality, near copies, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs."""

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from letterlens.llm import cotrain, curriculum, decontaminate, jaccard, token_planes
from letterlens.scale import materialize, scratch_path

END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    models = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.score(docs, models, only_kept=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_per_group(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that stand inside ten-word passages of the benchmark."""
    cut = decontaminate.remove_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix shows it, in order of its position in training."""
    return curriculum.repeated(docs)


def written_order(docs: DataFrame) -> list[Column] | None:
    """Columns that give the rows of a written table in the order of the job that wrote it; none if docs is no such table."""
    try:
        file = docs.metadataColumn("_metadata")
        docs.select(file["file_name"], file["row_index"])
    except AnalysisException:
        return None
    return [F.regexp_extract(file["file_name"], r"part-(\d+)", 1).try_cast("long"), file["file_name"], file["row_index"]]


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in bit-plane files, in the order in which docs were written (that of training); returns per document what
    the files hold."""
    path = scratch_path(spark, "planes")
    token_planes.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID, order=written_order(docs))
    return token_planes.read_digests(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

# Trained models and tokenizers have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
