"""The registered queries of this subpackage, and their SQL where there is one."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from letterlens.llm import bpe_automaton, cotrain, curriculum, decontaminate, extract, filter_audit, jaccard, line_dedup, merkle
from letterlens.llm import ring, rules, secrets, sql, token_planes
from letterlens.scale import materialize, scratch_path


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract.main_text(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_dropped"
    )


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document that remain when of each class of lines within two edits the first is kept."""
    return line_dedup.line_classes(documents(spark, folder)).select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", "kept_lines"
    )


def op3_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written in bit planes and read back."""
    path = scratch_path(spark, "planes")
    token_planes.write_tokens(documents(spark, folder), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_planes.read_digests(spark, path)


def op4_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, failure bits and the verdicts of all policies for every document; where one rule alone decides the latest
    policy, that rule and how many documents the policy would keep besides without it."""
    found = materialize(rules.ledger(documents(spark, folder).select("doc_id", "text")), "ledger")
    base = F.lit(rules.mask(rules.BASE))
    gained = rules.ablations(found).where("policy = 'v3'").select(
        F.col("rule").alias("deciding_rule"), (F.col("kept_without") - F.col("kept")).alias("gained_without")
    )
    judged = found.select(
        "doc_id", *rules.MEASURES, "failed_bits", (F.col("failed_bits").bitwiseAND(base) != 0).alias("base_failed"),
        rules.passes("v3").alias("kept"), rules.passes("v1").alias("kept_v1"), rules.passes("v2").alias("kept_v2"),
        rules.deciding_rule("v3").alias("deciding_rule"),
    )
    return judged.join(F.broadcast(gained), "deciding_rule", "left").fillna(0, "gained_without")  # gained: one row a rule


def op5_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents on 16 shards, row counts at most one apart."""
    placed = ring.shard(documents(spark, folder), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents, with the times at which each is shown."""
    return curriculum.mix(documents(spark, folder)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "positions"
    )


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside ten-word passages of the benchmark."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontaminate.find_passages(documents(spark, folder).select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op8_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    """Chances of low quality and of toxicity for every document, by each view and by both."""
    views = cotrain.stored_views(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "text")
    return cotrain.score_views(views, cotrain.fit_views(views)).withColumnRenamed("key", "doc_id")


def op9_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of known shape, and shapeless ones that only one source has."""
    found = secrets.scan_secrets(documents(spark, folder), repository="doc_id", owner="source")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col("repository").alias("doc_id"), *map(count, secrets.KINDS), F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"), "n_copied",
    )


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-copy components over five-word shingles at 0.8."""
    return jaccard.jaccard_components(documents(spark, folder)).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of all documents, with a tampered version (capitals made small) for every fifth checksum of an id."""
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(documents(spark, folder), {"text": small}, fifth).withColumnRenamed("key", "doc_id")


def op12_tokenization_automaton(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents by the automaton, and the texts that their arcs spell."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe_automaton.encode(documents(spark, folder).select("doc_id", "text"), path, decode_too=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each step of each order of five filters does to the documents of each language."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return filter_audit.audit(filter_audit.failure_cells(documents(spark, folder), labels))


QUERIES = {
    f.__name__: f
    for f in (
        op1_page_text, op2_line_dedup, op3_token_planes, op4_rule_ledger, op5_ring_shards, op6_curriculum, op7_decontaminate, op8_cotraining,
        op9_secret_ownership, op10_jaccard_join, op11_merkle_manifest, op12_tokenization_automaton, op13_filter_audit,
    )
}
SQL: dict[str, str] = {
    "op4_rule_ledger": sql.RULE_LEDGER, "op7_decontaminate": sql.DECONTAMINATE, "op10_jaccard_join": sql.JACCARD_JOIN,
    "op11_merkle_manifest": sql.MERKLE_MANIFEST, "op13_filter_audit": sql.FILTER_AUDIT,
}
