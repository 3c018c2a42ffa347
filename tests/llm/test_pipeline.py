import re

import corpus_pipeline
import test_decontaminate
import test_jaccard

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    """Each stage against what a plain version makes of the same input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output",
    ]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    step = lambda i, df: corpus_pipeline.materialize(stages[i](spark, df, FOLDER), "test")

    good = step(0, docs)
    kept = {r.doc_id for r in good.collect()}
    clean = {i for i, label in labels.items() if label == (1, 0)}
    assert good.columns == COLUMNS and len(clean & kept) >= 0.95 * len(clean)

    single = step(1, good)
    rows = sorted(((r.doc_id, r.text) for r in good.collect()), key=lambda r: r[0])
    expected = sorted({component for _, _, component in test_jaccard.brute(rows)})
    assert single.columns == COLUMNS and sorted(r.doc_id for r in single.collect()) == expected

    cut = step(2, single)
    before = {r.doc_id: r.text for r in single.collect()}
    assert cut.columns == COLUMNS and cut.count() == len(before)
    for r in cut.collect():
        hit = test_decontaminate.brute(before[r.doc_id], items)[1]
        assert (r.text == before[r.doc_id]) == (hit == 0) and r.n_chars == len(r.text)
        assert test_decontaminate.brute(r.text, items)[1] == 0

    mixed = step(3, cut)
    texts = {r.doc_id: r.text for r in cut.collect()}
    copies = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == COLUMNS and max(map(copies.count, set(copies))) <= 3
    words = lambda ids: sum(len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i in ids)
    assert abs(words(copies) - words(texts)) < 0.1 * words(texts)

    final = step(4, mixed).orderBy("start").collect()
    assert [r.doc_id for r in final] == copies and copies != sorted(copies)  # the files follow the training position
    assert all(a.start + a.n_tokens == b.start for a, b in zip(final, final[1:]))


def test_without_labels_and_rows(spark, table):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
