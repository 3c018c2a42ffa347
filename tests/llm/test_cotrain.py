import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from letterlens.llm import cotrain

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    learned, held = labels.where(F.xxhash64("doc_id") % 3 != 0), labels.where(F.xxhash64("doc_id") % 3 == 0)
    models = cotrain.fit(docs, learned)
    found = cotrain.score(docs, models).join(held, "doc_id").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    counts = {(r.good, r.kept): r["count"] for r in found.groupBy("good", "kept").count().collect()}
    good, bad = counts[True, True] + counts.get((True, False), 0), counts[False, False] + counts.get((False, True), 0)
    assert counts[True, True] / good > 0.98
    assert counts[False, False] / bad > 0.85


def test_reruns_agree(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    first, again = (sorted(map(tuple, cotrain.score(docs.drop("text").join(docs.select("doc_id", "text"), "doc_id"), cotrain.fit(docs, labels)).drop("text").collect())) for _ in range(2))
    assert first == again


def small(spark, table):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("sun", "tree", "road")) for _ in range(25)) + (" vile" if i % 2 else ""), "s") for i in range(80)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 0, 1), (3, 1, 1), (4, None, None), (999, 0, 0)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_odd_rows(spark, table):
    rows, labels = small(spark, table)
    rows += [(500, None, None), (501, "", "s"), (None, "sun vile", "s"), (502, "sun " * 200_000, "s"), (3, rows[3][1], "s")]
    docs = table(rows)
    models = cotrain.fit(docs, labels)
    got = cotrain.score(docs, models).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] == (i % 2 == 0) for i in range(80))
    only = cotrain.score(docs, models, only_kept=True)
    assert only.columns == docs.columns and only.count() == sum(r.kept for r in got)


def test_without_labels_or_rows(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, labels = small(spark, table)
    assert all(r.kept for r in cotrain.score(table(rows), cotrain.fit(table(rows), none)).collect())
    assert cotrain.score(table([]), cotrain.fit(table([]), labels)).count() == 0


def test_unlabelled_documents_add_words(spark):
    """A word that no labelled document has, in documents that the page view is sure of; more of them than one sample held."""
    rng = random.Random(4)
    text = lambda *more: " ".join([*(rng.choice(("sun", "tree", "road")) for _ in range(25)), *more])
    rows = [(i, text(*["vile"] * (i % 2)), "en", ("web", "forum")[i % 2]) for i in range(120)]
    rows += [(i, text(*["fresh"] * (i % 2)), "en", ("web", "forum")[i % 2]) for i in range(1_000, 6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    views = cotrain.stored_views(docs, labels, "doc_id", "text")
    assert views.where("not sampled").count() == 5_000
    model = cotrain.fit(docs, labels)["toxic"]
    assert model.words[cotrain.xxhash.xxh3_64_intdigest(b"fresh")] > 0.1


def test_views_and_texts_score_alike(spark, table):
    rows, labels = small(spark, table)
    docs = table(rows + [(500, None, None), (501, "", "s")])
    views = cotrain.stored_views(docs, labels, "doc_id", "text")
    models = cotrain.fit_views(views)
    by_text = cotrain.score(docs, models).select("doc_id", *cotrain.NEW, "kept")
    assert sorted(map(tuple, by_text.collect())) == sorted(map(tuple, cotrain.score_views(views, models).collect()))


def test_word_counts(spark, table):
    rows, labels = small(spark, table)
    own = cotrain.stored_views(table(rows), labels, "doc_id", "text").where("sampled").selectExpr("words", "low AS text_low", "toxic AS text_toxic")
    brute = {}
    for r in own.collect():
        for word in [*r.words, None]:
            counts = brute.setdefault(word, [0] * 4)
            for i, label in enumerate((r.text_low, r.text_toxic)):
                counts[2 * i] += label >= 0
                counts[2 * i + 1] += label == 1
    got = {r.word: list(r)[1:] for r in cotrain.word_counts(own).collect()}
    assert got == {word: counts for word, counts in brute.items() if word is None or any(counts)}


def test_lookup_by_leading_bits():
    rng = np.random.default_rng(4)
    for spread in (64, 44, 3):
        pool = np.unique(rng.integers(-(1 << 62), 1 << 62, 4_000) >> (64 - spread)) if spread < 64 else np.unique(rng.integers(-(1 << 62), 1 << 62, 4_000))
        names = np.sort(rng.choice(pool, len(pool) // 2, replace=False))
        words = rng.choice(pool, 10_000)
        number, row = cotrain._numbers(words, np.arange(len(words)), names)
        stands = np.isin(words, names)
        assert (row == np.flatnonzero(stands)).all() and (names[number] == words[stands]).all()
    for names in (np.empty(0, np.int64), np.array([5])):
        assert [len(x) for x in cotrain._numbers(np.empty(0, np.int64), np.empty(0, np.int64), names)] == [0, 0]


def test_views_of_texts_taken_together(monkeypatch):
    def alone(text):
        words, signs = set((text or b"").translate(cotrain.FOLD).split()), (text or b"").translate(cotrain.SIGNS).split()
        stems = Counter(word[: cotrain.STEM] for word in words)
        names = {*words, *signs, *(stem + b"-" for stem in stems), *(stem + b"--" for stem in stems if stems[stem] > 1)}
        if len(words) < 20:
            names.add(b"few" if len(words) >= 5 else b"very few")
        return sorted(np.array([xxhash.xxh3_64_intdigest(name) for name in names], np.uint64).view(np.int64).tolist())

    rng = random.Random(4)
    texts = [None, b"", b" ", b"few", b"few of the words here", b"- -- a- a--", b"stemmed stemmer STEMMED", b"caf\xc3\xa9 \x1c\x00a1b !x!"]
    texts += [bytes(rng.choice(b"aAbBfew-! \n\t#1\xc3\xa9\x00\x1c") for _ in range(rng.randrange(300))) for _ in range(300)]
    for part in (texts, texts[::-1], texts[:1], []):
        assert [x.tolist() for x in cotrain.text_views(part)] == [alone(text) for text in part]
    batch = pa.record_batch({"text": pa.array(texts, pa.binary())})
    whole, dense = cotrain.batch_views(batch, "text")
    monkeypatch.setattr(cotrain, "MOST_TOGETHER", 500)
    parts, again = cotrain.batch_views(batch, "text")
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts] == [alone(text) for text in texts]
    assert (dense == again).all()
