import random
import re

import numpy as np
from pyspark.sql import functions as F

from letterlens.llm.decontaminate import find_passages, remove_passages
from letterlens.llm.fm_index import FMIndex, WaveletMatrix, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    have, hit, names = words(text), set(), set()
    for name, item in items:
        phrase = words(item)
        if not phrase:
            continue
        width = min(10, len(phrase))
        runs = {tuple(phrase[i : i + width]) for i in range(len(phrase) - width + 1)}
        for i in range(len(have) - width + 1):
            if tuple(have[i : i + width]) in runs:
                hit |= set(range(i, i + width))
                names |= {str(name)} - {"None"}
    return len(have), len(hit), sorted(names)


def test_index_against_scanning():
    rng = np.random.default_rng(3)
    for _ in range(60):
        symbols = rng.integers(0, 4, rng.integers(1, 70)).astype(np.int64)
        symbols[-1] = 0
        index = FMIndex(symbols, 3, 4)
        for length in (1, 2, 4):
            phrases = rng.integers(1, 4, (15, length))
            low, high = index.search(phrases)
            for phrase, a, b in zip(phrases, low, high):
                places = [i for i in range(len(symbols) - length + 1) if (symbols[i : i + length] == phrase).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_wavelet_matrix():
    values = np.array([3, 0, 2, 2, 1, 3, 0, 2])
    matrix = WaveletMatrix(values, 2)
    for symbol in range(4):
        for place in range(9):
            assert matrix.rank(np.array([symbol]), np.array([place]))[0] == (values[:place] == symbol).sum()
    assert (matrix.access(np.arange(8)) == values).all()
    assert sorted(suffix_order(values + 1).tolist()) == list(range(8))


def cases():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)] + ["é", "Ü1", "x-y"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 4, 12, 25))))) for i in range(2, 14)]
    items += [(20, None), (21, "..."), (None, "v1 v2 v3"), (22, items[3][1]), (22, items[5][1])]
    docs = []
    for i in range(60):
        parts = [rng.choice(vocabulary + ["zz"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            item = rng.choice(items[2:9])[1].upper().split()
            at = rng.randint(0, len(parts))
            parts[at:at] = item[rng.randint(0, 3) :]
        docs.append((i, rng.choice((" ", ", ", "\n")).join(parts)))
    docs += [(100, None), (101, ""), (None, items[4][1]), (102, items[4][1]), (102, items[4][1]), (103, "zz " * 50_000 + items[7][1])]
    return docs, items


def test_against_scanning(spark, table):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = find_passages(table(docs), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.withColumn("n_hit", n_hit).collect()), key=repr)
    assert rows == sorted(((i, *brute(text, items)) for i, text in docs), key=repr)


def test_removal_leaves_nothing(spark, table):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    cut = remove_passages(table(docs), benchmark)
    assert cut.columns == table(docs).columns
    texts = {}
    for r in cut.collect():
        assert brute(r.text, items)[1] == 0
        texts[r.doc_id] = r.text
    for i, text in docs:
        if brute(text, items)[1] == 0:
            assert texts[i] == text


def without(text, items):
    """All occurrences cut at once, again and again."""
    while brute(text, items)[1]:
        have, hit = words(text), set()
        for _, item in items:
            phrase = words(item)
            width = min(10, len(phrase))
            runs = {tuple(phrase[i : i + width]) for i in range(len(phrase) - width + 1)}
            hit |= {j for i in range(len(have) - width + 1) if tuple(have[i : i + width]) in runs for j in range(i, i + width)}
        text = " ".join(word for i, word in enumerate(have) if i not in hit)
    return words(text)


def test_blocks_of_few_items(spark, table):
    """Passages of different blocks that overlap, and phrases that arise across the cut of another block."""
    w = [f"w{i}" for i in range(30)]
    items, docs = [], []
    for n in range(12):  # whichever of two items comes first, the other's words must go too
        own = [f"{n}{word}" for word in w]
        items += [(2 * n, " ".join(own[:12])), (2 * n + 1, " ".join(own[5:21]))]
        docs.append((n, "before " + " ".join(own[:21]) + " behind"))
    for n in range(12, 24):
        own = [f"{n}{word}" for word in w]
        items += [(2 * n, " ".join(own[:12])), (2 * n + 1, " ".join(own[15:27]))]
        docs.append((n, " ".join(["before", *own[:6], *own[15:27], *own[6:12], "behind"])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (3, 20_000):
        for r in remove_passages(table(docs), benchmark, item_block=size).collect():
            assert words(r.text) == without(docs[r.doc_id][1], items) == ["before", "behind"]
    docs, items = cases()
    items = [item for item in items if item[0] is not None and words(item[1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((repr(i), without(text, items)) for i, text in docs)
    for size in (3, 20_000):
        got = remove_passages(table(docs), benchmark, item_block=size).collect()
        assert sorted((repr(r.doc_id), words(r.text)) for r in got) == expected
    found = [sorted(map(repr, find_passages(table(docs), benchmark, item_block=size).collect())) for size in (3, 20_000)]
    assert found[0] == found[1]


def test_empty_tables(spark, table):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in find_passages(table([(1, "a b")]), nothing).select("n_words", "spans", "items").collect()] == [(2, [], [])]
    assert find_passages(table([]), nothing).count() == 0
