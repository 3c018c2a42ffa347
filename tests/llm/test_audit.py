import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from letterlens.llm.filter_audit import FIGURES, audit, failure_cells, own_failures, walk
from pyspark.sql import types as T

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def failures(row, rows):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    first = min((r[0] for r in rows if (r[1] or "") == text and r[0] is not None), default=None)
    return {
        name for name, fails in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))),
            ("E", row[0] is not None and row[0] > first),
        ) if fails
    }


def brute_force(rows, labels):
    """Every order applied to every document, one filter after another."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    fails = [failures(row, rows) for row in rows]
    found = {}
    for part in {row[2] or "" for row in rows}:
        mine = [(row, f) for row, f in zip(rows, fails) if (row[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[name] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in mine) - len(gone), sum(f == {name} for _, f in mine),
                    sum(row[0] in good for row, _ in gone), sum(row[0] in toxic for row, _ in gone),
                ]
        for (p, order, step), figures in found.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return found


def random_text(r):
    kind = r.random()
    if kind < 0.1:
        return r.choice([None, "", " \n"])
    words = [r.choice(["#tag", "LOUD", "é𝄞", "a", "b|c"]) if kind < 0.5 and r.random() < 0.2 else f"w{r.randint(0, 400)}" for _ in range(r.randint(80, 130))]
    return " ".join(words)


def test_against_brute_force(spark, table):
    r = random.Random(3)
    pool = [random_text(r) for _ in range(25)]
    rows = [(r.choice([i, i, i, None, 7]), r.choice(pool), r.choice(["en", "de", None, ""])) for i in range(160)]
    rows += [(500, "copied " * 200, "en")] * 3 + [(501, "copied " * 200, "de")] * 40
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 160, 2)] + [(8, 1, 0), (8, 1, 1), (None, 1, 1)]
    docs = table(rows).drop("lang").withColumnRenamed("source", "lang")
    got = audit(failure_cells(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert {(x.part, x.filter_order, x.step): [x[f] for f in FIGURES] for x in got} == brute_force(rows, labels)
    assert len(got) == 600 * 3


def test_long_and_plain_texts():
    assert own_failures(b"") == 1
    assert own_failures(" ".join(f"w{i}" for i in range(100_000)).encode()) == 0
    assert own_failures(("A" * 10 + "é" * 90).encode()) == 1
    assert own_failures(("A" * 11 + "é" * 89).encode()) == 5


def test_walk_is_the_count_of_each_subset():
    counts = np.random.default_rng(1).integers(0, 99, (32, 3))
    states, masks = walk(counts), np.arange(32)
    for subset in range(32):
        assert (states[subset] == counts[(masks & subset) == 0].sum(axis=0)).all()


def test_empty_table(spark, table):
    assert audit(failure_cells(table([]), spark.createDataFrame([], LABELS))).count() == 0
