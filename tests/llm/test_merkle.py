import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F, types as T

from letterlens.llm import merkle

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType()),
    *(T.StructField(name, T.StringType()) for name in ("key", "leaf", "tree", "place", "node", "block", "total", "path", "tampered")),
])


def h(*values):
    return sha256("".join(values).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def sides(tree, at):
    for nodes in tree[:-1]:
        start = at // 16 * 16
        yield nodes[start:at], nodes[at + 1 : start + 16]
        at //= 16


def brute_force(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = levels([leaf(r) for r in groups[name]])
    top = levels([trees[n][-1][0] for n in names])
    root = top[-1][0]
    found = []
    for i, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            path = [*sides(trees[name], at), *sides(top, i)]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf((*row[:4], row[4].translate(SMALL) if row[4] else row[4])) if hit else leaf(row)
            for left, right in path:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in path for x in (*left, *right)))
            found.append((row[0], leaf(row), trees[name][-1][0], root, proof, node, node == root))
    return sorted(found, key=repr)


def run(spark, rows, depth=3):
    docs = spark.createDataFrame([(*row, *["x"] * 9) for row in rows], SCHEMA).repartition(5)
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle.manifest(docs, {"text": small}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, depth=depth)
    return sorted((tuple(r[:7]) for r in found.collect()), key=repr)


@pytest.mark.parametrize("depth", [3, 1])
def test_against_brute_force(spark, depth):
    """With blocks of one level, the same rows take several rounds."""
    r = random.Random(4)
    sources = ["b", "a", "é", "𝄞", "", None, "A"] + [f"s{i}" for i in range(30)]
    rows = [
        (i, "hot" if i % 3 == 0 else r.choice(sources), r.choice(["en", None]), r.choice([None, 5]), r.choice([None, "", "Small and LARGE É", "same"]))
        for i in range(900)
    ]
    rows += [rows[5], rows[5], (7, "hot", "en", 1, "Other"), (7, "hot", "en", 1, "other"), (None, "hot", "en", 1, "A"), (None, None, None, None, None)]
    rows += [(10**12, "one", "en", 1, "Long " * 50_000)]
    rows += [(2000 + i, "wide", "en", 1, "A") for i in range(16**2 + 1)]
    assert run(spark, rows, depth) == brute_force(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    for rows in ([(1, "a", "en", 3, "Abc")], [(1, None, "en", 3, "Abc"), (2, None, "en", 3, "Abc")], [(1, "a", "x", 1, "A"), (1, "b", "x", 1, "A")]):
        assert run(spark, rows) == brute_force(rows)


def test_versions_share_all_but_the_path():
    nodes = [h(str(i)) for i in range(16**3 + 5)]
    block = merkle.Block(nodes[: 16**3], len(nodes))
    copies = merkle.copied_path(h("other"), block.shared(777))
    changed = merkle.Block([*nodes[:777], h("other"), *nodes[778 : 16**3]], len(nodes))
    assert copies[-1] == changed.root
    for level, (before, after) in enumerate(zip(block.levels, changed.levels)):
        assert [i for i, (a, b) in enumerate(zip(before, after)) if a != b] == [777 // 16**level]
