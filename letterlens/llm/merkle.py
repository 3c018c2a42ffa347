"""Merkle manifest of a dataset: a persistent hash tree, proofs, and one version for every tampered row.

Each source is a tree of nodes of up to 16 children over its rows in key order; the roots of all sources are the leaves
of one more tree. A tree is built in rounds over aligned blocks of 16^3 nodes, each block in one task; what remains of a
block is one node of the next round, so the number of rounds is the logarithm of the largest source.

Nodes are never changed. A tampered row makes a version of the tree that shares every node but the row's ancestors: those
are copied, inside the block first, and then on upwards through the blocks above it. For that the nodes which a block
shares with its surroundings, level by level up to the root, come down to it as one row, never as a copy per version."""

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from letterlens.scale import materialize

WIDTH = 16
DEPTH = 3  # levels inside an aligned block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVEL = "struct<left: string, right: string>"
LEVEL_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(value: str) -> str:
    return sha256(value.encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """Digest of the values of a row: `-` for a null, else the number of UTF-8 bytes, a colon, and the value."""
    texts = [value.cast("string") for value in values]
    return F.sha2(
        F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256
    )


def tree_name(group: Column) -> Column:
    """A name that is never null and sorts like the group bytewise, null first."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def leaves(docs: DataFrame, key: str, group: str, fields: tuple[str, ...], changed: dict[str, Column], where: Column) -> DataFrame:
    """Stored: (tree, key, leaf, tampered). tampered is the leaf with the changed columns where `where` holds, else null."""
    after = leaf_digest([changed.get(name, F.col(name)) for name in fields])
    return materialize(
        docs.select(
            tree_name(F.col(group)).alias("tree"), F.col(key).alias("key"), leaf_digest([F.col(name) for name in fields]).alias("leaf"),
            F.when(where, after).alias("tampered"),
        ),
        "leaves",
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `place` (0-based, within the tree, in this order) and `total` (rows of the tree).

    Rows are cut by range over tree and order, so a tree of any size spreads over many tasks. Within a slice the running
    number of a row counts; only the first number and the count of each (tree, slice) are summed up."""
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    stored = materialize(ordered.withColumn("nth", F.monotonically_increasing_id()), "ordered")
    stored = stored.withColumn("slice", F.shiftright("nth", 33))
    counts = stored.groupBy("tree", "slice").agg(F.min("nth").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree", "slice", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"), F.sum("rows").over(tree).alias("total")
    )
    return stored.join(offsets, ["tree", "slice"]).select(
        *rows.columns, (F.col("nth") - F.col("first") + F.col("offset")).alias("place"), "total"
    )


def height(total: int) -> int:
    """Levels above that many nodes."""
    levels, reach = 0, 1
    while reach < total:
        levels, reach = levels + 1, reach * WIDTH
    return levels


class Block:
    """Consecutive nodes from an aligned place on, and the levels above them as far as the block or the tree goes."""

    def __init__(self, nodes: list[str], total: int, depth: int = DEPTH):
        self.levels = [nodes]
        for _ in range(min(depth, height(total))):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + WIDTH])) for i in range(0, len(below), WIDTH)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def shared(self, at: int) -> list[dict[str, str]]:
        """Nodes beside the path from a place to the root of the block, level by level: what a version shares."""
        found = []
        for nodes in self.levels[:-1]:
            start = at - at % WIDTH
            found.append({"left": "".join(nodes[start:at]), "right": "".join(nodes[at + 1 : start + WIDTH])})
            at //= WIDTH
        return found


def copied_path(node: str, shared: list[dict[str, str]]) -> list[str]:
    """Copies of the ancestors for a version in which the node stands at its place."""
    copies = []
    for level in shared:
        node = digest(level["left"] + node + level["right"])
        copies.append(node)
    return copies


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """((tree, block), rows) of each block; rows come sorted by tree, block and place."""
    name, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["block"]) != name:
                if held:
                    yield name, held
                name, held = (row["tree"], row["block"]), []
            held.append(row)
    if held:
        yield name, held


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """Stored nodes of the next round, (tree, place, node, total), from (tree, place, node, total)."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("node", pa.string()), ("total", pa.int64())])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (tree, block), rows in whole_blocks(batches):
            total = rows[0]["total"]
            root = Block([row["node"] for row in rows], total, depth).root
            found.append({"tree": tree, "place": block, "node": root, "total": -(-total // WIDTH**depth)})
            if len(found) >= 1000:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    placed = nodes.select("tree", F.expr(f"place div {WIDTH**depth}").alias("block"), "place", "node", "total")
    return materialize(by_block(placed).mapInArrow(roots, "tree string, place long, node string, total long"), "nodes")


@dataclass
class Tree:
    """rounds[0] holds the numbered leaves, each further round the roots of the blocks of the one before."""

    rounds: list[DataFrame]
    depth: int

    @property
    def roots(self) -> DataFrame:
        """(tree, node), one row per tree."""
        return self.rounds[-1].select("tree", "node")


def build(first: DataFrame, depth: int) -> Tree:
    """first: stored (tree, place, node, total, ...)."""
    rounds = [first]
    while True:
        rounds.append(block_roots(rounds[-1], depth))
        if not rounds[-1].where("total > 1").take(1):
            return Tree(rounds, depth)


PATH_ROW = -1  # place of the row that brings a block what lies above it


def with_paths(nodes: DataFrame, above: DataFrame, depth: int, each, schema: str, arrow: pa.Schema) -> DataFrame:
    """each(block, row, above) for every node, where block holds its place in the block and `above` is the row that came
    down to the block: (tree, block, path, ...)."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in whole_blocks(batches):
            top, rows = rows[0], rows[1:]
            block = Block([row["node"] for row in rows], rows[0]["total"], depth)
            for start in range(0, len(rows), 500):
                part = rows[start : start + 500]
                yield pa.RecordBatch.from_pylist([each(block, at, row, top) for at, row in enumerate(part, start)], arrow)

    placed = nodes.withColumn("block", F.expr(f"place div {WIDTH**depth}"))
    rows = placed.unionByName(above.withColumn("place", F.lit(PATH_ROW).cast("long")), allowMissingColumns=True)
    return by_block(rows).mapInArrow(walked, schema)


PATH = f"tree string, block long, path array<{LEVEL}>, root string, subroot string"
PATH_ARROW = pa.schema([
    ("tree", pa.string()), ("block", pa.int64()), ("path", LEVEL_ARROW), ("root", pa.string()), ("subroot", pa.string()),
])


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """What comes down to each block of the first round, (tree, block, path, root, subroot); above has the same for each
    whole tree, with block 0. Goes down round by round, over nodes that are 16^3 times fewer each time."""

    def down(block: Block, at: int, row: dict, top: dict) -> dict:
        return {
            "tree": row["tree"], "block": row["place"], "path": block.shared(at) + top["path"], "root": top["root"], "subroot": top["subroot"],
        }

    for nodes in reversed(tree.rounds[1:-1]):
        above = materialize(with_paths(nodes, above, tree.depth, down, PATH, PATH_ARROW), "paths")
    return above


def manifest(
    docs: DataFrame, changed: dict[str, Column], where: Column, key: str = "doc_id", group: str = "source",
    fields: tuple[str, ...] = FIELDS, depth: int = DEPTH,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified, tampered, n_copied), one row per row of docs.

    The tree holds docs as they are. proof_sha256 is the digest of all nodes beside the row's path, from its leaf up to the
    root, each level from left to right. Where `where` holds, the row is tampered with: its leaf is made anew from the
    changed columns, and a version of the tree is folded from it; else the version is folded from the leaf itself.
    folded_root is the version's root, verified tells whether it is the root of the tree, n_copied counts the nodes that
    the version does not share. depth is the number of levels of a block and changes no result.

    Nulls: any field may be null; a null group is a source of its own, before all others; rows with a null key come
    first in their source and are never tampered with where the condition is null. Rows with equal keys follow by the digest of their
    leaf, so rows that repeat are leaves side by side. A source of one row has its leaf as root, a table of one source
    the source's. An empty table gives no rows. Columns of docs other than the fields are ignored."""
    first = leaves(docs, key, group, fields, changed, where)
    placed = materialize(numbered(first.withColumnRenamed("leaf", "node"), ["key", "node"]), "placed")
    sources = build(placed, depth)
    subroots = numbered(
        sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), ["source"]
    )
    crown = build(materialize(subroots, "subroots"), depth)
    whole = crown.roots.selectExpr(
        "tree", "0L AS block", f"CAST(array() AS array<{LEVEL}>) AS path", "node AS root", "'' AS subroot"
    )
    crown_paths = paths(crown, whole)

    def to_source(block: Block, at: int, row: dict, top: dict) -> dict:
        return {"tree": row["source"], "block": 0, "path": block.shared(at) + top["path"], "root": top["root"], "subroot": row["node"]}

    per_source = materialize(with_paths(crown.rounds[0], crown_paths, depth, to_source, PATH, PATH_ARROW), "paths")

    key_type = docs.schema[key].dataType
    out = pa.schema([
        ("key", to_arrow_type(key_type)), ("leaf", pa.string()), ("subroot", pa.string()),
        ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
        ("tampered", pa.bool_()), ("n_copied", pa.int32()),
    ])

    def version(block: Block, at: int, row: dict, top: dict) -> dict:
        shared = block.shared(at) + top["path"]
        start = row["tampered"] or row["node"]
        copies = copied_path(start, shared)
        folded = copies[-1] if copies else start
        return {
            "key": row["key"], "leaf": row["node"], "subroot": top["subroot"], "root": top["root"],
            "proof_sha256": digest("".join(level["left"] + level["right"] for level in shared)), "folded_root": folded,
            "verified": folded == top["root"], "tampered": row["tampered"] is not None,
            "n_copied": len(copies) if start != row["node"] else 0,
        }

    kind = (
        f"key {key_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
        "verified boolean, tampered boolean, n_copied int"
    )
    return with_paths(placed, paths(sources, per_source), depth, version, kind, out)
