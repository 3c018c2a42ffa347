"""Connected components of an edge table, as repeated joins."""

from pyspark.sql import DataFrame, functions as F

from letterlens.scale import discard, few, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): the smallest node it can reach.

    Alternates two star steps: first each node hands its smallest neighbour to its larger neighbours, then to
    its smaller ones. Neighbours are only ever reduced to a minimum, never gathered, so a node with any number
    of edges is safe. Each round is a written table. Edges with a null end and loops are ignored.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = materialize(few(ends.where("u is not null and v is not null and u != v").distinct()), "edges")
    mark = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, current = current, materialize(few(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()), "edges")
        discard(last)
        before, mark = mark, _mark(current)
        if mark == before:
            break
    member = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(member.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
