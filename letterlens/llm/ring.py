"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from letterlens.llm.running import totals_before
from letterlens.scale import materialize

VIRTUAL_NODES = 64


def ring_nodes(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Positions of the virtual nodes in ring order, and the shard that owns each."""
    nodes = sorted((xxhash.xxh3_64_intdigest(f"{s}:{i}") - (1 << 63), s) for s in range(shards) for i in range(virtual_nodes))
    return [position for position, _ in nodes], [shard for _, shard in nodes]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Without slack the capacities add up to all rows and differ by one at most."""
    if slack:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def settle(loads: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first, last, shard): which rows of each arc go to which shard, last exclusive.

    The rows of an arc arrive at the node that ends it; what the shard there has no room for goes on clockwise. All
    arcs take one step at a time, in ring order, so a row stops at the nearest shard with room."""
    room, pieces = list(room), []
    waiting = {arc: 0 for arc, load in enumerate(loads) if load}
    for step in range(len(owners)):
        for arc in sorted(waiting):
            shard, first = owners[(arc + step) % len(owners)], waiting[arc]
            taken = min(room[shard], loads[arc] - first)
            if taken:
                room[shard] -= taken
                pieces.append((arc, first, first + taken, shard))
                waiting[arc] = first + taken
        waiting = {arc: first for arc, first in waiting.items() if first < loads[arc]}
        if not waiting:
            break
    return pieces


def shard(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row. A load is a number of rows. With slack 0 shards differ by one row
    at most; with slack 0.25, say, a shard takes up to a quarter more than its share and fewer rows move when shards are added.

    The ring key is the id with the checksum of the text. Null texts have size 1 and checksum 0; null ids and repeated
    rows are keys like others. Extra columns are ignored. Only sums per arc (shards * virtual_nodes) reach the driver."""
    raw = F.col(text).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("place", F.xxhash64("doc_id", "text_crc32"))
    positions, owners = ring_nodes(shards, virtual_nodes)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc = np.searchsorted(positions, batch.column("place").to_numpy()) % len(positions)
            yield pa.record_batch([*batch.columns, pa.array(arc, pa.int32())], [*batch.schema.names, "arc"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.mapInArrow(arcs, f"doc_id {kind}, size long, text_crc32 long, place long, arc int")
    placed = materialize(placed.withColumns({"uid": F.monotonically_increasing_id(), "one": F.lit(1).cast("long")}), "ring")
    loads = [0] * len(owners)
    for row in placed.groupBy("arc").count().collect():
        loads[row["arc"]] = row["count"]
    filled, pieces = [0] * shards, []
    for arc, first, last, target in settle(loads, owners, capacities(sum(loads), shards, slack)):
        pieces.append((arc, first, last, target, filled[target]))
        filled[target] += last - first
    table = docs.sparkSession.createDataFrame(pieces, "arc int, first long, last long, shard int, base long")
    ranked = totals_before(placed, "arc", ["place", "uid"], "one", "nth").withColumnRenamed("arc", "of")
    inside = (F.col("of") == F.col("arc")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("last"))
    # The pieces number at most arcs * shards, whatever the rows.
    return ranked.join(F.broadcast(table), inside).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - F.col("first")).alias("slot")
    )


def shard_of(key_hash: int, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> int:
    """The shard a key would have without bounds."""
    positions, owners = ring_nodes(shards, virtual_nodes)
    return owners[bisect_left(positions, key_hash) % len(positions)]
