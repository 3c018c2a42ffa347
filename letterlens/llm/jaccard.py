"""N-gram Jaccard join by set-relation skipping.

Sets of word shingles are joined on prefix index lists. Two relations between sets save work:

* index level: the lists are kept in order of set size and prefix position and read in blocks; a pair of blocks whose
  sizes or positions cannot give the overlap asked for is skipped as a whole;
* answer level: equal sets are one node, and a set that is highly similar to a leader takes over the leader's
  answers: within a component found so far nothing is compared again, only what leads out of it is. So that a large
  group of near copies is one component before its lists are compared in full, the members of long lists are first
  compared with a few others each.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from letterlens.llm.graph import connected_components
from letterlens.llm.lists import complete_lists, pair_batches
from letterlens.llm.words import WordHashes, shingle_set, slices
from letterlens.scale import discard, few, few_dealt, materialize

SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
BLOCK = 256
# Odd multipliers and band shifts of the four leader keys.
LEADER_KEYS = ((0x9E3779B97F4A7C15, 0.0), (0xC2B2AE3D27D4EB4F, 0.5), (0x165667B19E3779F9, 0.25), (0xD6E8FEB86659FD93, 0.75))
BAND = math.log(1.25)
# A list of more entries is long. In each round its entries are paired with those so many places on, and with a leader.
LONG = 32
SHIFTS = ((1, 5, 29), (2, 11, 67))


def _binary(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def frequency_sketch(texts: DataFrame, words: int) -> np.ndarray:
    """Counts of shingles over all documents in 2^20 hashed slots (4 MB at any input size). They only steer the order
    of the prefix, so a shared slot costs time at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, slots = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in slices(batches):
            sets = [shingle_set(text, words, cache) for text in _binary(batch.column(0))]
            if sets:
                found = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
                slots += np.bincount(found.astype(np.int64), minlength=len(slots)).astype(np.uint32)
        if slots.any():
            yield from _blocks({i: slots[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK] for i in range(len(slots) // SKETCH_BLOCK)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(counts), np.uint32)
                total[block] = total[block] + part if block in total else part
        yield from _blocks(total)

    def _blocks(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if parts:
            packed = [zstandard.compress(x.astype(np.uint32).tobytes(), 1) for x in parts.values()]
            yield pa.record_batch([pa.array(list(parts), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    merged = texts.mapInArrow(count, schema).repartition(16, "block").mapInArrow(add, schema)
    slots = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in merged.collect():  # 64 blocks of 64 KB
        slots[row.block * SKETCH_BLOCK : (row.block + 1) * SKETCH_BLOCK] = np.frombuffer(zstandard.decompress(row.counts), np.uint32)
    return slots


def shingle_index(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(uid, id, n, digest, leaders, prefix, parities) per document, stored. uid numbers the rows; digest names the set;
    leaders holds a min-hash with a size band for each leader key; prefix holds the shingles of the index prefix, rarest
    first; parities holds for each of 1,024 hash slots whether an odd number of shingles falls into it."""
    levels = frequency_sketch(docs.select(text), words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            out = [[], [], [], [], []]
            for value in _binary(batch.column(1)):
                found = shingle_set(value, words, cache)
                n = len(found)
                out[0].append(n)
                out[1].append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                out[2].append([_leader_key(found, k) for k in range(len(LEADER_KEYS))] if n else [])
                length = n - -(-percent * n // 100) + 1
                level = levels[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                out[3].append(found[np.argsort(level, kind="stable")[:length]].view(np.int64) if n else found.view(np.int64))
                out[4].append(_parities(found))
            yield pa.record_batch(
                [
                    batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
                    pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64())),
                    pa.array(out[4], pa.list_(pa.int64())),
                ],
                ["id", "n", "digest", "leaders", "prefix", "parities"],
            )

    rows = docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(
        index, "id long, n long, digest binary, leaders array<long>, prefix array<long>, parities array<long>"
    )
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "shingles")


def _parities(found: np.ndarray) -> np.ndarray:
    bits = np.bincount((found & np.uint64(1023)).astype(np.int64), minlength=1024).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def _leader_key(found: np.ndarray, k: int) -> int:
    multiplier, shift = LEADER_KEYS[k]
    lowest = int((found * np.uint64(multiplier)).min())
    band = int(math.log(len(found)) / BAND + shift)
    return xxhash.xxh3_64_intdigest(f"{k}:{lowest}:{band}") - (1 << 63)


def shingle_sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, digest, shingles) of the documents given."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            found = [shingle_set(value, words, cache) for value in _binary(batch.column(1))]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]
            shingles = pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), shingles], ["id", "digest", "shingles"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(
        sets, "id long, digest binary, shingles array<long>"
    )


def verified(pairs: DataFrame, named: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Stored: the pairs (a, b) of nodes whose whole sets reach the similarity. Sets differ in at least as many shingles as their
    parities differ in slots; pairs with too many go first. Only texts of documents in a remaining pair are read."""
    side = lambda name: named.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("parities").alias(f"parities_{name}"))
    differing = F.aggregate(F.zip_with("parities_a", "parities_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    close = (100 + percent) * differing <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    pairs = materialize(few_dealt(pairs.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b")), "close")
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(few(named.join(ends, "node", "left_semi").select("node", "digest", "id")), "wanted")
    known = wanted.select(F.col("id").alias("wanted_id")).distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(
        known, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi"
    )
    sets = shingle_sets(texts, "id", "text", words).dropDuplicates(["digest"]).join(wanted.select("node", "digest"), "digest")
    sets = materialize(few_dealt(sets.select("node", "shingles")), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    enough = (100 + percent) * shared >= percent * (F.size("left") + F.size("right"))
    links = materialize(few(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")), "links")
    discard(pairs, wanted, sets)
    return links


def leader_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """A star for each leader key: every node with the smallest node of the same key and size band."""
    keyed = nodes.select("node", "n", F.explode("leaders").alias("leader_key"))
    leaders = keyed.groupBy("leader_key").agg(F.min(F.struct("node", "n")).alias("leader"), F.count("*").alias("rows"))
    pairs = keyed.join(leaders.where("rows > 1"), "leader_key")
    fits = 100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n")
    return pairs.where((F.col("node") != F.col("leader.node")) & fits).select(
        F.col("leader.node").alias("a"), F.col("node").alias("b")
    ).distinct()


def index_lists(nodes: DataFrame) -> DataFrame:
    """Stored: (shingle, place, node) of every index list with more than one node. place is the size of the set, shifted by
    32 bits, plus the position of the shingle in its prefix."""
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("position", "shingle")).select(
        "shingle", (F.shiftleft("n", 32) + F.col("position")).alias("place"), "node"
    )

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts, ends in complete_lists(batches):
            wanted = np.repeat(ends - starts > 1, ends - starts)
            if wanted.any():
                yield pa.record_batch([pa.array(column[wanted]) for column in columns], ["shingle", "place", "node"])

    together = entries.repartition("shingle").sortWithinPartitions("shingle")
    return materialize(few_dealt(together.mapInArrow(several, "shingle long, place long, node long")), "lists")


def list_pairs(entries: DataFrame, components: DataFrame, percent: int, round_: int | None = None) -> DataFrame:
    """Pairs of nodes from different components that share a prefix shingle at positions that leave room for the
    overlap asked for. In a round, only some of those in long lists: their number follows that of the entries."""
    labelled = entries.join(components, "node", "left").select(
        "shingle", "place", "node", F.coalesce("component", "node").alias("component")
    )

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (_, place, node, component), starts, ends in complete_lists(batches):
                mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
                if round_ is not None:
                    mixed &= ends - starts > LONG
                for start, end in zip(starts[mixed], ends[mixed]):
                    one = (place[start:end], node[start:end], component[start:end], percent)
                    yield from _list(*one) if round_ is None else _some(*one, round_)

        yield from pair_batches(found())

    sorted_lists = labelled.repartition("shingle").sortWithinPartitions("shingle", "place")
    return sorted_lists.mapInArrow(lists, "a long, b long").distinct()


def _some(place: np.ndarray, node: np.ndarray, component: np.ndarray, percent: int, round_: int) -> Iterator[tuple]:
    """Pairs of each entry of one index list with entries near it in order of size, and with the leader of its band of sizes:
    the set that has the shingle earliest in its prefix has the fewest shingles of its own, as the original of altered copies."""
    size, position = place >> 32, place & 0xFFFFFFFF
    band = (np.log(size) / BAND + round_ / len(SHIFTS)).astype(np.int64)
    leaders = np.empty(len(place), np.int64)
    edges = np.r_[np.flatnonzero(np.r_[True, band[1:] != band[:-1]]), len(place)]
    for start, end in zip(edges[:-1], edges[1:]):
        leaders[start:end] = start + np.argmin(position[start:end])
    here = np.arange(len(place))
    for there in (leaders, *((here + shift) % len(place) for shift in SHIFTS[round_])):
        room = np.minimum(size - position, (size - position)[there])
        x = np.flatnonzero(((100 + percent) * room >= percent * (size + size[there])) & (component != component[there]))
        if len(x):
            yield node[x], node[there[x]]


def _list(place: np.ndarray, node: np.ndarray, component: np.ndarray, percent: int) -> Iterator[tuple]:
    """Pairs of one index list, block by block. Sizes rise along the list, so for each block the earlier blocks that are
    too small, that are of the same component, or whose best position is too late are skipped."""
    size, position = place >> 32, place & 0xFFFFFFFF
    room = size - position  # the most that two sets can share from here on
    firsts = range(0, len(place), BLOCK)
    tops = [(component[f : f + BLOCK].min(), component[f : f + BLOCK].max(), room[f : f + BLOCK].max()) for f in firsts]
    for i, f in enumerate(firsts):
        here = slice(f, f + BLOCK)
        for j in range(i, -1, -1):
            g = j * BLOCK
            there = slice(g, g + BLOCK)
            if 100 * size[there][-1] < percent * size[f]:
                break
            lowest, highest, best = tops[j]
            if lowest == highest == tops[i][0] == tops[i][1]:
                continue
            if (100 + percent) * min(best, tops[i][2]) < percent * (size[f] + size[g]):
                continue
            enough = (100 + percent) * np.minimum(room[here][:, None], room[there][None]) >= percent * (
                size[here][:, None] + size[there][None]
            )
            x, y = np.nonzero(enough & (component[here][:, None] != component[there][None]))
            if i == j:
                x, y = x[x > y], y[x > y]
            if len(x):
                yield node[here][x], node[there][y]


def _widened(components: DataFrame, pairs: DataFrame, check: tuple) -> DataFrame:
    """Stored: (node, component), components with those joined that the pairs link. The table given goes."""
    pairs = materialize(few(pairs), "pairs")
    links = verified(pairs, *check)
    known = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components if links.isEmpty() else materialize(few(connected_components(known.unionByName(links))), "components")
    discard(pairs, links, *(() if found is components else (components,)))
    return found


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(uid, id, n, digest, component) per document: the number of its shingles and the smallest id reachable over links,
    itself included. Two documents link when 100 * |intersection| >= percent * |union|.

    Null or blank texts have no shingles and link with nothing. Rows with a null id take part; a component of null ids
    only has the component null. Repeated rows and equal texts share a component. Extra columns are ignored.
    """
    docs = docs.select(F.col(key).alias("row_id"), F.col(text).alias("row_text"))
    indexed = shingle_index(docs, "row_id", "row_text", words, percent)
    rows = materialize(few(indexed.select("uid", "id", "n", "digest")), "rows")
    names = rows.where("n > 0").groupBy("digest").agg(F.min("uid").alias("node"), F.min("id").alias("id"))
    first = indexed.drop("id", "digest").withColumnRenamed("uid", "node")
    named = materialize(few_dealt(first.join(names, "node")), "nodes")
    discard(indexed)
    nodes = named.select("node", "n", "leaders", "prefix")
    check = (named, docs, "row_id", "row_text", words, percent)
    alone = nodes.select("node", F.col("node").alias("component")).limit(0)
    components = _widened(materialize(few(alone), "components"), leader_pairs(nodes, percent), check)
    entries = index_lists(nodes)
    for round_ in range(len(SHIFTS)):
        components = _widened(components, list_pairs(entries, components, percent, round_), check)
    components = _widened(components, list_pairs(entries, components, percent), check)
    groups = named.join(components, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component"))
    groups = materialize(few(groups), "groups")
    discard(named, entries, components)
    lowest = groups.groupBy("component").agg(F.min("id").alias("lowest"))
    labels = groups.join(lowest, "component").select("digest", "lowest")
    return rows.select("uid", "id", "n", "digest").join(labels, "digest", "left").select(
        "uid", "id", "n", "digest", F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id")).alias("component")
    )


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest id, of repeated rows the first. Documents
    without words are groups of their own."""
    found = materialize(few(jaccard_components(docs, key, text, words, percent)), "groups")
    chosen = found.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("first"))
    single = found.where("n = 0").select("uid").unionByName(chosen.select(F.col("first.uid").alias("uid")))
    kept = found.join(single, "uid", "left_semi")
    per_id = found.groupBy("id").agg(F.count("*").alias("rows"))
    unique = kept.join(per_id.where("rows = 1 and id is not null"), "id", "left_semi").select(F.col("id").alias(key))
    result = docs.join(unique, key, "left_semi")
    shared = materialize(few(kept.join(per_id.where("rows > 1 or id is null").select(F.col("id").alias("other")),
                                       F.col("id").eqNullSafe(F.col("other")), "left_semi")), "shared")
    if shared.isEmpty():
        return result
    wanted = shared.select(F.col("id").alias("wanted_id"), F.col("digest").alias("wanted_digest")).distinct()
    again = docs.join(wanted.select("wanted_id").distinct(), F.col(key).eqNullSafe(F.col("wanted_id")), "left_semi")
    marked = again.withColumn("set_of_row", _digest(text, words))
    same = F.col(key).eqNullSafe(F.col("wanted_id")) & F.col("set_of_row").eqNullSafe(F.col("wanted_digest"))
    worded = marked.join(wanted, same, "left_semi")
    first = worded.where("set_of_row is not null").dropDuplicates([key, "set_of_row"])
    blank = worded.where("set_of_row is null")
    return result.unionByName(first.unionByName(blank).select(docs.columns))


def _digest(text: str, words: int):
    @F.udf("binary", useArrow=True)
    def digest(value):
        found = shingle_set(value.encode() if value is not None else None, words, WordHashes())
        return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None

    return digest(F.col(text))
