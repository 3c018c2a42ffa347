"""Near-duplicate lines by a segment-partition edit join.

A line is cut into limit + 1 segments. A line within `limit` edits of it keeps one of them as it is, at a place that the
difference in length bounds, so the substrings at those places are probed against an index of segments by length and
number. What meets there is verified by a banded bit-parallel edit distance. Lines already known to be in one class are
not compared again."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from letterlens.llm.edit_distance import within
from letterlens.llm.graph import connected_components
from letterlens.llm.lists import complete_lists, pair_batches
from letterlens.scale import materialize

LIMIT = 2
# Lines of LEAST code points or more may differ by LIMIT edits, lines of SHORT or more by one.
LEAST = 40
SHORT = 12
SEEN = 500_000
# So many lines or code points are entered at a time.
LINES = 4_000
CODES = 1 << 20
BLOCK = 256


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of each segment; sizes differ by one at most, the longer ones last."""
    small, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = small + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def allowed(length: int, limit: int, least: int = 0) -> int:
    """Edits between a line of this length and an equally long or longer one of its class."""
    if length >= max(least, limit + 1):
        return limit
    return min(limit, 1) if length >= SHORT else 0


def index_keys(line: str, limit: int, least: int = 0) -> list[int]:
    """Keys as unsigned numbers."""
    return [_key(line[at:end], seed) for at, end, seed in _pieces(len(line), limit, least)[0]]


def probe_keys(line: str, limit: int, least: int = 0) -> list[int]:
    """Keys under which an equally long or shorter line within the limit would be found, each once."""
    return list(dict.fromkeys([_key(line[at:end], seed) for at, end, seed in _pieces(len(line), limit, least)[1]]))


_key = xxhash.xxh3_64_intdigest


@lru_cache(maxsize=10_000)
def _pieces(n: int, limit: int, least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, end, seed) of the index keys and of the probe keys of a line of n code points. The seed names the length and the
    number of the segment."""
    index = [(at, at + size, n * 64 + i) for i, (at, size) in enumerate(cuts(n, allowed(n, limit, least) + 1))]
    probes = []
    for other in range(max(1, n - limit), n + 1):
        gap, most = n - other, allowed(other, limit, least)
        if gap > most or not most:
            continue
        for i, (at, size) in enumerate(cuts(other, most + 1)):
            # Edits before segment i number at most i, edits behind it at most `most` - i.
            first = max(0, at - i, at + gap - (most - i))
            last = min(n - size, at + i, at + gap + (most - i))
            probes += [(place, place + size, other * 64 + i) for place in range(first, last + 1)]
    return index, probes


def parities(lines: list[str]) -> np.ndarray:
    """For each line, and each of 64 hash slots, whether an odd number of neighbouring code point pairs falls into it. An edit
    changes four slots at most. No line is empty."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(line) for line in lines])
    following = np.r_[codes[1:], np.uint64(0)]
    slots = (codes * np.uint64(0x9E3779B97F4A7C15) + following) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(58)
    bits = np.uint64(1) << slots
    bits[ends - 1] = 0  # no pair spans two lines
    return np.bitwise_xor.reduceat(bits, np.r_[0, ends[:-1]]).view(np.int64)


def parity(line: str) -> int:
    return int(parities([line])[0]) if line else 0


def split_lines(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines that hold a word; lines end at \\n."""
    return [(i, line) for i, line in enumerate((text or "").split("\n")) if line.strip(" \t\n\r\v\f")]


def line_numbers(docs: DataFrame) -> DataFrame:
    """Stored: (uid, id, numbers, lines), the places and hashes of the lines of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_lines(text) for text in batch.column(1).to_pylist()]
            numbers = pa.array([[i for i, _ in lines] for lines in found], pa.list_(pa.int32()))
            hashes = pa.array([[line_hash(line) for _, line in lines] for lines in found], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), numbers, hashes], ["id", "numbers", "lines"])

    rows = docs.mapInArrow(read, "id long, numbers array<int>, lines array<long>")
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "lines")


def index_entries(docs: DataFrame, limit: int, least: int) -> DataFrame:
    """Stored: (key, line, parity, place) of every index list with more than one line. place is twice the length, plus one for an
    index entry (else it is a probe). A line that many documents share enters once per task."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh, names, codes = [], [], 0
            for text in batch.column(1).to_pylist():
                for _, line in split_lines(text):
                    name = line_hash(line)
                    if name in seen or not allowed(len(line), limit, least):
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    fresh.append(line)
                    names.append(name)
                    codes += len(line)
                    if len(fresh) >= LINES or codes >= CODES:
                        yield _of_lines(fresh, names)
                        fresh, names, codes = [], [], 0
            if fresh:
                yield _of_lines(fresh, names)

    def _of_lines(lines: list[str], names: list[int]) -> pa.RecordBatch:
        keys, counts, places = [], [], []
        for line in lines:
            index, probes = index_keys(line, limit, least), probe_keys(line, limit, least)
            keys += index
            keys += probes
            counts += (len(index), len(probes))
            places += (2 * len(line) + 1, 2 * len(line))
        key = (np.array(keys, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
        each = np.add.reduceat(counts, np.arange(0, len(counts), 2))
        return _entries(key, np.repeat(names, each), np.repeat(parities(lines), each), np.repeat(places, counts))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts, ends in complete_lists(batches):
            mixed = np.minimum.reduceat(columns[1], starts) != np.maximum.reduceat(columns[1], starts)
            wanted = np.repeat(mixed, ends - starts)
            if wanted.any():
                yield _entries(*(column[wanted] for column in columns))

    def _entries(*columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(column, pa.int64()) for column in columns], ["key", "line", "parity", "place"])

    schema = "key long, line long, parity long, place long"
    entries = docs.mapInArrow(enter, schema).repartition("key").sortWithinPartitions("key")
    return materialize(entries.mapInArrow(several, schema).distinct(), "entries")


def leader_pairs(entries: DataFrame, limit: int, least: int) -> DataFrame:
    """A star for each index list: its first indexed line with every other line."""
    indexed = entries.where("place % 2 = 1").groupBy("key").agg(F.min(F.struct("line", "parity", "place")).alias("leader"))
    differing = F.bit_count(F.col("parity").bitwiseXOR(F.col("leader.parity")))
    length, other = F.shiftright("place", 1), F.shiftright("leader.place", 1)
    most = F.when(F.least(length, other) >= max(least, limit + 1), limit).otherwise(min(limit, 1))
    near = (differing <= 4 * most) & (F.abs(length - other) <= most)
    pairs = entries.join(indexed, "key").where((F.col("line") != F.col("leader.line")) & near)
    return pairs.select(F.col("leader.line").alias("a"), F.col("line").alias("b")).distinct()


def list_pairs(entries: DataFrame, components: DataFrame, limit: int, least: int) -> DataFrame:
    """Pairs of an indexed and a probing line of one list, from different components, close in length and parity."""
    labelled = entries.join(components.withColumnRenamed("node", "line"), "line", "left").select(
        "key", "place", "line", "parity", F.coalesce("component", "line").alias("component")
    )

    def near(place, line, sign, component) -> Iterator[tuple]:
        index = np.flatnonzero(place & 1)
        probes = np.flatnonzero(~place & 1)
        for f in range(0, len(index), BLOCK):
            x = index[f : f + BLOCK]
            most = np.where(place[x] >> 1 >= max(least, limit + 1), limit, min(limit, 1))[:, None]
            for g in range(0, len(probes), BLOCK):
                y = probes[g : g + BLOCK]
                gap = (place[y][None] >> 1) - (place[x][:, None] >> 1)
                close = np.bitwise_count((sign[x][:, None] ^ sign[y][None]).view(np.uint64)) <= 4 * most
                i, j = np.nonzero((gap >= 0) & (gap <= most) & close & (component[x][:, None] != component[y][None]))
                if len(i):
                    yield line[x[i]], line[y[j]]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (_, place, line, sign, component), starts, ends in complete_lists(batches):
                mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
                for start, end in zip(starts[mixed], ends[mixed]):
                    yield from near(place[start:end], line[start:end], sign[start:end], component[start:end])

        yield from pair_batches(found())

    return labelled.repartition("key").sortWithinPartitions("key", "place").mapInArrow(lists, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, limit: int, least: int) -> DataFrame:
    """The pairs of lines whose edit distance is within the limit for the shorter line. One document is read for each line asked for."""
    wanted = materialize(pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct(), "wanted")
    holders = rows.select("id", F.explode("lines").alias("line")).join(wanted, "line", "left_semi").groupBy("line").agg(F.max("id").alias("holder"))
    holders = materialize(holders.select("holder").distinct(), "holders")
    texts = docs.join(holders, F.col("id").eqNullSafe(F.col("holder")), "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = {line_hash(line): line for text in batch.column(1).to_pylist() for _, line in split_lines(text)}
            yield pa.record_batch([pa.array(list(lines), pa.int64()), pa.array(list(lines.values()), pa.string())], ["line", "text"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            same = [within(a, b, allowed(min(len(a), len(b)), limit, least)) for a, b in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    known = texts.mapInArrow(read, "line long, text string").join(wanted, "line", "left_semi").dropDuplicates(["line"])
    known = materialize(known, "texts")
    left = known.select(F.col("line").alias("a"), F.col("text").alias("left"))
    right = known.select(F.col("line").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(check, "a long, b long")


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """(uid, id, n_lines, kept_lines, n_removed) per document. Lines of `least` code points or more are of one class when
    edits of at most `limit` code points lead from one to the other, over any number of lines between; when the shorter
    of two lines has fewer, but SHORT or more, one edit; lines shorter than that when they are equal. Of each class the line of the smallest id (of rows with equal ids the first, there the first
    line) is kept; kept_lines has the numbers of the kept lines, from 0.

    Lines without a word do not count. Null and empty texts have no lines; rows with null ids come last; repeated rows
    are told apart by their place in the table. Extra columns are ignored."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = line_numbers(docs)
    entries = index_entries(docs, limit, least)
    links = materialize(verified(materialize(leader_pairs(entries, limit, least), "pairs"), docs, rows, limit, least), "links")
    first = materialize(connected_components(links), "components")
    crossing = materialize(list_pairs(entries, first, limit, least), "pairs")
    known = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    classes = connected_components(known.unionByName(verified(crossing, docs, rows, limit, least)))
    places = rows.select("uid", "id", F.explode(F.arrays_zip("numbers", "lines")).alias("at"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "uid", F.col("at.numbers").alias("number"))
    lines = places.groupBy(F.col("at.lines").alias("node")).agg(F.min(place).alias("place"))
    kept = lines.join(classes, "node", "left").groupBy(F.coalesce("component", "node").alias("class")).agg(F.min("place").alias("place"))
    per_document = kept.groupBy(F.col("place.uid").alias("uid")).agg(F.sort_array(F.collect_list("place.number")).alias("kept_lines"))
    n_lines = F.size("lines").cast("long")
    kept_lines = F.coalesce("kept_lines", F.array().cast("array<int>"))
    return rows.join(per_document, "uid", "left").select(
        "uid", "id", n_lines.alias("n_lines"), kept_lines.alias("kept_lines"), (n_lines - F.size(kept_lines)).alias("n_removed")
    )
