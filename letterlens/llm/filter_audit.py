"""What filters do to each other: for every order of five filters, what each step keeps, removes and finds removed already.

Every document becomes one cell: the mask of the filters that it fails. A Gray-code walk then visits all 32 sets of
active filters, one filter toggled at a time, and every figure of every order is a difference of two of its states."""

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from letterlens.scale import materialize

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
CAPITALS = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a code point
SIGNS = b"#$%&*|"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: bytes) -> int:
    """Mask of the filters that a text fails by itself: A to D."""
    words = text.split()
    points = len(text.translate(None, CONTINUED))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        BIT["A"] * (len(words) < 100)
        + BIT["B"] * (100 * len(set(words)) < 80 * len(words))
        + BIT["C"] * (100 * capitals > 10 * points)
        + BIT["D"] * (len(text.translate(None, SIGNS)) < len(text))
    )


def facts(docs: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """Stored: (key, part, mask, digest) of each document, the mask without E."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value or b"" for value in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array(map(own_failures, texts), pa.int32()),
                    pa.array((hashlib.sha256(value).digest() for value in texts), pa.binary()),
                ],
                ["key", "part", "mask", "digest"],
            )

    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text")
    )
    return materialize(rows.mapInArrow(read, "key long, part string, mask int, digest binary"), "facts")


def failure_cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """(part, mask, documents, good, toxic): documents per part and mask of failed filters, those that labels call good
    (quality 1) and toxic (1).

    Equal texts are counted where they are summed: all rows of one text share its mask, and of those that have a key all
    but the ones with the smallest fail E. So a text that a third of all rows have is one row per task before any
    shuffle. A null text is the empty one, a null part the empty string. A null key has no labels, never fails E and
    makes no other row fail. Labels that repeat for a key count once, good or toxic if one of them says so."""
    found = facts(docs, key, part, text)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    nothing = F.lit(0)
    keyed = found.where("key is not null").join(known, "key", "left").withColumns(
        {"good": F.coalesce("good", nothing), "toxic": F.coalesce("toxic", nothing)}
    )
    rows = keyed.unionByName(found.where("key is null").withColumns({"good": nothing, "toxic": nothing}))
    cell = ["digest", "part", "mask", "good", "toxic"]
    texts = (
        rows.groupBy(*cell, "key").agg(F.count("*").alias("n"))
        .groupBy(*cell)
        .agg(
            F.sum(F.when(F.col("key").isNotNull(), F.col("n")).otherwise(0)).alias("keyed"), F.sum("n").alias("n"),
            F.min("key").alias("first"), F.min_by("n", "key").alias("at_first"),
        )
        .withColumn("lowest", F.min("first").over(Window.partitionBy("digest")))
    )
    copies = F.col("keyed") - F.when(F.col("first") == F.col("lowest"), F.col("at_first")).otherwise(0)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")),
        F.struct((F.col("mask") + BIT["E"]).alias("mask"), copies.alias("n")),
    )
    return (
        texts.select("part", "good", "toxic", F.explode(both).alias("at"))
        .groupBy("part", F.col("at.mask").alias("mask"))
        .agg(
            F.sum("at.n").alias("documents"), F.sum(F.col("at.n") * F.col("good")).alias("good"),
            F.sum(F.col("at.n") * F.col("toxic")).alias("toxic"),
        )
        .where("documents > 0")
    )


def walk(counts: np.ndarray) -> np.ndarray:
    """Survivors under every set of active filters; counts and result have one row per mask, in as many columns as wanted.

    Each step of the Gray code toggles one filter. A cell keeps the number of its failed filters that are active; where it
    leaves or reaches zero, the cell leaves or joins the running survivors."""
    masks = np.arange(len(counts))
    active = np.zeros(len(counts), np.int64)
    states = np.empty_like(counts)
    states[0] = running = counts.sum(axis=0)
    subset = 0
    for step in range(1, len(counts)):
        toggled = step & -step  # the digit in which the codes of step - 1 and step differ
        subset ^= toggled
        failing = (masks & toggled) > 0
        if subset & toggled:
            running = running - counts[failing & (active == 0)].sum(axis=0)
            active[failing] += 1
        else:
            active[failing] -= 1
            running = running + counts[failing & (active == 0)].sum(axis=0)
        states[subset] = running
    return states


ORDERS = ["".join(order) for order in permutations(FILTERS)]
_TOGGLED = np.array([[BIT[name] for name in order] for order in ORDERS])
_AFTER = np.cumsum(_TOGGLED, axis=1)
_BEFORE = _AFTER - _TOGGLED


def figures(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Each of FIGURES as an array of orders by steps, from (documents, good, toxic) per mask."""
    states = walk(counts)
    kept, lost = states[_AFTER][..., 0], states[_BEFORE] - states[_AFTER]
    removed = lost[..., 0]
    masks = np.arange(len(counts))
    failing, shapley = np.zeros_like(removed), np.zeros_like(removed)
    for bit in BIT.values():
        here = _TOGGLED == bit
        failing[here] = counts[(masks & bit) > 0, 0].sum()
        shapley[here] = removed[here].sum()
    return dict(zip(FIGURES, (kept, removed, failing - removed, counts[_TOGGLED, 0], lost[..., 1], lost[..., 2], shapley)))


def audit(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, *FIGURES) for all 120 orders from a table of failure cells: 600 rows per part, and none
    for an empty table. A part is at most 32 cells, whatever number of documents it has."""
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((f, pa.int64()) for f in FIGURES)])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.zeros((1 << len(FILTERS), 3), np.int64)
                for cell in row["cells"]:
                    counts[cell["mask"]] = cell["documents"], cell["good"], cell["toxic"]
                found = figures(counts)
                yield pa.record_batch(
                    [pa.array([row["part"]] * len(steps)), pa.array(orders), pa.array(steps), *(pa.array(found[f].ravel()) for f in FIGURES)],
                    schema=schema,
                )

    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "documents", "good", "toxic")).alias("cells"))
    return per_part.mapInArrow(judged, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))
