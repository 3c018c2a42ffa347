"""File names without collisions for a stream of matches, with the taken numbers as state instead of a look at all
earlier names."""

import json
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from letterlens.functions.names import numbered_name

STORED = "archive string, block_start bigint, block_pos bigint, base_name string"
KEYS = ["archive", "block_start", "block_pos"]
BLOCK = ["archive", "block_start"]
PACKED = "root string, base_name string, archive string, block_start bigint, block_pos array<bigint>"
PLACED = PACKED.replace("root string, ", "") + ", number array<bigint>"
NUMBERS = r"^(.*?)(?:_\d{3,})+(\.[^.]*)$"  # all numbers at the end of a name
NUMBER = re.compile(r"(.*)_(\d{3,})(\.[^.]*)", re.S)


class Slots:
    """The taken numbers of names that differ in the numbers at their end only, as intervals [from, to) per name; 0 is
    the name itself. Numbers are handed out in a row, so a name has few intervals however often it was used."""

    def __init__(self, stored: str = "{}") -> None:
        self.of: dict[str, list[list[int]]] = json.loads(stored)

    def add(self, name: str, first: int, end: int) -> None:
        """first to end, none of them taken, become so."""
        spans = self.of.setdefault(name, [])
        at = bisect(spans, [first, end])
        spans.insert(at, [first, end])
        for i in (at + 1, at):
            if 0 < i < len(spans) and spans[i - 1][1] == spans[i][0]:
                spans[i - 1][1] = spans.pop(i)[1]

    def has(self, name: str, number: int) -> bool:
        spans = self.of.get(name, [])
        at = bisect(spans, [number, 1 << 62]) - 1
        return at >= 0 and number < spans[at][1]

    def take(self, name: str, n: int) -> np.ndarray:
        """Numbers for n > 0 uses of a name: the name itself if it is free, then those after the highest that is taken. A name
        that ends in a number is a number of the name without it as well."""
        numbers = np.empty(n, np.int64)
        given = 0
        if not self.has(name, 0):
            found = NUMBER.fullmatch(name)
            above, number = (found[1] + found[3], int(found[2])) if found else ("", 0)
            numbered = number > 0 and f"{found[1]}_{number:03d}{found[3]}" == name
            if not (numbered and self.has(above, number)):
                numbers[0], given = 0, 1
                if numbered:
                    self.add(above, number, number + 1)
            self.add(name, 0, 1)
        start = self.of[name][-1][1]
        if given < n:
            numbers[given:] = np.arange(start, start + n - given)
            self.add(name, start, start + n - given)
        return numbers

    def stored(self) -> str:
        return json.dumps(self.of)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per name and run of messages of one file block, with the places as a list, so that a name that a third of all
    messages bear reaches its state in few rows, and each of its messages as one number."""
    for batch in batches:
        rows = pa.table(batch)
        opens = np.ones(batch.num_rows, bool)
        same = [pc.fill_null(pc.equal(batch.column(c)[1:], batch.column(c)[:-1]), False) for c in BLOCK]
        opens[1:] = ~np.logical_and(*(s.to_numpy(zero_copy_only=False) for s in same))
        grouped = rows.append_column("run", pa.array(np.cumsum(opens))).group_by(["root", "base_name", "run", *BLOCK], use_threads=False)
        packed = grouped.aggregate([("block_pos", "list")]).drop_columns("run")
        yield from packed.rename_columns(["root", "base_name", *KEYS]).to_batches()


def _placed(root: tuple, packs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    slots = Slots(*state.get) if state.exists else Slots()
    for pack in packs:
        placed = pack.drop(columns="root")
        placed["number"] = [slots.take(name, len(keys)) for name, keys in zip(pack["base_name"], pack["block_pos"])]
        yield placed
    state.update((slots.stored(),))


def stream_names(matches: DataFrame) -> DataFrame:
    """(keys, base, file_name, collision) for a stream of the columns STORED. Names are given in the order of arrival, are
    unique over all batches, and do not change afterwards; base names are not null, extra columns are ignored.

    State is kept per name without its numbers. Only keys and names pass through it, packed into lists beforehand, and the cost of a
    batch depends on that batch alone."""
    root = F.regexp_replace("base_name", NUMBERS, "$1$2").alias("root")
    packed = matches.select(root, "base_name", *KEYS).mapInArrow(_packed, PACKED)
    placed = packed.groupBy("root").applyInPandasWithState(_placed, PLACED, "slots string", "append", GroupStateTimeout.NoTimeout)
    single = placed.select("base_name", *BLOCK, F.inline(F.arrays_zip("block_pos", "number")))
    return single.select(
        *KEYS, F.col("base_name").alias("base"), numbered_name(F.col("base_name"), F.col("number")).alias("file_name"),
        (F.col("number") > 0).alias("collision"),
    )


def start_names(
    spark: SparkSession, table: str, names: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Name what start_intake has appended to a table since the last call, and append the names to another. Of the
    table only keys and names are read."""
    reader = spark.readStream.schema(STORED).option("maxFilesPerTrigger", files_per_batch)
    writer = stream_names(reader.parquet(table)).writeStream.format("parquet").option("path", names)
    return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
