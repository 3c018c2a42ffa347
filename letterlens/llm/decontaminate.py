"""Benchmark decontamination: an FM-index per shard of documents is searched for the phrases of a benchmark."""

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from letterlens.llm.fm_index import FMIndex

WINDOW = 10
ITEM_BLOCK = 20_000
# Words are 0-9, a-z and everything beyond ASCII; A-Z are lowered.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SPANS = "array<struct<start: bigint, end: bigint>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """The distinct windows of a block of items, by length, and the items that each comes from."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[int]] = {}
        for item, (_, text) in enumerate(items):
            words = (text or "").encode().translate(FOLD).split()
            ids = [self.vocabulary.setdefault(word, len(self.vocabulary) + 1) for word in words]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[start : start + window]), set()).add(item)
        self.groups = []
        for length in sorted({len(phrase) for phrase in owners}):
            chosen = [(phrase, sorted(found)) for phrase, found in owners.items() if len(phrase) == length]
            counts = np.array([len(found) for _, found in chosen])
            self.groups.append(
                (np.array([phrase for phrase, _ in chosen], np.int64), np.r_[0, np.cumsum(counts)],
                 np.array([item for _, found in chosen for item in found], np.int64))
            )
        self.shortest = min((group[0].shape[1] for group in self.groups), default=0)

    def find(self, texts: list[bytes | None]) -> tuple[list[int], list[list], list[list]]:
        """Per text: its number of words, the merged word spans inside occurrences, the names of the items found."""
        n_words, symbols, owner, offset = [], [], [], []
        get = self.vocabulary.get
        for text_no, text in enumerate(texts):
            words = text.translate(FOLD).split() if text else []
            n_words.append(len(words))
            if not words or not self.groups:
                continue
            ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            edges = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0].astype(np.int8)))
            for start, end in zip(edges[::2], edges[1::2]):
                if end - start >= self.shortest:  # a stretch of phrase words; the index divides stretches by a 0
                    symbols += [ids[start:end], [0]]
                    owner.append(np.full(end - start + 1, text_no))
                    offset.append(np.arange(start, end + 1))
        spans, names = [[] for _ in texts], [[] for _ in texts]
        if symbols:
            self._search(np.concatenate(symbols), np.concatenate(owner), np.concatenate(offset), spans, names)
        return n_words, spans, names

    def _search(self, symbols, owner, offset, spans, names) -> None:
        index = FMIndex(symbols, len(self.vocabulary))
        cover = np.zeros(len(symbols) + 1, np.int64)
        found = []
        for phrases, bounds, items in self.groups:
            low, high = index.search(phrases)
            rows = np.repeat(np.arange(len(phrases)), high - low)
            places = index.locate(np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[rows])
            np.add.at(cover, places, 1)
            np.add.at(cover, places + phrases.shape[1], -1)
            seen = np.unique(np.stack([owner[places], rows]), axis=1)
            per = bounds[seen[1] + 1] - bounds[seen[1]]
            at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(bounds[seen[1]], per)
            found.append(np.stack([np.repeat(seen[0], per), items[at]]))
        edges = np.flatnonzero(np.diff(np.r_[0, np.cumsum(cover[:-1]) > 0, 0].astype(np.int8)))
        for start, end in zip(edges[::2], edges[1::2]):
            spans[owner[start]].append((int(offset[start]), int(offset[start]) + int(end - start)))
        for text_no, item in np.unique(np.concatenate(found, axis=1), axis=1).T:
            names[text_no].append(self.names[item])


def _merged(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(benchmark: DataFrame, key: str, text: str, window: int, item_block: int = ITEM_BLOCK) -> list[Phrases]:
    """The benchmark in blocks of about `item_block` items, cut by hash. Documents are searched for every block. Rows
    that are equal are one item."""
    items = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    blocks = items.count() // item_block + 1
    place = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return [Phrases([(r.item, r.text) for r in items.where(place == i).collect()], window) for i in range(blocks)]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """docs with n_words, spans (word numbers from 0, end exclusive, merged), items (ids as text, sorted, distinct) and
    n_unnamed (different items without an id that were found; their words are hit like all others).

    A phrase is every run of `window` words of an item; an item with fewer words is one phrase, one without words none. Null texts have no words. Columns of docs that bear one of the new names are replaced. Repeated rows and ids
    are treated one by one: nothing is shuffled.
    """
    result = docs.drop("n_words", "spans", "items", "n_unnamed").select(
        "*", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("n_unnamed"),
    )
    for phrases in item_blocks(benchmark, item_key, item_text, window, item_block):
        result = result.mapInArrow(_marker(phrases, text), result.schema)
    return result


def _marker(phrases: Phrases, text: str):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = phrases.find(batch.column(text).cast(pa.binary()).to_pylist())
            spans = [_merged(a + [(s["start"], s["end"]) for s in b]) for a, b in zip(spans, batch.column("spans").to_pylist())]
            unnamed = [a.count(None) + n for a, n in zip(items, batch.column("n_unnamed").to_pylist())]
            items = [sorted({*a, *b} - {None}) for a, b in zip(items, batch.column("items").to_pylist())]
            new = {
                "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], SPANS_ARROW),
                "items": pa.array(items, pa.list_(pa.string())),
                "n_unnamed": pa.array(unnamed, pa.int64()),
            }
            names = batch.schema.names
            yield pa.record_batch([new.get(name, batch.column(name)) for name in names], names)

    return mark


def remove_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """docs with the words inside occurrences cut out of the text. The occurrences of all blocks of items are found in the
    same text and cut at once; what is left of it is searched again for all blocks, so that no phrase arises across a
    cut. Documents without a hit keep their text byte by byte."""
    return docs.mapInArrow(_cutter(item_blocks(benchmark, item_key, item_text, window, item_block), text), docs.schema)


def _cutter(blocks: list[Phrases], text: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            left = list(range(len(texts)))
            changed = False
            while left:
                searched = [phrases.find([texts[i] for i in left])[1] for phrases in blocks]
                merged = [_merged([span for spans in found for span in spans]) for found in zip(*searched)]
                left, merged = [i for i, spans in zip(left, merged) if spans], [spans for spans in merged if spans]
                for i, spans in zip(left, merged):
                    texts[i], changed = _without(texts[i], spans), True
            if changed:
                column = pa.array(texts, pa.binary()).cast(batch.column(text).type)
                names = batch.schema.names
                batch = pa.record_batch([column if name == text else batch.column(name) for name in names], names)
            yield batch

    return cut


def _without(text: bytes, spans: list[tuple]) -> bytes:
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last : places[start][0]])
        last = places[end - 1][1]
    return b"".join([*kept, text[last:]])
