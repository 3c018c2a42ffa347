"""Reading index lists inside a task: rows come sorted by list key, in Arrow batches."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def complete_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, starts, ends) of whole lists; the first column is the list key. The last list of a batch waits for the
    next batch."""
    held = None
    for batch in batches:
        columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        if held:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(columns[0]):
            continue
        starts = _starts(columns[0])
        held = [column[starts[-1] :] for column in columns]
        if len(starts) > 1:
            yield [column[: starts[-1]] for column in columns], starts[:-1], starts[1:]
    if held:
        yield held, np.array([0]), np.array([len(held[0])])


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def pair_batches(found: Iterator[tuple[np.ndarray, np.ndarray]], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of distinct pairs (a, b), the smaller number first."""
    left, right, count = [], [], 0
    for a, b in found:
        left.append(np.minimum(a, b))
        right.append(np.maximum(a, b))
        count += len(a)
        if count > size:
            yield _pairs(left, right)
            left, right, count = [], [], 0
    if count:
        yield _pairs(left, right)


def _pairs(left: list, right: list) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
    return pa.record_batch([pa.array(both[0]), pa.array(both[1])], ["a", "b"])
