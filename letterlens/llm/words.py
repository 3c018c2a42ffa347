"""Words and word shingles of texts, as 64-bit numbers, for use inside Arrow tasks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1_000
MIX = np.uint64(0x9E3779B97F4A7C15)
WORD_CACHE = 200_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that fewer texts are held as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


class WordHashes(dict):
    """Hash of each word (bytes), kept for words seen lately. Its size is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def stirred(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a bijection)."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def shingle_set(text: bytes | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (A-Z lowered, words divided by ASCII white space).

    Fewer words than `size` make one shingle of all words; no words make an empty set.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    last = len(words) - width + 1
    mixed = np.full(last, width, np.uint64)
    for offset in range(width):
        mixed = mixed * MIX + hashes[offset : offset + last]
    return np.unique(stirred(mixed))
