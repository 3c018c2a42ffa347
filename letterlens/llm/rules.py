"""Quality rules as a ledger of bits: every rule is evaluated once, policies are masks over the bits."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

SYMBOLS = b"#*$%&|<>"
MARKS = b"#*$%&|<>!"
CAPITALS = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a code point
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marked_words")


@dataclass(frozen=True)
class Rule:
    """fails is an SQL condition over the measurements. Its place in RULES is its bit and never changes."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * word_chars"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "n_words >= 10 and 100 * n_upper > 50 * word_chars"),
    Rule("marked_words", "n_words >= 10 and 100 * n_marked_words > 30 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
)
BIT = {rule.name: i for i, rule in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
# A policy is a version and the rules that it asks for.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines"),
    "v3": (*BASE, "symbols", "duplicate_lines", "capitals", "marked_words", "long_words"),
}


def mask(names) -> int:
    return sum(1 << BIT[name] for name in names)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside runs of `window` words that the text has twice or more."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    runs = ids
    for offset in range(1, window):  # exact: each step numbers the distinct longer runs anew
        runs = joined(runs[:-1], ids[offset:])
    twice = np.bincount(runs)[runs] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:count] += twice
    cover[window : window + count] -= twice
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    joined = b"".join(words)
    seen: set[bytes] = set()
    dup = n_lines = 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    without = lambda some: len(joined) - len(joined.translate(None, some))
    marked = sum(word[-1:] in MARKS for word in words)
    return (
        len(words), len(joined) - without(CONTINUED), without(SYMBOLS), dup, repeated_words(words), n_lines,
        without(CAPITALS), marked,
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of the text and failed_bits: bit i is set when rule i fails. No rule is evaluated
    twice, whatever number of policies is applied later. Null and empty texts measure 0. Columns of docs that bear the
    name of a measurement are replaced; the text column is dropped."""
    keys = docs.drop(*MEASURES, "failed_bits")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(value) for value in batch.column(text).cast(pa.binary()).to_pylist()]
            columns = zip(*rows) if rows else [[] for _ in MEASURES]
            others = [name for name in batch.schema.names if name != text]
            yield pa.record_batch(
                [*(batch.column(name) for name in others), *(pa.array(list(c), pa.int64()) for c in columns)], [*others, *MEASURES]
            )

    schema = StructType([*keys.drop(text).schema])
    for name in MEASURES:
        schema = schema.add(name, "long")
    bits = sum((F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES)), F.lit(0))
    return keys.mapInArrow(measured, schema).withColumn("failed_bits", bits.cast("long"))


def passes(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def deciding_rule(policy: str) -> Column:
    """The rule that alone fails a document under the policy; null where none or several fail."""
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy])))
    return F.coalesce(*(F.when(failed == 1 << BIT[name], F.lit(name)) for name in POLICIES[policy]))


def ablations(found: DataFrame) -> DataFrame:
    """(policy, rule, documents, kept, kept_without, any_failed): what each policy keeps, what it would keep without one
    of its rules, and the rules that failed anywhere. The ledger is folded to one row per bit pattern first (at most
    2^rules), so policies and ablations never touch the documents again."""
    patterns = found.groupBy("failed_bits").agg(F.count("*").alias("documents"))
    cases = [
        f"named_struct('policy', '{version}', 'rule', '{name}', 'mask', {mask(names)}L, 'mask_without', {mask(names) & ~(1 << BIT[name])}L)"
        for version, names in POLICIES.items() for name in names
    ]
    kept = lambda column: F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col(column)) == 0, F.col("documents")).otherwise(0))
    return (
        patterns.select("*", F.expr(f"inline(array({', '.join(cases)}))"))
        .groupBy("policy", "rule")
        .agg(
            F.sum("documents").alias("documents"), kept("mask").alias("kept"), kept("mask_without").alias("kept_without"),
            F.bit_or("failed_bits").alias("any_failed"),
        )
    )
