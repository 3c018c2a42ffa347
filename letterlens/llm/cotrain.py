"""Quality classifier by co-training.

Two views of a document are learned apart: the words of its text, and its page metadata (language, source, length, layout
and the shares of kinds of characters). Over some rounds each view labels the unlabelled documents that it is sure of for the
other. All unlabelled documents take part: Spark sums the counts of their words and the gradients, and only sums of
the size of a model reach the driver. Both are then calibrated on rows held out and combined, and the pair scores every document."""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from letterlens.llm.words import slices
from letterlens.scale import discard, few, few_dealt, gather, materialize

# Bound of the labelled rows, chosen by hash of the id. Unlabelled rows have none.
MAX_LABELLED = 8_000
ROUNDS = 3
STEPS = 10
SURE = 0.97
# Words of a target: as many from the labelled rows, and as many more from the exchange of the latest round.
MAX_WORDS = 4_000
FAR = 20.0
LEAST_Z = 4.0
FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SIGNS = bytes(c if 33 <= c <= 126 and not chr(c).isalnum() else 32 for c in range(256))
DIGITS, CONTINUED = b"0123456789", bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>!"
HASHED = 16
STEM = 6
FEW = np.array([xxhash.xxh3_64_intdigest(b"few"), xxhash.xxh3_64_intdigest(b"very few")], np.uint64)
# Bytes of texts whose words are taken together, but for a longer last one.
MOST_TOGETHER = 2 << 20
SHOUT = re.compile(rb"[A-Z][A-Z]")


def _hashes(names: pa.Array, behind: bytes = b"") -> np.ndarray:
    names = [name + behind for name in names.to_numpy(zero_copy_only=False)]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)).view(np.int64)


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending, and how often each stands there. By sorting: the hash table of np.unique takes several times as long."""
    numbers = np.sort(numbers)
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[starts], np.diff(starts, append=len(numbers))


def _runs(joined: bytes, table: bytes, begins: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct runs of the bytes that the table does not make spaces of; places in these, and texts, of each text's distinct
    runs. begins has the places in joined where texts begin."""
    folded = joined.translate(table)
    inside = np.frombuffer(folded, np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    lengths = edges[1::2] - edges[::2]
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    runs = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(folded.translate(None, b" "))])
    known = runs.dictionary_encode()
    text = np.searchsorted(begins, edges[::2], "right") - 1
    width = max(len(known.dictionary), 1)
    pairs, _ = _distinct(text * width + known.indices.to_numpy())
    return known.dictionary, pairs % width, pairs // width


def text_views(texts: list[bytes | None]) -> list[np.ndarray]:
    """Per text, the hashes, ascending, of its distinct words, of its runs of signs as they stand at words, and of its stems (with
    a - behind; a second - if two or more words have the stem)."""
    n = len(texts)
    joined = b" ".join([text or b"" for text in texts])
    begins = np.r_[0, np.cumsum([len(text or b"") + 1 for text in texts])][:n]
    known, word, at = _runs(joined, FOLD, begins)
    stems = pc.binary_slice(known, 0, STEM).dictionary_encode()
    width = max(len(stems.dictionary), 1)
    pairs, times = _distinct(at * width + stems.indices.to_numpy()[word])
    several = pairs[times > 1]
    signs, sign, sign_at = _runs(joined, SIGNS, begins)
    parts = [
        (_hashes(known)[word], at), (_hashes(signs)[sign], sign_at),
        (_hashes(stems.dictionary, b"-")[pairs % width], pairs // width),
        (_hashes(stems.dictionary, b"--")[several % width], several // width),
    ]
    cuts = [np.searchsorted(rows, np.arange(n + 1)).tolist() for _, rows in parts]
    found = []
    for i in range(n):
        own = [values[cut[i] : cut[i + 1]] for (values, _), cut in zip(parts, cuts)]
        if len(own[0]) < 20:  # the absence of words says little here
            own.append(FEW.view(np.int64)[:1] if len(own[0]) >= 5 else FEW.view(np.int64)[1:])
            found.append(np.unique(np.concatenate(own)))  # few may be one of the words
        else:
            found.append(np.sort(np.concatenate(own)))
    return found


def metadata_view(text: bytes | None, lang: str | None, source: str | None) -> list[float]:
    text = text or b""
    without = lambda some: len(text) - len(text.translate(None, some))
    size, words, lines = len(text) - without(CONTINUED), len(text.split()), text.count(b"\n") + 1
    dense = [
        math.log1p(size), math.log1p(words), size / (words + 1), math.log1p(lines), size / lines / 1000,
        without(SYMBOLS) / (size + 1), 2 * len(SHOUT.findall(text)) / (size + 1), without(DIGITS) / (size + 1),
        float(words < 5), float(words < 20),
    ]
    slots = [0.0] * (2 * HASHED)
    slots[xxhash.xxh3_64_intdigest(lang or "") % HASHED] = 1.0
    slots[HASHED + xxhash.xxh3_64_intdigest(source or "") % HASHED] = 1.0
    return dense + slots


def logistic(features: np.ndarray, labels: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Weights, the last one the constant, by Newton's method."""
    x = np.c_[features, np.ones(len(features))]
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ weights)
        gradient = x.T @ (p - labels) + ridge * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        weights -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def standard(metadata: np.ndarray, center: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((metadata - center) / spread, -FAR, FAR)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Words:
    """Sparse rows of word numbers, as two flat arrays."""

    def __init__(self, word: np.ndarray, row: np.ndarray, length: int):
        self.word, self.row, self.length = word, row, length

    def take(self, chosen: np.ndarray) -> "Words":
        """The rows chosen, each once, in ascending order."""
        place = np.full(self.length, -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        at = place[self.row]
        return Words(self.word[at >= 0], at[at >= 0], len(chosen))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.word], self.length) + weights[-1]

    def fit(self, labels: np.ndarray, n_words: int, penalty: float = 1.0, steps: int = 150) -> np.ndarray:
        """Logistic regression by gradient steps with momentum, each word with its own step length."""
        weights, speed = np.zeros(n_words + 1), np.zeros(n_words + 1)
        scale = 4.0 / (np.r_[np.bincount(self.word, minlength=n_words), self.length] / 4 + penalty)
        for _ in range(steps):
            error = _sigmoid(self.scores(weights)) - labels
            gradient = np.r_[np.bincount(self.word, error[self.row], n_words) + penalty * weights[:-1], error.sum()]
            speed = 0.8 * speed - 0.05 * scale * gradient
            weights = weights + speed
        return weights


@dataclass
class Model:
    """One target: weights by word hash (ascending, the constant last), metadata weights and the combination of both scores."""

    names: np.ndarray
    weights: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    metadata: np.ndarray
    combined: np.ndarray

    @property
    def words(self) -> dict[int, float]:
        return dict(zip(self.names.view(np.uint64).tolist(), self.weights.tolist()))

    def chances(self, words: np.ndarray, row: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
        """Calibrated chance by text, by metadata, and by both, of every row; words come with the row that has them."""
        number, at = _numbers(words, row, self.names)
        text = np.bincount(at, self.weights[number], len(metadata)) + self.weights[-1]
        page = standard(metadata, self.center, self.spread) @ self.metadata[:-1] + self.metadata[-1]
        both = np.clip(np.c_[text, page, np.ones(len(metadata))], -20, 20) @ self.combined
        return [_sigmoid(text), _sigmoid(page), _sigmoid(both)]


TARGETS = ("low", "toxic")


@dataclass
class View:
    """What tasks need of one target: sorted word hashes, both views' weights (constant last) and their calibration."""

    names: np.ndarray
    text: np.ndarray
    page: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    text_scale: np.ndarray
    page_scale: np.ndarray


class Learner:
    """The labelled rows of one target on the driver, and its two views."""

    def __init__(self, metadata: np.ndarray, labels: np.ndarray):
        known = np.flatnonzero(labels >= 0)
        self.labels, self.held = labels, known[::5]
        self.learned = np.setdiff1d(known, self.held)
        self.usable = len(set(labels[self.held])) == 2 and len(set(labels[self.learned])) == 2
        if self.usable:
            self.center, self.spread = metadata[known].mean(0), metadata[known].std(0) + 1e-6
            self.page = np.c_[standard(metadata, self.center, self.spread), np.ones(len(metadata))]
            self.page_weights = logistic(self.page[self.learned, :-1], labels[self.learned], 1.0)
            self.names, self.text_weights = np.empty(0, np.int64), np.zeros(1)

    def own(self) -> np.ndarray:
        """Labels of the rows to learn from, -1 elsewhere."""
        own = np.full(len(self.labels), -1)
        own[self.learned] = self.labels[self.learned]
        return own

    def take_words(self, names: np.ndarray, rows: Words) -> None:
        """Go over to another word list; rows are the numbers in it of the labelled rows' words."""
        weights = np.zeros(len(names) + 1)
        weights[-1] = self.text_weights[-1]
        weights[np.searchsorted(names, self.names)] = self.text_weights[:-1]
        self.names, self.text_weights, self.rows = names, weights, rows
        self.own_rows = self.rows.take(self.learned)

    def calibrated(self) -> View:
        scale = lambda scores: logistic(scores[self.held, None], self.labels[self.held], 1e-3)
        return View(
            self.names, self.text_weights, self.page_weights, self.center, self.spread,
            scale(self.rows.scores(self.text_weights)), scale(self.page @ self.page_weights),
        )

    def begin(self, counts: np.ndarray, n_text: int, n_page: int) -> None:
        """Rows of the exchange weigh at most as much, taken together, as the labelled rows."""
        self.text_share, self.page_share = (min(1.0, len(self.learned) / max(n, 1)) for n in (n_text, n_page))
        own = np.r_[np.bincount(self.own_rows.word, minlength=len(self.names)), len(self.learned)]
        self.scale = 4.0 / ((own + self.text_share * counts) / 4 + 1.0)
        self.speed = np.zeros(len(self.names) + 1)

    def step(self, text: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> None:
        """One step of each view by the sums over the exchange and over the labelled rows."""
        y = self.labels[self.learned]
        error = _sigmoid(self.own_rows.scores(self.text_weights)) - y
        own = np.r_[np.bincount(self.own_rows.word, error[self.own_rows.row], len(self.names)) + self.text_weights[:-1], error.sum()]
        self.speed = 0.8 * self.speed - 0.05 * self.scale * (own + self.text_share * text)
        self.text_weights = self.text_weights + self.speed
        x = self.page[self.learned]
        p = _sigmoid(x @ self.page_weights)
        ridge = np.r_[np.ones(x.shape[1] - 1), 1e-6]
        gradient = x.T @ (p - y) + self.page_share * gradient + ridge * self.page_weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + self.page_share * curve + np.diag(ridge)
        self.page_weights = self.page_weights - np.clip(np.linalg.solve(curve, gradient), -5, 5)

    def model(self) -> Model:
        both = np.c_[self.rows.scores(self.text_weights), self.page @ self.page_weights]
        combined = logistic(np.clip(both[self.held], -20, 20), self.labels[self.held], 1e-2)
        return Model(self.names, self.text_weights, self.center, self.spread, self.page_weights, combined)


NO_WORDS = np.empty(0, np.int64)


def batch_views(batch: pa.RecordBatch, text: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Both views of every row: ascending hashes of its words, and its metadata."""
    texts = batch.column(text).cast(pa.binary()).to_pylist()
    lang, source = (batch.column(c).to_pylist() if c in batch.schema.names else [None] * len(texts) for c in ("lang", "source"))
    found, dense = [], np.empty((len(texts), 10 + 2 * HASHED))
    start, size = 0, 0
    for i, value in enumerate(texts):
        dense[i] = metadata_view(value, lang[i], source[i])
        size += len(value or b"")
        if size >= MOST_TOGETHER or i == len(texts) - 1:
            found += text_views(texts[start : i + 1])
            start, size = i + 1, 0
    return found, dense


def stored_views(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """Stored: (key, sampled, low, toxic, words, metadata) of every row of docs. At most MAX_LABELLED keys are sampled; the
    labels of all other rows are -1."""
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("key"), "key").limit(MAX_LABELLED).select(
        "key", F.lit(True).alias("sampled"), F.when(F.col("quality") >= 0, (F.col("quality") == 0).cast("int")).alias("low"),
        F.when(F.col("toxic") >= 0, F.least(F.col("toxic").cast("int"), F.lit(1))).alias("toxic"),
    )
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")))
    rows = rows.join(F.broadcast(sample), "key", "left").select(
        "key", F.coalesce("sampled", F.lit(False)).alias("sampled"), *(F.coalesce(t, F.lit(-1)).alias(t) for t in TARGETS), "text", "lang", "source"
    )

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, dense = batch_views(batch, "text")
            ends = np.r_[0, np.cumsum([len(x) for x in found])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, NO_WORDS])))
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(dense) + 1) * dense.shape[1], pa.int32()), pa.array(dense.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in same), lists, wide], [*same, "words", "metadata"])

    same = ["key", "sampled", *TARGETS]
    schema = f"key {rows.schema['key'].dataType.simpleString()}, sampled boolean, low int, toxic int, words array<bigint>, metadata array<double>"
    # Most words are in many documents: numbers in a dictionary take a fraction of their hashes.
    return materialize(rows.mapInArrow(views, schema), "views", compression="zstd", **{"parquet.dictionary.page.size": 8 << 20})


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists, and the row of each."""
    lengths = column.value_lengths().to_numpy()
    return column.flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths)


def _dense(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 10 + 2 * HASHED))


LEADING = 18


def _numbers(words: np.ndarray, row: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in names (ascending hashes) of the words that stand there, and their rows. Hashes are looked up by their
    leading bits; the few names that agree in these stand side by side."""
    if not len(names):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift = np.uint64(64 - LEADING)
    lead = (names.view(np.uint64) >> shift).astype(np.int64)
    first, count = np.zeros(1 << LEADING, np.int32), np.bincount(lead, minlength=1 << LEADING)
    first[lead[::-1]] = np.arange(len(names) - 1, -1, -1)
    lead = (words.view(np.uint64) >> shift).view(np.int64)
    at = first[lead]
    hit = names[at] == words
    for further in range(1, count.max()):
        more = np.flatnonzero(~hit & (count[lead] > further))
        at[more] += 1
        hit[more] = names[at[more]] == words[more]
    return at[hit].astype(np.int64), row[hit]


def _rows_of(number: np.ndarray, row: np.ndarray, count: int) -> pa.ListArray:
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=count))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number, pa.int32()))


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    """Rows of numbers as bytes: Spark hands a row on as one value instead of one by one."""
    ends = np.r_[0, np.cumsum(lengths * values.itemsize)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.BinaryArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and the row of each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(column.buffers()[2] or b"", kind, (ends[-1] - ends[0]) // size, ends[0])
    return values, np.repeat(np.arange(len(column)), np.diff(ends) // size)


def exchanged(views: dict[str, View]):
    """From batches of stored views to (words, metadata, text_*, page_*) of the rows that a view is sure of: text_* are labels
    by the page view, for the text view, and the other way round; -1 where the view is not sure or a label is given.
    It runs in the worker of the step that follows."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            (words, row), metadata = _lists(batch.column("words")), _dense(batch.column("metadata"))
            labels = []
            for target in TARGETS:
                found = [np.full(n, -1, np.int32), np.full(n, -1, np.int32)]
                if target in views:
                    view, free = views[target], batch.column(target).to_numpy() < 0
                    page = np.c_[standard(metadata, view.center, view.spread), np.ones(n)] @ view.page
                    number, at = _numbers(words, row, view.names)
                    text = np.bincount(at, view.text[number], n) + view.text[-1]
                    for labelled, scores, scale in zip(found, (page, text), (view.page_scale, view.text_scale)):
                        chance = _sigmoid(scores * scale[0] + scale[1])
                        labelled[free & (chance >= SURE)] = 1
                        labelled[free & (1 - chance >= SURE)] = 0
                labels += found
            names = ["words", "metadata", *(f"{v}_{t}" for t in TARGETS for v in ("text", "page"))]
            out = pa.record_batch([batch.column("words"), batch.column("metadata"), *map(pa.array, labels)], names)
            yield out.filter(pa.array(np.max(labels, axis=0) >= 0))

    return judge


def word_counts(own: DataFrame, free: DataFrame | None = None, judge=None) -> DataFrame:
    """Stored: (word, seen_*, bad_*), the number of rows with a text_* label, in own and in what judge makes of free, and of those
    labelled 1 that have the word. The row without a word has the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, row = _lists(batch.column("words"))
            known = pa.array(words).dictionary_encode()
            words, place = known.dictionary.to_numpy(), known.indices.to_numpy()
            counts = []
            for target in TARGETS:
                label = batch.column(f"text_{target}").to_numpy()
                for chosen in (label >= 0, label == 1):
                    counts.append(np.r_[np.bincount(place[chosen[row]], minlength=len(words)), chosen.sum()].astype(np.int64))
            seen = pa.array(np.max(counts, axis=0) > 0)
            column = pa.array(np.r_[words, 0], pa.int64(), mask=np.r_[np.zeros(len(words), bool), True])
            yield pa.record_batch([column, *map(pa.array, counts)], ["word", *names]).filter(seen)

    names = [f"{kind}_{t}" for t in TARGETS for kind in ("seen", "bad")]
    schema = "word bigint, " + ", ".join(f"{name} bigint" for name in names)
    counted = own.mapInArrow(count, schema)
    if free is not None:
        counted = counted.unionByName(free.mapInArrow(lambda batches: count(judge(batches)), schema))
    return materialize(few_dealt(counted.groupBy("word").agg(*(F.sum(name).alias(name) for name in names))), "words")


def chosen_words(counts: DataFrame, target: str) -> np.ndarray:
    """Hashes, ascending, of the words whose document frequency differs most between the classes."""
    total = counts.where("word is null").select(f"seen_{target}", f"bad_{target}").first()
    n, n_bad = total or (0, 0)
    if not 0 < n_bad < n:
        return np.empty(0, np.int64)
    seen, bad = F.col(f"seen_{target}"), F.col(f"bad_{target}")
    error = F.sqrt(seen / n * (1 - seen / n) * (1 / n_bad + 1 / (n - n_bad)) + 1e-12)
    z = F.abs(bad / n_bad - (seen - bad) / (n - n_bad)) / error
    words = counts.where(F.col("word").isNotNull() & (seen > 0)).select("word", seen.alias("seen"), z.alias("z"))
    few = F.col("word").isin(FEW.view(np.int64).tolist())
    best = words.where(((F.col("seen") >= 4) & (F.col("z") >= LEAST_Z)) | few).orderBy(F.desc("z"), "word").limit(MAX_WORDS)
    return np.sort(np.array([r.word for r in best.collect()], np.int64))


def labelled_numbers(labelled: DataFrame, lists: dict[str, np.ndarray]) -> dict[str, Words]:
    """Per target: the numbers, in its word list, of the words of each labelled row, rows in order of their keys."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_rows_of(*_numbers(*_lists(batch.column("words")), names), batch.num_rows) for names in lists.values()]
            yield pa.record_batch([batch.column("key"), *found], ["key", *lists])

    kind = labelled.schema["key"].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{t} array<int>" for t in lists)
    found = labelled.select("key", "words").mapInArrow(number, schema).toArrow().sort_by("key")
    return {t: Words(*_lists(found[t].combine_chunks()), found.num_rows) for t in lists}


def numbered(free: DataFrame, judge, lists: dict[str, np.ndarray]) -> DataFrame:
    """Stored: the exchange, what judge makes of free, with numbers in the targets' word lists in place of words."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in judge(batches):
            words, row = _lists(batch.column("words"))
            found = []
            for target, names in lists.items():
                known = batch.column(f"text_{target}").to_numpy()[row] >= 0
                numbers, at = _numbers(words[known], row[known], names)
                found.append(_packed(numbers.astype(np.int32), np.bincount(at, minlength=batch.num_rows)))
            dense = _dense(batch.column("metadata"))
            found.append(_packed(dense.ravel(), np.full(len(dense), dense.shape[1])))
            yield pa.record_batch([*found, *batch.columns[2:]], [*lists, *batch.schema.names[1:]])

    labels = [f"{v}_{t} int" for t in TARGETS for v in ("text", "page")]
    rows = free.mapInArrow(number, ", ".join([*(f"{t} binary" for t in lists), "metadata binary", *labels]))
    return materialize(rows, "exchange", compression="zstd")


def gradient_sums(exchange: DataFrame, views: dict[str, View], counts: bool = False) -> dict[str, tuple[np.ndarray, ...]]:
    """Per target, summed over the exchange: gradient of the text weights, gradient and curvature of the page weights. With
    counts: rows with each word and all rows of the text view, in place of the first; rows of the page view last in the second."""
    wide = 11 + 2 * HASHED
    sizes = {t: (len(view.names) + 1, wide, wide * wide) for t, view in views.items()}
    total = sum(map(sum, sizes.values()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total)
        for batch in slices(batches):
            n, at = batch.num_rows, 0
            metadata = _unpacked(batch.column("metadata"), np.float64)[0].reshape(n, -1)
            for target, view in views.items():
                (number, row), label = _unpacked(batch.column(target), np.int32), batch.column(f"text_{target}").to_numpy()
                if counts:
                    error = np.ones(n)
                else:  # whole numbers: their sum is the same in any order
                    scores = np.bincount(row, view.text[number], n) + view.text[-1]
                    error = np.rint((_sigmoid(scores) - label) * 2**20)
                error[label < 0] = 0
                label = batch.column(f"page_{target}").to_numpy()
                x, y = np.c_[standard(metadata, view.center, view.spread), np.ones(n)][label >= 0], label[label >= 0]
                p = _sigmoid(x @ view.page)
                slope = x.T @ (np.ones(len(y)) if counts else p - y)
                parts = (np.r_[np.bincount(number, error[row], len(view.names)), error.sum()], slope, ((x * (p * (1 - p))[:, None]).T @ x).ravel())
                for part in parts:
                    sums[at : at + len(part)] += part
                    at += len(part)
        slots = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(slots, pa.int32()), pa.array(sums[slots])], ["slot", "value"])

    found = exchange.mapInArrow(add, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros(total)
    sums[found["slot"].to_numpy()] = found["value"].to_numpy()
    out, at = {}, 0
    for target, (text, page, curve) in sizes.items():
        unit = 1.0 if counts else 2.0**-20
        out[target] = (sums[at : at + text] * unit, sums[at + text : at + text + page], sums[at + text + page : at + text + page + curve].reshape(page, page))
        at += text + page + curve
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, Model | None]:
    """Models of low quality and of toxicity from labels (key, quality, toxic)."""
    views = stored_views(docs, labels, key, text)
    models = fit_views(views)
    discard(views)
    return models


def fit_views(rows: DataFrame) -> dict[str, Model | None]:
    """As fit, from stored views."""
    # At most one row of a labelled key: repeated rows would count twice.
    labelled = materialize(few(rows.where("sampled").dropDuplicates(["key"])), "labelled")
    known = labelled.select("key", "metadata", *TARGETS).toArrow().sort_by("key")
    metadata = _dense(known["metadata"].combine_chunks())
    learners = {t: Learner(metadata, known[t].to_numpy()) for t in TARGETS}
    learned = {t: learner for t, learner in learners.items() if learner.usable}
    models: dict[str, Model | None] = dict.fromkeys(TARGETS)
    if not learned:
        discard(labelled)
        return models
    own = rows.sparkSession.createDataFrame(
        pa.table({"key": known["key"], **{f"text_{t}": pa.array(learners[t].own(), pa.int32()) for t in TARGETS}})
    )
    own_words = materialize(few(labelled.select("key", "words").join(F.broadcast(own), "key").select("words", *(f"text_{t}" for t in TARGETS))), "own")
    counts = word_counts(own_words)
    first = {t: chosen_words(counts, t) for t in learned}
    discard(counts)
    found = labelled_numbers(labelled, first)
    for t, learner in learned.items():
        learner.take_words(first[t], found[t])
        learner.text_weights = learner.own_rows.fit(learner.labels[learner.learned], len(first[t]))
    free = gather(rows.where("low < 0 or toxic < 0"))
    for _ in range(ROUNDS):
        judge = exchanged({t: learner.calibrated() for t, learner in learned.items()})
        counts = word_counts(own_words, free, judge)
        lists = {t: np.union1d(first[t], chosen_words(counts, t)) for t in learned}
        stored = numbered(free, judge, lists)
        found = labelled_numbers(labelled, lists)
        for t, learner in learned.items():
            # Words of an earlier round that are not chosen again leave the list.
            stay = np.isin(learner.names, lists[t])
            learner.names, learner.text_weights = learner.names[stay], np.r_[learner.text_weights[:-1][stay], learner.text_weights[-1]]
            learner.take_words(lists[t], found[t])
        for turn in range(STEPS + 1):
            sums = gradient_sums(stored, {t: learner.calibrated() for t, learner in learned.items()}, counts=turn == 0)
            for t, learner in learned.items():
                if turn == 0:
                    learner.begin(sums[t][0], int(sums[t][0][-1]), int(sums[t][1][-1]))
                else:
                    learner.step(*sums[t])
        discard(stored, counts)
    discard(labelled, own_words)
    return models | {t: learner.model() for t, learner in learned.items()}


NEW = ("p_low_text", "p_low_page", "p_low", "p_toxic_text", "p_toxic_page", "p_toxic")


def score(docs: DataFrame, models: dict, text: str = "text", only_kept: bool = False, low: float = 0.7, toxic: float = 0.5) -> DataFrame:
    """docs with the chances of low quality and toxicity by each view and by both, and kept (both below their limit). With only_kept,
    the rows kept, with the columns of docs alone.

    Null and empty texts are scored like others, as texts without words. A target without a model has chance 0. Columns of docs that bear a new name
    are replaced; missing lang or source columns count as null."""
    docs = docs if only_kept else docs.drop(*NEW, "kept")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, metadata = batch_views(batch, text)
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            chances = all_chances(models, np.concatenate([*found, NO_WORDS]), row, metadata)
            kept = pa.array((chances[2] < low) & (chances[5] < toxic))
            if only_kept:
                yield batch.filter(kept)
            else:
                yield pa.record_batch([*batch.columns, *map(pa.array, chances), kept], [*batch.schema.names, *NEW, "kept"])

    schema = StructType([*docs.schema])
    for name in () if only_kept else NEW:
        schema = schema.add(name, "double")
    return docs.mapInArrow(judge, schema if only_kept else schema.add("kept", "boolean"))


def all_chances(models: dict, words: np.ndarray, row: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
    """The columns of NEW."""
    none = [np.zeros(len(metadata))] * 3
    found = [models[t].chances(words, row, metadata) if models[t] else none for t in TARGETS]
    return [column.round(6) for columns in found for column in columns]


def score_views(rows: DataFrame, models: dict, low: float = 0.7, toxic: float = 0.5) -> DataFrame:
    """(key, chances, kept) of every row of stored views, without going back to the texts."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            chances = all_chances(models, *_lists(batch.column("words")), _dense(batch.column("metadata")))
            kept = pa.array((chances[2] < low) & (chances[5] < toxic))
            yield pa.record_batch([batch.column("key"), *map(pa.array, chances), kept], ["key", *NEW, "kept"])

    schema = StructType([rows.schema["key"]])
    for name in NEW:
        schema = schema.add(name, "double")
    return rows.select("key", "words", "metadata").mapInArrow(judge, schema.add("kept", "boolean"))
