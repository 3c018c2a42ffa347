"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton reads tokens. It begins as one state with a loop for each byte, which accepts every spelling of every text.
Each merge (u, v), in order of rank, then applies one gadget: the state behind u loses its arc v (a state that other
labels share is copied first), and wherever u can be read, the new label uv can be read as well and leads to where v
led. What is accepted after the last merge is, for every text, its one encoding.

States are never copied arc by arc. A copy keeps its origin and the time of the copy, a label keeps its left part and the
time of its merge, and an arc is there if none of the losses on those two lines came too early. Arcs that a text asks
for are entered in a transition table, so encoding is table look-ups."""

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from letterlens.llm.words import slices

WORD_CACHE = 300_000
LONGEST_CACHED = 32
ARC_CACHE = 2_000_000
# Fixed rule of byte-level vocabularies: printable bytes are letters of their own, the rest follow from 256 on.
_UNPRINTABLE = [*range(33), *range(127, 161), 173]
LETTER_BYTES = {chr(b): b for b in range(256) if b not in _UNPRINTABLE} | {chr(256 + i): b for i, b in enumerate(_UNPRINTABLE)}
# Letters and numbers as in any version of Unicode. Beyond this range versions differ, and the tokenizer's own splitter
# is asked.
SETTLED = [*range(0x530), *range(0x2000, 0x2065)]
UNSETTLED = re.compile(r"[^\x00-\u052f\u2000-\u2064]")
_SPACE = r"\x09-\x0d\x20\x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f"
_LETTER, _NUMBER = (
    "".join(re.escape(chr(c)) for c in SETTLED if unicodedata.category(chr(c))[0] == kind) for kind in "LN"
)
# Fixed pattern of byte-level pre-tokenizers.
WORDS = re.compile(
    f" ?[{_LETTER}]+| ?[{_NUMBER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


class Automaton:
    """Arcs over labels (token ids). `target[label]` is the state behind a label; state 0 is the start and loses nothing."""

    def __init__(self, spelled: list[bytes], merges: list[tuple[int, int, int]]):
        """spelled: the bytes of each id. merges: (left id, right id, id of the joined label) by rank."""
        self.spelled = spelled
        joined = {label for _, _, label in merges}
        self.left, self.born = list(range(len(spelled))), [0] * len(spelled)
        self.target = [-1] * len(spelled)  # no arc
        self.origin, self.copied, self.lost = [-1, -1], [0, 0], [{}, {}]
        self.sharers = [1, 0]
        for label, letters in enumerate(spelled):
            if len(letters) == 1 and label not in joined:
                self.target[label] = 1
                self.sharers[1] += 1
        for time, (u, v, label) in enumerate(merges, 1):
            self._gadget(time, u, v, label)
        self.arcs: dict[int, bool] = {}
        self.size = len(spelled)
        self.children: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for label, letters in enumerate(spelled):
            if self.target[label] >= 0:
                self._spell(label, letters)

    def _gadget(self, time: int, u: int, v: int, label: int) -> None:
        before = self.target[u]
        if before < 0 or self.target[v] < 0 or not self._has(before, v, time):
            return  # u and v never meet, so the merge never applies
        behind = self.target[v]
        if self.sharers[before] > 1 or u == v:  # if u and v are one label, the joined one goes on from the state as it was
            self.sharers[before] -= 1
            self.origin.append(before)
            self.copied.append(time)
            self.lost.append({})
            self.sharers.append(1)
            self.target[u] = len(self.origin) - 1
        self.lost[self.target[u]][v] = time
        self.left[label], self.born[label], self.target[label] = u, time, behind
        self.sharers[behind] += 1

    def _has(self, state: int, label: int, time: int) -> bool:
        """Whether the arc is there before the merge of this time."""
        while state > 0:
            lost, part, until = self.lost[state], label, time
            while lost:
                at = lost.get(part)
                # A label takes over the arcs of its left part as they are once its own merge has cost an arc.
                if at is not None and (at < until if part == label else at <= until):
                    return False
                if self.left[part] == part:
                    break
                until, part = min(until, self.born[part]), self.left[part]
            time, state = min(time, self.copied[state]), self.origin[state]
        return True

    def arc(self, state: int, label: int) -> bool:
        key = state * self.size + label
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= ARC_CACHE:
                self.arcs.clear()
            found = self.arcs[key] = self._has(state, label, 1 << 62)
        return found

    def _spell(self, label: int, letters: bytes) -> None:
        node = 0
        for byte in letters:
            step = node << 8 | byte
            node = self.children.get(step, 0)
            if not node:
                node = self.children[step] = len(self.ends)
                self.ends.append(-1)
        self.ends[node] = label

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one accepted path that spells the word.

        Tries the longest label first. Every opening of the word has one accepted path only, so a place from which the
        end can't be reached is never tried again."""
        n, children, ends, target = len(word), self.children, self.ends, self.target
        arcs, size, arc = self.arcs, self.size, self.arc
        path: list[int] = []
        rest: list[list[int]] = []  # at each place of the path, shorter labels still to try
        here, at, dead = 0, 0, set()
        while at < n:
            node, place, fitting = 0, at, []
            while place < n:
                node = children.get(node << 8 | word[place])
                if node is None:
                    break
                place += 1
                label = ends[node]
                if label >= 0:
                    fitting.append(label)
            while True:
                while fitting:
                    label = fitting.pop()
                    place = at + len(self.spelled[label])
                    if place in dead:
                        continue
                    found = arcs.get(here * size + label)
                    if found or found is None and arc(here, label):
                        break
                else:
                    dead.add(at)
                    label = path.pop()
                    at -= len(self.spelled[label])
                    here = target[path[-1]] if path else 0
                    fitting = rest.pop()
                    continue
                break
            path.append(label)
            rest.append(fitting)
            here, at = target[label], place
        return path


class Encoder(dict):
    """Ids of each pre-split word; words seen lately are kept up to a bound. Special tokens stand for themselves."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        check(spec)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        vocabulary = spec["model"]["vocab"]
        special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.labels = [b""] * (1 + max(chain(vocabulary.values(), special.values())))
        for token, i in vocabulary.items():
            if token not in special:
                self.labels[i] = bytes(LETTER_BYTES[letter] for letter in token)
        pairs = (merge if isinstance(merge, list) else merge.split(" ") for merge in spec["model"]["merges"])
        self.automaton = Automaton(list(self.labels), [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs])
        for token, i in special.items():
            self.labels[i] = token.encode()
        self.special = {token: (i,) for token, i in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.automaton.encode(word.encode()))
        if len(word) <= LONGEST_CACHED:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = found
        return found

    def words(self, text: str) -> list[str]:
        if UNSETTLED.search(text):
            return [text[start:end] for _, (start, end) in self.splitter.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.specials is None or not self.specials.search(text):
            return list(chain.from_iterable(map(self.__getitem__, self.words(text))))
        ids: list[int] = []
        for part in self.specials.split(text):
            ids += self.special[part] if part in self.special else chain.from_iterable(map(self.__getitem__, self.words(part)))
        return ids

    def decode(self, ids: list[int] | None) -> str:
        """The labels of the arcs, joined. Bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.labels.__getitem__, ids or ())).decode("utf-8", "replace")


def check(spec: dict) -> None:
    """Only byte-level vocabularies of plain merges are understood; anything else is refused rather than encoded wrongly."""
    model, splitter = spec["model"], spec["pre_tokenizer"] or {}
    odd = [name for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(name)]
    odd += [name for name in ("byte_fallback", "ignore_merges") if model.get(name)]
    odd += [name for name in ("normalizer", "post_processor") if spec.get(name)]
    odd += [t["content"] for t in spec["added_tokens"] if not t["special"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
    if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        odd.append("pre_tokenizer")
    if model["type"] != "BPE" or (spec["decoder"] or {}).get("type") != "ByteLevel" or odd:
        raise ValueError(f"not a plain byte-level vocabulary: {odd}")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """Compiled once in each worker."""
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", decode_too: bool = False) -> DataFrame:
    """docs with `ids` (array of int) in place of the text column, and `decoded` if asked for: the text spelled by the ids.

    Whole texts are encoded in their own partition, without a shuffle; equal ids as from the tokenizers library without
    added special tokens, unused truncation and padding. A special token written in a text becomes its id. Null and empty
    texts have no ids and decode to the empty text. Rows that repeat are encoded each; columns of docs named `ids` or
    `decoded` are replaced, all others are kept."""
    new = ["ids", "decoded"] if decode_too else ["ids"]
    kept = docs.drop(*new) if text not in new else docs
    others = [name for name in kept.columns if name != text]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in slices(batches):
            rows = [tool.encode(value) for value in batch.column(text).to_pylist()]
            columns = [pa.array(rows, pa.list_(pa.int32()))]
            if decode_too:
                columns.append(pa.array(map(tool.decode, rows), pa.string()))
            yield pa.record_batch([*(batch.column(name) for name in others), *columns], [*others, *new])

    schema = docs.select(*(F.col(f"`{name}`") for name in others)).schema.add("ids", ArrayType(IntegerType()))
    return kept.mapInArrow(encoded, schema.add("decoded", "string") if decode_too else schema)


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """tokens with the text spelled by the ids as a further column. Null and empty arrays give the empty text; ids cut in
    the middle of a character give replacement characters, as in the library."""
    kept = tokens.drop(name)
    names = kept.columns

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in slices(batches):
            texts = pa.array(map(tool.decode, batch.column(ids).to_pylist()), pa.string())
            yield pa.record_batch([*batch.columns, texts], [*names, name])

    return kept.mapInArrow(decoded, StructType([*kept.schema, StructField(name, StringType())]))
