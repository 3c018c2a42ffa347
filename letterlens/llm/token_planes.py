"""Token ids in bit planes: fixed-size blocks of ids are transposed to one bit plane per binary digit, each plane is
compressed by itself, and the rows carry a chunk index.

A file is a Parquet folder with one row per chunk of 65,536 ids. Its columns `part`, `chunk`, `start`, `n_ids` and
`pieces` are the index (read without the payload), `planes` is the payload. A plane is the zstandard frame of one bit of
every id, eight ids to a byte, the first id in the highest bit; plane i holds bit i. Chunks of a part are full but for
the last one, so the chunk of any id is found by division."""

import codecs
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from letterlens.llm.words import slices

CHUNK = 1 << 16
WORD_CACHE = 400_000
SMALL = rb"[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]"
SIGNS = rb"[!-&(-/:-@\[-`{-~]+"
SIGNS_BEHIND = re.compile(rb"((?:" + SMALL + rb")+)(" + SIGNS + rb")")
SIMPLE = re.compile(rb"(?:" + SMALL + rb")+|" + SIGNS)
SIGN_BYTES = re.sub(rb"[^!-&(-/:-@\[-`{-~]", b"", bytes(range(128)))
# Fixed rule of byte-level vocabularies: printable bytes are letters of their own, the rest follow from 256 on.
_UNPRINTABLE = [*range(33), *range(127, 161), 173]
BYTE_LETTERS = {byte: 256 + i for i, byte in enumerate(_UNPRINTABLE)}
LETTER_OF_BYTE = bytes(range(256)).decode("latin-1").translate(BYTE_LETTERS)
PIECE = "struct<doc_id: bigint, ordinal: bigint, piece: int, n: int>"
PIECE_ARROW = pa.list_(
    pa.struct([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("piece", pa.int32()), ("n", pa.int32())])
)


class WordEncoder(dict):
    """Ids of whole texts. No token of this kind of vocabulary spans ASCII white space, so a text is encoded by the
    stretches between; the library sees a stretch once as long as it stays in this bounded cache. Two steps make
    stretches repeat more often and change no token: A-Z are lowered (the vocabulary knows no capitals), and signs behind
    letters, which are a token of their own, are looked up by themselves."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = "<u2" if self.code == "H" else "<u4"

    def __missing__(self, part: bytes) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        if part.isalpha():  # a-z, by far the most; the cases below hold for them too and take longer
            ids = [token.id for token in self.model.tokenize(part.lower().decode())]
            found = self[part] = array(self.code, ids).tobytes()
            return found
        letters = part.rstrip(SIGN_BYTES)
        if letters.isalpha():
            found = self[part] = self[letters] + self[part[len(letters):]]
            return found
        small = part if part.isascii() else part.decode().lower().encode()
        if SIMPLE.fullmatch(small):  # one token of the pre-tokenizer as it stands
            ids = [token.id for token in self.model.tokenize(codecs.charmap_decode(small, "strict", LETTER_OF_BYTE)[0])]
        elif match := SIGNS_BEHIND.fullmatch(small):
            found = self[part] = self[match[1]] + self[match[2]]
            return found
        else:
            ids = self.tokenizer.encode(part.decode(), add_special_tokens=False).ids
        found = self[part] = array(self.code, ids).tobytes()
        return found

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        return (b"".join(map(self.__getitem__, stretches(text))) for text in texts)


def stretches(text: bytes | None) -> list[bytes]:
    if not text:
        return []
    # A special token keeps its case; a combining mark may join a capital and not the small letter, or the other way.
    if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
        return text.split()
    return text.lower().split()


def to_planes(ids: np.ndarray) -> list[bytes]:
    compress = zstandard.ZstdCompressor(level=3).compress
    highest = int(ids.max()).bit_length() if len(ids) else 0
    return [compress(np.packbits(((ids >> bit) & 1).astype(np.uint8)).tobytes()) for bit in range(highest)]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    ids = np.zeros(n_ids, np.uint32)
    decompress = zstandard.ZstdDecompressor().decompress
    for bit, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(decompress(plane), np.uint8), count=n_ids).astype(np.uint32) << np.uint32(bit)
    return ids


class _Chunker:
    """Cuts a stream of documents into chunks of CHUNK ids."""

    def __init__(self, part: int, width: str):
        self.part, self.width = part, width
        self.chunk, self.held, self.pieces, self.buffer = 0, 0, [], []

    def add(self, doc_id: int | None, ordinal: int, ids: np.ndarray) -> Iterator[dict]:
        piece = at = 0
        while at < len(ids):
            taken = min(len(ids) - at, CHUNK - self.held)
            self.buffer.append(ids[at : at + taken])
            self.pieces.append({"doc_id": doc_id, "ordinal": ordinal, "piece": piece, "n": taken})
            at, piece, self.held = at + taken, piece + 1, self.held + taken
            if self.held == CHUNK:
                yield self.flush()

    def flush(self) -> dict:
        ids = np.concatenate(self.buffer)
        row = {
            "part": self.part, "chunk": self.chunk, "start": self.chunk * CHUNK, "n_ids": len(ids),
            "pieces": self.pieces, "planes": to_planes(ids),
        }
        self.chunk, self.held, self.pieces, self.buffer = self.chunk + 1, 0, [], []
        return row


SCHEMA = f"part int, chunk int, start bigint, n_ids int, pieces array<{PIECE}>, planes array<binary>"
SCHEMA_ARROW = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int32()), ("pieces", PIECE_ARROW),
    ("planes", pa.list_(pa.binary())),
])


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", order: Sequence[Column | str] | None = None,
) -> None:
    """Encode whole texts and write them in ascending order of the key, nulls first, or of the columns in `order`; rows that
    are equal there follow by the hash of their text. Each document ends with end_id; null and empty texts are that id alone. Extra columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        end = np.array([end_id], encoder.width).tobytes()
        chunker = _Chunker(TaskContext.get().partitionId(), encoder.width)
        ordinal = 0
        for batch in slices(batches):
            rows, keys = [], batch.column(0).to_pylist()
            for doc_id, ids in zip(keys, encoder.encode(batch.column(1).cast(pa.binary()).to_pylist())):
                rows += chunker.add(doc_id, ordinal, np.frombuffer(ids + end, encoder.width))
                ordinal += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA_ARROW)
        if chunker.held:
            yield pa.RecordBatch.from_pylist([chunker.flush()], SCHEMA_ARROW)

    places = {f"place{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order or [F.col(key).cast("long")])}
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *(c.alias(name) for name, c in places.items())
    ).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*places, "tie").sortWithinPartitions(*places, "tie")
    ordered.select("key", "text").mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)


def part_starts(index: DataFrame) -> DataFrame:
    """(part, base): ids in all parts before. One row per written part."""
    totals = index.groupBy("part").agg(F.max(F.col("start") + F.col("n_ids")).alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))


def read_pieces(spark: SparkSession, path: str, of_ids: str, kind: str, arrow_kind: pa.DataType, value) -> DataFrame:
    """(part, ordinal, piece, doc_id, start, n, <of_ids>): one row for each stretch of a document within a chunk, with
    value(ids of the stretch)."""
    schema = pa.schema([
        ("part", pa.int32()), ("ordinal", pa.int64()), ("piece", pa.int32()), ("doc_id", pa.int64()),
        ("start", pa.int64()), ("n", pa.int64()), (of_ids, arrow_kind),
    ])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, n_ids, planes = (batch.column(c)[i].as_py() for c in ("part", "start", "n_ids", "planes"))
                ids, pieces = from_planes(planes, n_ids), batch.column("pieces").slice(i, 1).flatten()
                n = pieces.field("n").to_numpy().astype(np.int64)
                ends = np.cumsum(n)
                values = [value(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                same = pa.array(np.full(len(n), part, np.int32))
                columns = [same, *(pieces.field(c) for c in ("ordinal", "piece", "doc_id")), *map(pa.array, (start + ends - n, n))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, arrow_kind)], schema=schema)

    return spark.read.parquet(path).mapInArrow(
        decode, f"part int, ordinal long, piece int, doc_id long, start long, n long, {of_ids} {kind}"
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, in whole."""
    pieces = read_pieces(spark, path, "ids", "array<int>", pa.list_(pa.int32()), lambda ids: ids.astype(np.int32))
    whole = pieces.groupBy("part", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"),
        F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("pieces"),
    )
    return whole.join(part_starts(spark.read.parquet(path)), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), F.flatten("pieces.ids").alias("ids")
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files. The checksums of the stretches of a document
    are combined, so its ids are never gathered in one place."""
    pieces = read_pieces(spark, path, "crc", "long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4", copy=False)))
    whole = pieces.groupBy("part", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("pieces"),
    )
    # Only a document on a border of chunks has more than one stretch, and only those pass through Python.
    joined = F.udf(lambda pieces: pieces and crc32_of_joined([(p["n"] * 4, p["crc"]) for p in pieces]), "long", useArrow=True)
    crc = F.coalesce(joined(F.when(F.size("pieces") > 1, F.col("pieces"))), F.get("pieces", F.lit(0))["crc"])
    return whole.join(part_starts(spark.read.parquet(path)), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", crc.alias("ids_crc32")
    )


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    for row in matrix:
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


def crc32_of_joined(parts: list[tuple[int, int]]) -> int:
    """The crc32 of joined byte strings, from (length, crc32) of each."""
    total = parts[0][1]
    for length, crc in parts[1:]:
        # Appending a zero byte is linear in the register; its matrix is squared to append many.
        matrix = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
        for _ in range(3):
            matrix = [_times(matrix, row) for row in matrix]
        while length:
            if length & 1:
                total = _times(matrix, total)
            matrix = [_times(matrix, row) for row in matrix]
            length >>= 1
        total ^= crc
    return total
