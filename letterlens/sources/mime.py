"""The one place where message bytes become columns.

Two Arrow jobs around the standard library's email package: one over the header block only, one
over the whole message. Both are declared non-deterministic, which makes them barriers: a filter on
what they yield stays above them, so that no message is parsed once for the filter and again for the
result. Filter by keys before the header pass and by headers before the body pass. Spark still drops
a pass none of whose columns are used.
"""

import datetime as dt
from collections.abc import Iterator
from email import message_from_bytes
from email.header import decode_header
from email.utils import getaddresses, parsedate_to_datetime
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from letterlens.fixed_values import CHARSET_ORDER
from letterlens.functions.html import visible_text_of
from letterlens.schema import BODY, HEADERS, LOADED


def decoded(value) -> str:
    """A header value with its encoded words decoded; chunks are joined without a separator."""
    if not value:
        return ""
    try:
        return "".join(_chunk_text(chunk, charset) for chunk, charset in decode_header(value))
    except Exception:
        return str(value)


def _chunk_text(chunk, charset) -> str:
    if isinstance(chunk, str):
        return chunk
    try:
        return chunk.decode(charset or "latin1")
    except Exception:
        return chunk.decode("latin1")


def addresses(value) -> list[str]:
    """Lower-case addresses; the value is decoded first and parsed second."""
    return [address.lower() for _, address in getaddresses([decoded(value)]) if address] if value else []


def decode_text(payload: bytes, charset: str | None, order: tuple[str, ...]) -> str:
    """The first charset that decodes without an error: the declared one, then the fixed order."""
    for name in ([charset] if charset else []) + list(order):
        try:
            return payload.decode(name)
        except Exception:
            pass
    return payload.decode("latin1")


def _text(value) -> str | None:
    return None if value is None else str(value).encode("utf-8", "replace").decode("utf-8")


def _clean(text: str | None) -> str | None:
    """Arrow strings are UTF-8: lone surrogates cannot pass."""
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def header_row(block: bytes) -> dict:
    message = message_from_bytes(block)
    row = {"n_headers": len(message), "header_error": None}
    names = {}
    try:
        for name, value in message.items():
            names.setdefault(name.lower(), []).append(_text(value))
        row["headers"] = list(names.items())
        for column, name in (
            ("from_raw", "From"), ("to_raw", "To"), ("cc_raw", "Cc"), ("reply_to_raw", "Reply-To"),
            ("subject_raw", "Subject"), ("date_raw", "Date"), ("message_id", "Message-ID"),
        ):
            row[column] = _text(message.get(name))
        for column, name in (
            ("from_addrs", "From"), ("to_addrs", "To"), ("cc_addrs", "Cc"), ("reply_to_addrs", "Reply-To"),
        ):
            row[column] = [_clean(a) for a in addresses(message.get(name))]
        row["from_decoded"] = _clean(decoded(message.get("From")))
        row["subject"] = _clean(decoded(message.get("Subject")))
        row["date_wall"], row["date_utc"] = _dates(row["date_raw"])
    except Exception as error:
        row["header_error"] = f"{type(error).__name__}: {error}"
    return row


def _dates(raw: str | None):
    """Wall-clock time as written, and the instant; nulls for a missing or unreadable date."""
    try:
        written = parsedate_to_datetime(raw)
        wall = written.replace(tzinfo=None)
        zone = written.tzinfo or dt.timezone.utc
        return wall, wall.replace(tzinfo=zone).astimezone(dt.timezone.utc)
    except Exception:
        return None, None


def part_name(part) -> str | None:
    """File name from Content-Disposition, else the Content-Type name parameter."""
    name = part.get_filename() if part.get_content_disposition() else None
    name = name or part.get_param("name")
    if isinstance(name, tuple):
        name = name[2]
    return decoded(name) if name else None


def body_row(raw: bytes, with_text: bool, with_payload: bool, charset_order: tuple[str, ...]) -> dict:
    message = message_from_bytes(raw)
    multipart = message.is_multipart()
    parts, error, readable, nameable = [], None, with_text, True
    for ordinal, part in enumerate(message.walk()):
        row = {"ord": ordinal, "content_type": _text(part.get_content_type())}
        row["main_type"] = _text(part.get_content_maintype())
        payload = None
        # A fault ends text extraction, or name extraction, for the rest of the message only.
        if readable:
            try:
                payload = part.get_payload(decode=True)
                kind = part.get_content_type()
                if payload and (not multipart or kind in ("text/plain", "text/html")):
                    row["charset"] = _text(part.get_content_charset())
                    row["text"] = _clean(decode_text(payload, part.get_content_charset(), charset_order))
                    if kind == "text/html":
                        row["visible_text"] = _clean(visible_text_of(row["text"]))
            except Exception as fault:
                readable, error = False, f"{type(fault).__name__}: {fault}"
        if nameable and row["main_type"] != "multipart":
            try:
                row["disposition"] = _text(part.get_content_disposition())
                row["filename"] = _clean(part_name(part))
                if payload is None:
                    payload = part.get_payload(decode=True)
            except Exception as fault:
                nameable, error = False, f"{type(fault).__name__}: {fault}"
        row["size"] = len(payload) if payload else 0
        row["payload"] = payload if with_payload else None
        parts.append(row)
    return {"is_multipart": multipart, "parts": parts, "parse_error": error}


def name_row(raw: bytes) -> dict:
    """Kinds and file names of the parts; no payload is decoded."""
    message = message_from_bytes(raw)
    parts, error = [], None
    try:
        for ordinal, part in enumerate(message.walk()):
            if part.get_content_maintype() != "multipart":
                parts.append(
                    {
                        "ord": ordinal, "content_type": _text(part.get_content_type()),
                        "main_type": _text(part.get_content_maintype()),
                        "disposition": _text(part.get_content_disposition()), "filename": _clean(part_name(part)),
                    }
                )
    except Exception as fault:  # ends the list
        error = f"{type(fault).__name__}: {fault}"
    return {"is_multipart": message.is_multipart(), "parts": parts, "parse_error": error}


def payload_row(raw: bytes, wanted: list[int], with_payload: bool) -> dict:
    """Sizes, and the bytes if asked for, of the wanted parts. A fault ends the list."""
    loaded, error, left = [], None, set(wanted)
    for ordinal, part in enumerate(message_from_bytes(raw).walk()):
        if ordinal not in left:
            continue
        try:
            payload = part.get_payload(decode=True)
        except Exception as fault:
            error = f"{type(fault).__name__}: {fault}"
            break
        loaded.append({"ord": ordinal, "size": len(payload or b""), "payload": payload if with_payload else None})
        left.discard(ordinal)
        if not left:
            break
    return {"loaded": loaded, "load_error": error}


HEADERS_ARROW = to_arrow_type(HEADERS)
LOADED_ARROW = to_arrow_type(LOADED)
BODY_ARROW = to_arrow_type(BODY)
PLACED = T.StructType([T.StructField("block_pos", T.LongType()), *HEADERS.fields])


# So many rows and bytes of a batch are Python objects at a time: Spark's batches hold up to 10,000 messages of any length.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive pieces of a binary column: few rows, few bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        most = (ends[start - 1] if start else 0) + PIECE_BYTES
        end = min(start + PIECE_ROWS, max(start + 1, int(np.searchsorted(ends, most, "right"))), len(ends))
        yield start, end - start
        start = end


def _parsed(batches: Iterator[pa.Array], row_of, arrow_type: pa.DataType) -> Iterator[pa.Array]:
    """row_of(bytes or None) of every message, piece by piece."""
    for batch in batches:
        for piece in pieces(batch):
            yield pa.array([row_of(r.as_py()) for r in batch.slice(*piece)], arrow_type)


@cache
def _headers():
    @F.arrow_udf(HEADERS)
    def headers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _parsed(batches, lambda block: header_row(block or b""), HEADERS_ARROW)

    return headers.asNondeterministic()


@cache
def _placed_headers():
    """The header pass for archives: it also numbers the messages within their file block. It has
    to see every record of the scan in order, hence not deterministic: no filter may sink below."""
    arrow_type = to_arrow_type(PLACED)

    @F.arrow_udf(PLACED)
    def placed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        here, position = None, 0
        for batch in batches:
            for piece in pieces(batch[3]):
                rows = []
                for a, s, o, b in zip(*(column.slice(*piece).to_pylist() for column in batch)):
                    if (a, s) != here:
                        here, position = (a, s), 0
                        if s == 0 and not o:
                            # Text before the first envelope line of a file is no message.
                            rows.append({"block_pos": -1})
                            continue
                    rows.append({"block_pos": position, **header_row(b or b"")})
                    position += 1
                yield pa.array(rows, arrow_type)

    return placed.asNondeterministic()


@cache
def _body(with_text: bool, with_payload: bool, charset_order: tuple[str, ...]):
    @F.arrow_udf(BODY)
    def body(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        row_of = lambda raw: None if raw is None else body_row(raw, with_text, with_payload, charset_order)
        return _parsed(batches, row_of, BODY_ARROW)

    return body.asNondeterministic()


@cache
def _names():
    @F.arrow_udf(BODY)
    def names(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _parsed(batches, lambda raw: None if raw is None else name_row(raw), BODY_ARROW)

    return names.asNondeterministic()


@cache
def _payloads(with_payload: bool):
    @F.arrow_udf(LOADED)
    def payloads(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for raw, wanted in batches:
            for piece in pieces(raw):
                rows = zip((r.as_py() for r in raw.slice(*piece)), wanted.slice(*piece).to_pylist())
                yield pa.array([None if r is None or not w else payload_row(r, w, with_payload) for r, w in rows], LOADED_ARROW)

    return payloads.asNondeterministic()


def header_block(raw: Column) -> Column:
    """The bytes up to the first empty line."""
    text = raw.cast("string")
    return F.substring_index(F.substring_index(text, "\n\n", 1), "\n\r\n", 1).cast("binary")


def with_headers(messages: DataFrame) -> DataFrame:
    """Add the header columns to a frame that has a raw column."""
    parsed = messages.withColumn("_h", _headers()(header_block(F.col("raw"))))
    return parsed.select(*messages.columns, "_h.*")


def with_placed_headers(records: DataFrame) -> DataFrame:
    """As with_headers, for records straight from an archive scan; adds block_pos."""
    placed = _placed_headers()("archive", "block_start", "opens_file", header_block(F.col("raw")))
    kept = [c for c in records.columns if c != "opens_file"]
    return records.withColumn("_h", placed).select(*kept, "_h.*").filter(F.col("block_pos") >= 0)


def with_parts(
    messages: DataFrame, with_text: bool = True, with_payload: bool = False,
    charset_order: tuple[str, ...] = CHARSET_ORDER, where: Column | None = None,
) -> DataFrame:
    """Add is_multipart, parts and parse_error. Payload bytes are left out unless asked for. With a condition, the bodies
    of other rows are not parsed and their columns are null."""
    parsed = messages.withColumn("_b", _body(with_text, with_payload, charset_order)(_bytes(where)))
    return parsed.select(*messages.columns, "_b.*")


def with_part_names(messages: DataFrame, where: Column | None = None) -> DataFrame:
    """As with_parts, for kinds and names only: nothing is decoded, sizes are null."""
    return messages.withColumn("_b", _names()(_bytes(where))).select(*messages.columns, "_b.*")


def with_payloads(messages: DataFrame, wanted: Column, with_payload: bool) -> DataFrame:
    """Add loaded (ord, size, payload) and load_error for the parts whose ordinals `wanted` lists. Messages of which no
    part is wanted are not parsed, other parts are not decoded."""
    raw = F.when(F.size(wanted) > 0, F.col("raw"))
    return messages.withColumn("_p", _payloads(with_payload)(raw, wanted)).select(*messages.columns, "_p.*")


def _bytes(where: Column | None) -> Column:
    raw = F.coalesce("raw", F.lit(b""))
    return raw if where is None else F.when(where, raw)


def body_text(html_mode: str = "visible") -> Column:
    """All readable parts in order, joined by a space; HTML as visible text or with tags cut."""
    from letterlens.functions.text import strip_tags

    def readable(part: Column) -> Column:
        as_text = part["visible_text"] if html_mode == "visible" else strip_tags(part["text"])
        return F.when(part["content_type"] == "text/html", as_text).otherwise(part["text"])

    kept = F.filter(F.col("parts"), lambda p: p["text"].isNotNull())
    return F.array_join(F.transform(kept, readable), " ")
