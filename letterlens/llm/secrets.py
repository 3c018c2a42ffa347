"""Secret scan with corpus-wide ownership of each candidate.

Candidates with a known shape are secrets wherever they occur. A candidate without one (a long mixed string) is only a
secret if it looks live: it belongs to one owner, and to few repositories of that owner. Strings that many owners carry,
or that one owner has copied widely, are examples, keys of public tools or digests that were copied along."""

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from letterlens.scale import materialize

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones fail as a whole
SHAPELESS = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
OWNER_LIMIT = 1
REPOSITORY_LIMIT = 20
SPAN = "struct<start: bigint, kind: string, end: bigint, value: bigint>"
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("value", pa.int64())]))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret) in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def shapeless_spans(text: str, base: list[tuple]) -> list[tuple[int, int, str]]:
    """Long strings with capitals, small letters and digits that no base span touches."""
    found = []
    for m in SHAPELESS.finditer(text):
        value = m[0]
        if (
            any("0" <= c <= "9" for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)
            and not any(start < m.end() and m.start() < end for start, _, end, _ in base)
        ):
            found.append((m.start(), m.end(), value))
    return found


def candidates(docs: DataFrame, repository: str, owner: str, text: str) -> DataFrame:
    """Stored: (uid, repository, owner, spans, shapeless), the last two with the hash of each candidate instead of its text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for value in batch.column(2).to_pylist():
                found = base_spans(value) if value else []
                base.append([_span(s, KINDS[k], e, v) for s, k, e, v in found])
                more.append([_span(s, "token", e, v) for s, e, v in shapeless_spans(value, found)] if value else [])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(base, SPAN_ARROW), pa.array(more, SPAN_ARROW)],
                ["repository", "owner", "spans", "shapeless"],
            )

    def _span(start: int, kind: str, end: int, value: str) -> dict:
        return {"start": start, "kind": kind, "end": end, "value": xxhash.xxh3_64_intdigest(value) - (1 << 63)}

    rows = docs.select(F.col(repository).alias("repository"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"))
    kind = rows.schema["repository"].dataType.simpleString()
    rows = rows.mapInArrow(scan, f"repository {kind}, owner string, spans array<{SPAN}>, shapeless array<{SPAN}>")
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repositories, n_owners) of every candidate over the whole corpus. Rows are folded to (value, owner,
    repository), then to (value, owner), before values are counted, so a value in every document costs no task more than its share. A null
    owner or repository counts as one of its own."""
    all_ = found.select("repository", "owner", F.explode(F.concat("spans", "shapeless")).alias("span"))
    per_repository = all_.groupBy(F.col("span.value").alias("value"), "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = per_repository.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return per_owner.groupBy("value").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan_secrets(
    docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text", owner_limit: int = OWNER_LIMIT,
    repository_limit: int = REPOSITORY_LIMIT,
) -> DataFrame:
    """(uid, repository, base, spans, n_copied) per document. base holds the spans of known shape; spans adds the shapeless
    ones that at most owner_limit owners and repository_limit distinct repositories have; n_copied counts spans whose secret
    more owners or more repositories have. Spans are (start, kind, end) in code points, end exclusive, in order of start, then
    of kind as listed.

    Null and empty texts have no spans. Rows with equal or null repositories are treated one by one; extra columns are
    ignored."""
    found = candidates(docs, repository, owner, text)
    owners = ownership(found)
    spread = found.select("uid", F.explode(F.concat("spans", "shapeless")).alias("span"))
    judged = spread.join(owners, F.col("span.value") == F.col("value"))
    copied = (F.col("n_owners") > owner_limit) | (F.col("n_repositories") > repository_limit)
    live = (F.col("span.kind") == "token") & ~copied
    plain = F.struct("span.start", "span.kind", "span.end")
    per_document = judged.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.when(live, plain))).alias("added"),
        F.sum(copied.cast("long")).alias("n_copied"),
    )
    without = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, "token"))), s["kind"])
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(
        F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)
    )
    every = F.when(F.size("added") > 0, F.array_sort(F.concat("base", "added"), order)).otherwise(F.col("base"))
    return (
        found.select("uid", "repository", without.alias("base"))
        .join(per_document, "uid", "left")
        .select("uid", "repository", "base", every.alias("spans"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))
    )
