"""Main text of HTML pages, with boilerplate found by a suffix array for each host.

The blocks of a page outside its article are one token stream; the streams of a host are its text. Suffixes of that text
that agree in their first RUN tokens stand next to each other in its suffix array, so a stretch that several pages
repeat is an interval of suffixes from several pages. The array is needed to that depth only, and not in order across
intervals: Spark groups the suffixes by host and prefix. No host is gathered in one task.

A page with an article (or main) element gives the blocks in it that are not marked as something else: text that two
articles share is still text of both, so repetition never removes it. A page without such an element gives its open
blocks less those that repeated stretches cover."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from letterlens.llm.graph import connected_components
from letterlens.llm.pages import ARTICLE, MAIN, OPEN, WRAPPED, page_blocks
from letterlens.llm.words import MIX, WordHashes, stirred
from letterlens.scale import materialize

RUN = 8
LEAST_PAGES = 2
COVERED = 0.8
NEAR_EQUAL = 0.8
PAGE, RUNS = "__page", "__runs"


def best_region(blocks: list[tuple[int, str]]) -> int:
    """The region that holds the page's article. One inside a marked wrapper counts if it is longer than the open text."""
    sizes = [0] * (OPEN + 1)
    for region, text in blocks:
        if region <= OPEN:
            sizes[region] += len(text)
    if sizes[ARTICLE] or sizes[MAIN]:
        return ARTICLE if sizes[ARTICLE] else MAIN
    return WRAPPED if sizes[WRAPPED] > sizes[OPEN] else OPEN


def prefixes(tokens: list[bytes], cache: WordHashes, run: int) -> np.ndarray:
    """Hash of the first `run` tokens of each suffix long enough."""
    count = len(tokens) - run + 1
    if count < 1:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    mixed = np.zeros(count, np.uint64)
    for offset in range(run):
        mixed = mixed * MIX + hashes[offset : offset + count]
    return stirred(mixed).view(np.int64)


def suffixes(pages: DataFrame, run: int) -> DataFrame:
    """(host, page, open, prefixes, own): the suffixes of what is not article text; open marks pages without an article, own
    holds those of their open blocks alone."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            opened, found, own = [], [], []
            for page in batch.column("html").to_pylist():
                blocks = page_blocks(page)
                best = best_region(blocks)
                opened.append(best == OPEN)
                rest = [text for region, text in blocks if best == OPEN or region > best]
                found.append(prefixes(" ".join(rest).encode().split(), cache, run))
                inner = [text for region, text in blocks if region == best == OPEN]
                own.append(np.unique(prefixes(" ".join(inner).encode().split(), cache, run)))
            yield pa.record_batch(
                [batch.column("host"), batch.column("page"), pa.array(opened), *(pa.array(x, pa.list_(pa.int64())) for x in (found, own))],
                ["host", "page", "open", "prefixes", "own"],
            )

    return pages.mapInArrow(walk, "host long, page long, open boolean, prefixes array<long>, own array<long>")


def near_equal(streams: DataFrame, near: float) -> DataFrame:
    """(page, same_as) for open pages of a host that are one text with small differences, like a print view: twice the
    suffixes that two pages share are at least `near` of those that both have.

    Such a page shares near / (2 - near) of its suffixes, so with its suffixes in one order (rarest first) two of them meet in
    the rest of that share. Each is compared with the first page of every suffix that it has there; links add up."""
    pages = streams.where("open and size(own) > 0").select("host", "page", "own").dropDuplicates(["page"])
    each = pages.select("host", "page", F.size("own").alias("n"), F.explode("own").alias("prefix"))
    seen = each.groupBy("host", "prefix").agg(F.count("*").alias("seen")).where("seen > 1")
    least = F.ceil(F.col("n") * (near / (2 - near)) - 1e-9)
    shared = (
        each.join(seen, ["host", "prefix"]).groupBy("host", "page", "n")
        .agg(F.sort_array(F.collect_list(F.struct("seen", "prefix"))).alias("shared"))  # no longer than the page
        .where(F.size("shared") >= least)
        # What no other page has stands first in the order and takes up its part of the places.
        .select("host", "page", F.explode(F.slice("shared.prefix", F.lit(1), F.greatest(F.size("shared") - least + 1, F.lit(1)))).alias("prefix"))
    )
    shared = materialize(shared, "anchors")
    first = shared.groupBy("host", "prefix").agg(F.min("page").alias("first"), F.count("*").alias("having")).where("having > 1")
    pairs = shared.join(first, ["host", "prefix"]).where("page != first").select("page", "first").distinct()
    one, other = pages.select("page", F.col("own").alias("a")), pages.select(F.col("page").alias("first"), F.col("own").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    links = pairs.join(one, "page").join(other, "first").where(2 * both >= near * (F.size("a") + F.size("b")))
    found = connected_components(links.select(F.col("page").alias("a"), F.col("first").alias("b")))
    return found.toDF("page", "same_as")


def repeated_places(pages: DataFrame, run: int, least_pages: int, near: float) -> DataFrame:
    """(page, places): where in the stream of a page without an article a repeated stretch of `run` tokens begins."""
    streams = materialize(suffixes(pages, run), "suffixes")
    each = streams.select("host", "page", F.explode("prefixes").alias("prefix")).distinct()
    seen = each.groupBy("host", "prefix").agg(F.count("*").alias("seen")).where(F.col("seen") >= least_pages)
    # Near-equal pages count once: what each group of them has counted too often is taken off.
    same = materialize(near_equal(streams, near), "same")
    too_often = (
        each.join(same, "page").groupBy("host", "prefix", "same_as").agg((F.count("*") - 1).alias("more"))
        .groupBy("host", "prefix").agg(F.sum("more").alias("more"))
    )
    repeated = seen.join(too_often, ["host", "prefix"], "left").where(F.col("seen") - F.coalesce("more", F.lit(0)) >= least_pages)
    open_ = streams.where("open").dropDuplicates(["page"])
    places = open_.select("host", "page", F.posexplode("prefixes").alias("place", "prefix"))
    hits = places.join(repeated.select("host", "prefix"), ["host", "prefix"], "left_semi")
    return hits.groupBy("page").agg(F.collect_list("place").alias("places"))  # no longer than the page


def main_text(
    pages: DataFrame, html: str = "html", url: str = "url", run: int = RUN, least_pages: int = LEAST_PAGES,
    near: float = NEAR_EQUAL,
) -> DataFrame:
    """pages with text, n_blocks and n_dropped (blocks left out). Blocks are joined by a line break.

    A stretch is boilerplate when `least_pages` distinct pages of its host have it, however many pages the host has. Pages
    that are equal in address and text count once, and so do pages without an article whose open blocks are nearly the
    same (`near`): a text at two addresses is no boilerplate of itself. A block goes when four fifths of its tokens are covered; a page that would
    lose every block keeps them. Null and empty pages have the text "". A null address is a host of its own; repeated rows are treated alike. Columns of pages
    that bear one of the new names are replaced."""
    pages = pages.drop("text", "n_blocks", "n_dropped")
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)))
    keyed = pages.select(host.alias("host"), F.xxhash64(url, html).alias("page"), F.col(html).alias("html"))
    places = materialize(repeated_places(keyed, run, least_pages, near), "places")
    rows = pages.withColumn(PAGE, F.xxhash64(url, html)).join(places.toDF(PAGE, RUNS), PAGE, "left")
    schema = StructType([*pages.schema]).add("text", "string").add("n_blocks", "long").add("n_dropped", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for page, repeated in zip(batch.column(html).to_pylist(), batch.column(RUNS).to_pylist()):
                blocks = page_blocks(page)
                kept = kept_blocks(blocks, repeated or [], run)
                texts.append("\n".join(kept))
                total.append(len(blocks))
                dropped.append(len(blocks) - len(kept))
            names = [name for name in batch.schema.names if name not in (PAGE, RUNS)]
            yield pa.record_batch(
                [*(batch.column(name) for name in names), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                [*names, "text", "n_blocks", "n_dropped"],
            )

    return rows.mapInArrow(extract, schema)


def kept_blocks(blocks: list[tuple[int, str]], repeated: list[int], run: int) -> list[str]:
    best = best_region(blocks)
    own = [text for region, text in blocks if region == best]
    if best != OPEN or not repeated:
        return own
    # `repeated` counts tokens of the whole stream, in which open and outside blocks stand in page order.
    stream = [(region, text, len(text.encode().split())) for region, text in blocks]
    cover = np.zeros(sum(n for _, _, n in stream) + 1, np.int64)
    starts = np.array(repeated)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)]
    kept, at = [], 0
    for region, text, n in stream:
        if region == OPEN and covered[at + n] - covered[at] < COVERED * n:
            kept.append(text)
        at += n
    return kept or own
