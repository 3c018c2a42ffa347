"""Native matching and reply rules against plain Python on whole texts."""

import re

import pytest
from pyspark.sql import functions as F

from letterlens.fixed_values import DEFAULT_SEARCH_PATTERNS, QUOTE_LINE_PATTERNS, WHITESPACE
from letterlens.functions.arrays import running_starts
from letterlens.functions.matching import first_hits, keyword_hits
from letterlens.functions.regex import compile_check, matches_any
from letterlens.functions.text import fold_czech, immediate_reply, strip_tags
from letterlens.operators.keywords import all_hits, pattern_table_hits

PATTERNS = [
    r"\bth[a-z]*", r"tion", r"\d+", r"([a-z])\1", r"[^\W\d]{9,}\b", r"(?=x)|z", "a*", r"(?P<q>o)(?P=q)", r"[[a]b\Z",
    r"\bab|c\d", "é",
]
ODD = ["", "baac", "\x01x\U0001F600th xx\x02", "aaa", "the", "\U0001F600\U0001F601 aa oo \U0001F600", "x\x1cy", "[b"]


def expected(text, patterns=PATTERNS):
    return [(i, m.group(0), m.start()) for i, p in enumerate(patterns) for m in re.compile(p, re.I).finditer(text)]


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(t,) for t in ODD], "t string")
    return docs.select(fold_czech(F.col("text")).alias("t")).union(odd).cache()


def test_hits_equal_python(texts):
    hits = keyword_hits(F.col("t"), PATTERNS)
    for row in texts.select("t", hits.alias("h"), first_hits(hits).alias("f")).collect():
        want = expected(row.t)
        assert [tuple(h) for h in row.h] == want
        firsts = {}
        for hit in want:
            firsts.setdefault(hit[1], hit)
        assert [tuple(h) for h in row.f] == list(firsts.values())


def test_prefilter_equals_python(spark):
    texts = ["dov", "dov.", "xdov", "zpatecky uz", "p n.", "o o o", "vratim  se", "nic", "absence\nabs", "k dispozici"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (DEFAULT_SEARCH_PATTERNS, PATTERNS[:6], [r"\bab|c\d", "dis"]):
        rows = df.select("t", matches_any(F.col("t"), patterns).alias("m")).collect()
        assert [r.m for r in rows] == [any(re.search(p, r.t, re.I) for p in patterns) for r in rows]


def test_many_patterns(spark, texts):
    """More patterns than one guard, and more than one pass."""
    many = [f"t{a}{b}" for a in "haeiou" for b in "eaiont"] + PATTERNS[:4]
    hits = all_hits(texts.limit(50).withColumn("k", F.xxhash64("t")), ["k", "t"], "t", many)
    got = {}
    for r in hits.collect():
        got.setdefault(r.t, []).append((r.pattern_id, r.keyword, r.pos))
    for text, found in got.items():
        assert sorted(found) == sorted(expected(text, many))


def test_pattern_table(spark, monkeypatch):
    monkeypatch.setattr("letterlens.operators.keywords.PATTERNS_PER_PASS", 2)
    table = spark.createDataFrame([(10, "a"), (20, "b+"), (35, "c")], "pattern_id long, pattern string")
    df = spark.createDataFrame([(1, "abba c")], "k int, t string")
    rows = pattern_table_hits(df, ["k"], "t", table).collect()
    assert sorted((r.pattern_id, r.keyword, r.pos) for r in rows) == [(10, "a", 0), (10, "a", 3), (20, "bb", 1), (35, "c", 5)]


def test_bad_pattern():
    with pytest.raises(ValueError):
        compile_check(["("])


def test_running_starts(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 127, 128, 129, 5000)], "a array<bigint>")
    for row in df.select("a", running_starts(F.col("a")).alias("s")).collect():
        assert row.s == [sum(row.a[:i]) for i in range(len(row.a))]


QUOTES = [re.compile(p, re.I) for p in QUOTE_LINE_PATTERNS]


def reply_of(body):
    """The reply rules, restated."""
    if len(body.strip()) < 10:
        return body
    lines = body.split("\n")
    cut = next((i for i, line in enumerate(lines) if any(q.match(line) for q in QUOTES)), None)
    head = "\n".join(lines[:cut]).strip()
    if cut is not None:
        return head or body
    return body if len(head) < 20 else head


def test_reply(spark):
    markers = [
        "On Mon, Jan 15, 2024 at 10:30 AM A <a@b.cz> wrote:", "On 1/15/2024, A wrote:", "Dne 15.01.2024 v 10:30 A napsal",
        "Dne vcera A napsal(a):", "-----Original Message-----", "_____", "From: A", "  > x", " | x",
        "2024-01-15 10:30 A wrote:", "[2024-01-15 10:30]", "on 2024\nwrote:", "On", "none of these",
    ]
    heads = ["", "ok", "a line of ordinary length", "  two\nlines here, spaced  \n", "crlf line of text\r"]
    bodies = [f"{h}\n{m}\nrest of it" for h in heads for m in markers] + ["short", "x" * 15, " " * 30]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    for row in df.select("b", immediate_reply(F.col("b")).alias("r")).collect():
        assert row.r == reply_of(row.b), row.b


def test_strip_tags(spark):
    html = "<p>a&amp;b<script>x\x1c y</script> c</p >"
    row = spark.createDataFrame([(html,)], "h string").select(strip_tags(F.col("h")).alias("t")).first()
    assert row.t == re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", html)).strip()
    assert WHITESPACE == "".join(sorted(WHITESPACE)) and all(c.isspace() for c in WHITESPACE)
