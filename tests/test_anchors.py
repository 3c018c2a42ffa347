"""Letters that a match must hold, and the index of patterns built on them."""

import random
import re

import pytest

from letterlens.functions.anchors import GRAM, grams, plain, required_literal
from letterlens.operators import keywords

PATTERNS = [
    "abcdef", r"\babcdef+gh", r"abcdefg?h", r"x*abcde{0,2}f", r"(abc|def)ghijkl", r"abc|def", r"a\.b\-cd\$e", r"[abc]defgh\]", r"(?i)abcdef",
    r"\x41bcdefgh", r"abcd\s+efghij", r"AbCdEf.ghijklm", r"((ab)c)*defghi", r"é+abcdef", r"abcdef{2}gh", r"[]a]bcdefg", r"^abcdef$",
    r"(?:a)bcde*?fghijkl", r"abc(?=def)defgh", r"a++bcdefg",
]


def test_every_match_holds_the_literal():
    r = random.Random(2)
    for pattern in PATTERNS:
        literal = required_literal(pattern)
        for _ in range(3000):
            text = "".join(r.choice("abcdefghijklmAB.$-] é") for _ in range(6))
            text += r.choice(["", "abcdef", "abcdefgh", "defghi", "abcd efghij", "bcdefg", "a.b-cd$e", "abcdeffgh", "AbCdEfxghijklm", "abcdgh"]) + text
            if (match := re.search(pattern, text, re.I)) and literal:
                assert literal in plain(match[0]), (pattern, literal, match[0])
    assert [required_literal(p) for p in PATTERNS[:3]] == ["abcdef", "abcdef", "abcdef"]
    assert [required_literal(p) for p in (r"abc|def", "(?i)abcdef", r"\x41bcdef", r"\d+")] == [None] * 4


def test_grams_of_lookalikes():
    assert set(grams("kissing")) <= set(grams("x KIſSİNG y"))
    assert len(grams("abcd")) == 0 and len(grams("a" * 100_000)) == 1 and GRAM == 5


@pytest.mark.parametrize("sent", [10**6, 0])
def test_indexed_hits_equal_python(spark, monkeypatch, sent):
    monkeypatch.setattr(keywords, "ANCHORS_SENT", sent)
    r = random.Random(3)
    words = ["station", "nation", "kissing", "KIſSING", "\U0001F600", "über", "a.b.c.d.e", "12345", "x"]
    texts = [(r.choice([1, 2, None]), " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for _ in range(60)]
    texts += [(7, None), (7, ""), (8, "station " * 5000), (9, "the station"), (9, "the station")]
    patterns = [(1, "station"), (1, "nation"), (None, r"kis+ing\b"), (2, r"a\.b\.c\.d"), (3, r"\d+"), (4, "x|y"), (5, "stations?"), (6, "never-there")]
    df = spark.createDataFrame(texts, "k int, t string").repartition(4)
    table = spark.createDataFrame(patterns, "pattern_id int, pattern string")
    got = sorted(map(repr, map(tuple, keywords.pattern_table_hits(df, ["k"], "t", table).collect())))
    want = [(k, i, m[0], m.start()) for k, t in texts if t for i, p in patterns for m in re.finditer(p, t, re.I)]
    assert got == sorted(map(repr, want))


def test_many_patterns_on_one_text(spark):
    """More patterns on one text than one list holds."""
    words = [f"word{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, words[7])], "k int, t string")
    table = spark.createDataFrame(list(enumerate(words)), "pattern_id int, pattern string")
    hits = keywords.pattern_table_hits(df, ["k"], "t", table)
    assert hits.count() == 3001
    with pytest.raises(Exception, match="invalid search pattern"):
        keywords.pattern_table_hits(df, ["k"], "t", spark.createDataFrame([(1, "(")], "pattern_id int, pattern string"))
