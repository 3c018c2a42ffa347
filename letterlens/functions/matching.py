"""Keyword matching with offsets, as native expressions over the folded text."""

from pyspark.sql import Column, functions as F

from letterlens.functions.anchors import CAPITALS, LOOKALIKES, LOOKALIKES_ASCII
from letterlens.functions.arrays import first_per_key, let, running_starts
from letterlens.functions.regex import FLAGS_EXACT_CASE, FLAGS_IGNORE_CASE, any_of, to_java

LISTED_HIT_TYPE = "array<struct<pattern_id:bigint,keyword:string,pos:bigint>>"
HIT_TYPE = "array<struct<pattern_id:int,keyword:string,pos:bigint>>"

# Java regexes see UTF-16: a match must not start between the halves of one code point.
NOT_INSIDE_A_PAIR = r"(?![\x{DC00}-\x{DFFF}])"
BEYOND_16_BITS = r"[\x{10000}-\x{10FFFF}]"

# Put around each match to find it again; texts that hold them already take another way.
OPEN, CLOSE = "\x01", "\x02"

PATTERNS_PER_GUARD = 16


def keyword_hits(text: Column, patterns: list[str], case_sensitive: bool = False) -> Column:
    """All non-overlapping matches of all patterns, in pattern order and then text order.

    The patterns travel as array literals, so the plan stays small however long the list is. One
    alternation guards each group of patterns: a text is searched with the members of a group only
    if one of them occurs.
    """
    none = F.array().cast(HIT_TYPE)
    if not patterns:
        return none
    flags = FLAGS_EXACT_CASE if case_sensitive else FLAGS_IGNORE_CASE
    java = [to_java(p) for p in patterns]
    plain = _literals([flags + p for p in java])
    guarded = _literals([f"{flags}{NOT_INSIDE_A_PAIR}(?:{p})" for p in java])
    groups = [patterns[i : i + PATTERNS_PER_GUARD] for i in range(0, len(patterns), PATTERNS_PER_GUARD)]
    guards = _literals([flags + any_of(g) for g in groups])

    def search(t: Column) -> Column:
        regexes = F.when(t.rlike(BEYOND_16_BITS), guarded).otherwise(plain)

        def group_hits(guard: Column, g: Column) -> Column:
            first = g * PATTERNS_PER_GUARD
            members = F.slice(regexes, first + 1, F.lit(PATTERNS_PER_GUARD))
            found = F.flatten(F.transform(members, lambda regex, i: _pattern_hits(t, first + i, regex)))
            return F.when(F.rlike(t, guard), found).otherwise(none)

        return F.flatten(F.transform(guards, group_hits))

    return let(text, search)


def hits_of_rows(text: Column, patterns: Column) -> Column:
    """Hits of the patterns that a row lists, as structs of pattern_id, a literal that every match holds, and the two Java
    spellings. Patterns whose literal the text lacks are left out before any regex runs."""

    def search(small: Column) -> Column:
        regex = lambda p: F.when(text.rlike(BEYOND_16_BITS), p["guarded"]).otherwise(p["plain"])
        held = F.filter(patterns, lambda p: F.contains(small, p["literal"]))
        return F.flatten(F.transform(held, lambda p: _pattern_hits(text, p["pattern_id"], regex(p), LISTED_HIT_TYPE)))

    return let(F.translate(text, CAPITALS + LOOKALIKES, CAPITALS.lower() + LOOKALIKES_ASCII), search)


def _literals(values: list[str]) -> Column:
    return F.split(F.lit("\0".join(values)), "\0", -1)


def _pattern_hits(text: Column, pattern_id: Column, regex: Column, kind: str = HIT_TYPE) -> Column:
    marked = F.regexp_replace(text, regex, F.lit(f"{OPEN}$0{CLOSE}"))
    by_marks = let(F.split(marked, OPEN, -1), lambda pieces: _marked_hits(pattern_id, pieces, kind))
    by_gaps = let(
        F.regexp_extract_all(text, regex, 0), lambda found: _spaced_hits(text, pattern_id, regex, found, kind)
    )
    return F.when(text.contains(OPEN) | text.contains(CLOSE), by_gaps).otherwise(by_marks)


def _hit(pattern_id: Column, keyword: Column, pos: Column) -> Column:
    return F.struct(pattern_id.alias("pattern_id"), keyword.alias("keyword"), pos.alias("pos"))


def _marked_hits(pattern_id: Column, pieces: Column, kind: str) -> Column:
    """Every piece but the first is a match, the closing mark and the text up to the next match, so
    the running total of the piece lengths gives the 0-based code-point offsets."""
    lengths = F.transform(pieces, lambda p, i: (F.length(p) - F.when(i > 0, 1).otherwise(0)).cast("bigint"))
    hits = let(
        running_starts(lengths),
        lambda starts: F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces) - 1),
            lambda p, i: _hit(pattern_id, F.substring_index(p, CLOSE, 1), starts[i + 1]),
        ),
    ).cast(kind)
    return F.when(F.size(pieces) > 1, hits).otherwise(F.array().cast(kind))


def _spaced_hits(text: Column, pattern_id: Column, regex: Column, found: Column, kind: str) -> Column:
    """The same from the match texts and the gaps between them, without marks."""

    def hits(gaps: Column) -> Column:
        steps = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(found)),
            found,
            lambda gap, hit: (F.length(gap) + F.length(hit)).cast("bigint"),
        )
        return let(
            running_starts(steps),
            lambda starts: F.transform(found, lambda hit, i: _hit(pattern_id, hit, starts[i] + F.length(gaps[i]))),
        ).cast(kind)

    # An empty match at the very start yields no gap before it.
    gaps = let(
        F.split(text, regex, -1),
        lambda g: F.when(F.size(g) > F.size(found), g).otherwise(F.concat(F.array(F.lit("")), g)),
    )
    return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(let(gaps, hits))


def first_hits(hits: Column) -> Column:
    """One hit per distinct keyword text: the first in (pattern, position) order."""
    return first_per_key(hits, "keyword", ["pattern_id", "pos"])


def hit_keywords(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["keyword"])


def hit_positions(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["pos"])
