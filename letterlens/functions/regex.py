"""Search patterns are written in Python's regex dialect; Spark matches with Java's."""

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# i: ignore case, d: only \n ends a line, U: Unicode classes and case rules.
FLAGS_IGNORE_CASE = "(?idU)"
FLAGS_EXACT_CASE = "(?dU)"

# str.isspace() also holds for U+001C..U+001F, Java's \s does not.
SPACE = r"[\s\x1c-\x1f]"


def to_java(pattern: str) -> str:
    """The Java spelling of a Python pattern; raises re.error for an invalid one."""
    re.compile(pattern)
    java = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java)
    # An unescaped [ inside a class is a plain character in Python and a nested class in Java.
    return re.sub(r"\[(\^?\]?)((?:\\.|[^\]\\])*)\]", _plain_class, java)


def _plain_class(match: re.Match) -> str:
    opening, body = match.groups()
    body = re.sub(r"(?<!\\)\[", r"\\[", body).replace("&&", r"&\&")
    return f"[{opening.replace(']', chr(92) + ']')}{body}]"


def java_pattern(pattern: str, case_sensitive: bool = False) -> str:
    flags = FLAGS_EXACT_CASE if case_sensitive else FLAGS_IGNORE_CASE
    return flags + to_java(pattern)


def matches_any(text: Column, patterns: list[str], case_sensitive: bool = False) -> Column:
    """True where at least one pattern occurs. One alternation serves all patterns that can share
    one; those with group references or inline flags are tested on their own."""
    flags = FLAGS_EXACT_CASE if case_sensitive else FLAGS_IGNORE_CASE
    shared = [p for p in patterns if _shareable(p)]
    tests = [text.rlike(flags + to_java(p)) for p in patterns if not _shareable(p)]
    tests += [text.rlike(flags + any_of(shared))] if shared else []
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def any_of(patterns: list[str]) -> str:
    """A Java regex that occurs wherever one of the patterns does; it may be empty, and then occurs
    everywhere, if the patterns cannot share one. A common \\b is tested once per position instead
    of once per pattern."""
    if not all(_shareable(p) for p in patterns):
        return ""
    at_word = [p[2:] for p in patterns if _opens_at_word(p)]
    anywhere = [p for p in patterns if not _opens_at_word(p)]
    choices = [_choice(anywhere)] if anywhere else []
    choices += [r"\b" + _choice(at_word)] if at_word else []
    return "(?:" + "|".join(choices) + ")"


def _shareable(pattern: str) -> bool:
    return not re.search(r"\\[1-9]|\(\?[Pa-zA-Z(]", pattern)


def _opens_at_word(pattern: str) -> bool:
    # A quantifier right after \b would be left without its operand.
    return bool(re.match(r"\\b(?![*+?{])", pattern)) and not _has_top_level_choice(pattern)


def _choice(patterns: list[str], depth: int = 3) -> str:
    """An alternation in which patterns with the same opening letters share them, so that a text
    position is tested against few branches even for a long list."""
    sharing, branches = {}, []
    for pattern in patterns:
        opens_plain = re.match(r"[a-z0-9](?![*+?{])", pattern) and not _has_top_level_choice(pattern)
        if depth and opens_plain:
            sharing.setdefault(pattern[0], []).append(pattern[1:])
        else:
            branches.append(f"(?:{to_java(pattern)})")
    for letter, rests in sharing.items():
        branches.append(letter + (_choice(rests, depth - 1) if len(rests) > 1 else f"(?:{to_java(rests[0])})"))
    return "(?:" + "|".join(branches) + ")"


def _has_top_level_choice(pattern: str) -> bool:
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    while re.search(r"\([^()]*\)", bare):
        bare = re.sub(r"\([^()]*\)", "", bare)
    return "|" in bare


def compile_check(patterns: list[str]) -> None:
    """Fail on the driver, with the pattern named, rather than inside a task."""
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error as error:
            raise ValueError(f"invalid search pattern {pattern!r}: {error}") from error
