"""Letters that every match of a pattern holds, and their grams: what an index of patterns is built on."""

import re

import numpy as np

GRAM = 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Letters that ignore-case matching takes for an ASCII letter, and that letter.
LOOKALIKES = "\u0131\u0130\u017f\u212a"
LOOKALIKES_ASCII = "iisk"
_PLAIN = str.maketrans(CAPITALS + LOOKALIKES, CAPITALS.lower() + LOOKALIKES_ASCII)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    return text.translate(_PLAIN)


def required_literal(pattern: str) -> str | None:
    """The longest run of plain ASCII letters that stands in every match, in small letters; None if there is none that can
    be told. Errs on the side of None: groups and classes are stepped over, a choice or a flag gives up."""
    runs, run, at = [], "", 0
    while at < len(pattern):
        char = pattern[at]
        literal = None
        if char == "|":
            return None
        if char == "\\":
            escaped = pattern[at + 1 : at + 2]
            literal = escaped if escaped.isascii() and not escaped.isalnum() else None
            if escaped and escaped in "xuUN0":  # a code point in digits: too long to step over safely
                return None
            at += 2
        elif char == "[":
            at = _class_end(pattern, at)
        elif char == "(":
            if re.match(r"\(\?[aiLmsux-]", pattern[at:]):
                return None
            at = _group_end(pattern, at)
        else:
            literal = char if char.isascii() and char not in ".^$" else None
            at += 1
        counted = re.compile(r"(\*|\+|\?|\{[0-9]*,?[0-9]*\})[?+]?").match(pattern, at)
        if literal is None:
            runs, run = [*runs, run], ""
        elif counted is None:
            run += literal
        else:
            runs, run = [*runs, run + literal if counted[1] == "+" else run], ""
        at = counted.end() if counted else at
    return plain(max([*runs, run], key=len)) or None


def _class_end(pattern: str, at: int) -> int:
    at += 1
    at += pattern[at : at + 1] == "^"
    at += pattern[at : at + 1] == "]"
    while at < len(pattern) and pattern[at] != "]":
        at += 2 if pattern[at] == "\\" else 1
    return at + 1


def _group_end(pattern: str, at: int) -> int:
    depth = 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 2
            continue
        if pattern[at] == "[":
            at = _class_end(pattern, at)
            continue
        depth += (pattern[at] == "(") - (pattern[at] == ")")
        at += 1
        if not depth:
            break
    return at


def grams(text: str) -> np.ndarray:
    """Distinct 64-bit names of the runs of GRAM code points, ascending."""
    points = np.frombuffer(plain(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    last = len(points) - GRAM + 1
    if last < 1:
        return np.empty(0, np.int64)
    names = np.zeros(last, np.uint64)
    for offset in range(GRAM):
        names = (names ^ points[offset : offset + last]) * _FACTOR
        names ^= names >> np.uint64(29)
    return np.unique(names.view(np.int64))
