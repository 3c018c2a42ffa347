import re
from collections import Counter

from letterlens.llm.rules import BIT, POLICIES, ablations, ledger, mask, measure, passes

SPACE = " \t\n\r\v\f"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered, dup, lines = Counter(runs), set(), 0, []
    for i, run in enumerate(runs):
        if seen[run] > 1:
            covered |= set(range(i, i + 5))
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines)


TEXTS = [
    None, "", " \n\t", "a", "one two three four five six seven eight nine ten", "a b c d e " * 3, "a a a a a a", "x\nx\n\n x\nx",
    "é ü   𝄞\x1cb", "#tag *bold* | $5 & <b>", "SHOUT!! LOUD!! " * 8, "w*** x*** y*** " * 5, "a b c d e f a b c d e", "long " * 40_000,
    "l\r\nl\r\nl", "a b c d e a b c d",
]


def test_measurements():
    for text in TEXTS:
        assert measure(text.encode() if text is not None else None)[:6] == slow(text)


def test_ledger_and_policies(spark, table):
    rows = list(enumerate(TEXTS)) + [(None, "a"), (3, "a")]
    found = ledger(table(rows))
    assert "text" not in found.columns
    got = found.withColumn("ok", passes("v3")).collect()
    assert len(got) == len(rows)
    for r in got:
        n = r.n_words
        assert bool(r.failed_bits & 1 << BIT["few_words"]) == (n < 10)
        assert bool(r.failed_bits & 1 << BIT["repeated_words"]) == (100 * r.n_repeat_words > 20 * n)
        assert r.ok == (r.failed_bits & mask(POLICIES["v3"]) == 0)
    for case in ablations(found).collect():
        without = mask(n for n in POLICIES[case.policy] if n != case.rule)
        assert case.documents == len(rows)
        assert case.kept == sum(r.failed_bits & mask(POLICIES[case.policy]) == 0 for r in got)
        assert case.kept_without == sum(r.failed_bits & without == 0 for r in got)


def test_empty_table(spark, table):
    assert ledger(table([])).count() == 0
    assert ablations(ledger(table([]))).count() == 0
