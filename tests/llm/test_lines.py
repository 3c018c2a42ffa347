import random

from hypothesis import given, settings, strategies as st

from letterlens.llm import line_dedup
from letterlens.llm.edit_distance import within
from letterlens.llm.line_dedup import index_keys, line_classes, parity, probe_keys, split_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


edits = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.sampled_from("abcé𝄞")), max_size=5)


def edited(text, changes):
    for kind, at, char in changes:
        at = at % (len(text) + 1)
        text = text[:at] + (char if kind < 2 else "") + text[at + (kind > 0) :]
    return text


@settings(max_examples=600, deadline=None)
@given(st.text("abcé𝄞", max_size=40), edits, st.integers(1, 4))
def test_banded_distance(a, changes, limit):
    b = edited(a, changes)
    assert within(a, b, limit) == (distance(a, b) <= limit)


@settings(max_examples=600, deadline=None)
@given(st.text("abcdefé𝄞", min_size=12, max_size=40), edits, st.integers(1, 3))
def test_no_close_pair_escapes_the_index(a, changes, limit):
    b = edited(a, changes)
    if len(b) < 12 or distance(a, b) > limit:
        return
    short, long = sorted((a, b), key=len)
    assert set(index_keys(short, limit)) & set(probe_keys(long, limit))
    assert ((parity(a) ^ parity(b)) & (2**64 - 1)).bit_count() <= 4 * limit


def test_pieces_are_cut_once_a_length(monkeypatch):
    calls, cuts = [], line_dedup.cuts
    monkeypatch.setattr(line_dedup, "cuts", lambda *a: calls.append(a) or cuts(*a))
    for i in range(1000):
        line = f"{i:04d} the quick brown fox jumps over the lazy dog, again and again"
        assert len(index_keys(line, 2, 41)) == 3 and probe_keys(line, 2, 41)
    assert len(calls) <= 4


def test_parities_of_many_lines():
    lines = ["the quick brown fox", "é", "the quick brown fox", "𝄞bc" * 50, "ab"]
    assert line_dedup.parities(lines).tolist() == [parity(line) for line in lines]


def brute(rows, limit, least):
    first, root = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        for number, line in split_lines(rows[i][1]):
            first.setdefault(line, (i, number))
            root.setdefault(line, line)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lines = list(first)
    rank = {i: n for n, i in enumerate(order)}
    for x, a in enumerate(lines):
        for b in lines[:x]:
            far = abs(len(a) - len(b)) > limit
            if min(len(a), len(b)) >= least and not far and (distance(a, b) if len(a) < 200 else len(b) - len(a)) <= limit:
                root[find(a)] = find(b)
    kept = {}
    for line, (i, number) in first.items():
        kept[find(line)] = min(kept.get(find(line), (rank[i], number)), (rank[i], number))
    chosen = set(kept.values())
    return [
        (rows[i][0], len(split_lines(rows[i][1])), [n for n, _ in split_lines(rows[i][1]) if (rank[i], n) in chosen]) for i in order
    ]


def corpus():
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 50))) for _ in range(25)]
    rows = []
    for i in range(40):
        chosen = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(lines))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                at = rng.randrange(len(line))
                line[at : at + rng.choice((0, 1))] = rng.choice("xyz")
            chosen.append("".join(line))
        rows.append((i, "\n".join(chosen)))
    return rows + [(100, None), (101, ""), (102, "\n \n"), (103, "q" * 60_000 + "\n" + "q" * 60_001)]  # one edit apart


def test_against_all_pairs(spark, table):
    rows = corpus()
    got = line_classes(table(rows), limit=2, least=12)
    assert sorted((r.id, r.n_lines, r.kept_lines) for r in got.collect()) == sorted(brute(rows, 2, 12))


def test_ties_and_nulls(spark, table):
    line = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(4, line + "!"), (4, line + "!"), (None, line), (2, "short\nshort\nshor\n" + line)]
    got = line_classes(table(rows)).collect()
    assert sorted((r.id or -1, r.n_lines, r.n_removed) for r in got) == [(-1, 1, 1), (2, 4, 1), (4, 1, 1), (4, 1, 1)]
    assert line_classes(table([])).count() == 0


def test_short_lines(spark, table):
    """One edit from 12 code points, two from 40, by the length of the shorter line; below 12 equal lines only."""
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n - 2)).join("xy")
    lines = ["Der eingeä erer.", "Der, eingeä erer.", "Thwhesnd esator whshing and hewh.", "Thwhesnd, esator whshing and hewh."]
    for n in (10, 11, 12, 13, 20, 38, 39, 40, 41):
        line = make(n)
        lines += [line, line[:4] + "Z" + line[5:], line[:7] + "ZZ" + line[7:], line[:-2] + line[-1]]
    root = {line: line for line in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            n = min(len(a), len(b))
            if distance(a, b) <= (2 if n >= 40 else 1 if n >= 12 else 0):
                root[find(a)] = find(b)
    seen = set()
    first = [i for i, line in enumerate(lines) if not (find(line) in seen or seen.add(find(line)))]
    got = line_classes(table(list(enumerate(lines)))).where("n_removed = 0").collect()
    assert sorted(r.id for r in got) == first and {0, 2} <= set(first) and not {1, 3} & set(first)
