import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from letterlens.llm.curriculum import SCHEDULES, mix, repeated, targets, time_of, training_order


def slow_targets(sizes):
    """Share by weight, stop at three times the size, share the excess again until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    capped, left = {}, dict.fromkeys(names)
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        total = sum(weight[n] for n in left)
        over = [n for n in left if rest * weight[n] / total > 3 * sizes[n]] if left else []
        if not over:
            return capped | {n: rest * weight[n] / total for n in left}
        for n in over:
            capped[n] = 3.0 * sizes[n]
            del left[n]


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "é": 2, "Z": 5, None: 30}, {"a": 5}, {"x": 0, "y": 7, "z": 1}, {None: 4, "q": 4000, "r": 1, "s": 1, "t": 900},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    for name, target in slow_targets(sizes).items():
        assert got[name] == pytest.approx(target)


def test_time_inverts_the_integral(spark):
    def share(knots, time):
        done = total = 0.0
        for (t0, v0), (t1, v1) in zip(knots, knots[1:]):
            total += (t1 - t0) * (v0 + v1) / 2
            x = min(max(time - t0, 0.0), t1 - t0)
            done += v0 * x + (v1 - v0) / (t1 - t0) * x * x / 2
        return done / total

    rows = [(i, i % 3, k / 40, share(SCHEDULES[i % 3], k / 40)) for k in range(41) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, number int, time double, share double")
    for r in df.withColumn("got", time_of(F.col("share"), F.col("number"))).collect():
        assert r.got == pytest.approx(r.time, abs=1e-6)


def documents():
    out = [(i, "word " * (i % 37 + 1), f"s{i % 4}") for i in range(400)]
    out += [(1000 + i, "big " * 300, "hot") for i in range(300)] + [(2000, None, "hot"), (2001, "", None), (2002, " \n", "s1"), (2003, "x y", None)]
    return out + [(None, "no id", "s1"), (5, "twice two", "s1"), (5, "twice two", "s1")]


def test_mix(spark, table):
    rows = documents()
    got = mix(table(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
    words = defaultdict(int)
    for _, text, source in rows:
        words[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert dict(sizes) == dict(words)
    for name, target in slow_targets(sizes).items():
        assert abs(taken[name] - target) <= largest[name]
    assert sorted(map(repr, got)) == sorted(map(repr, mix(table(rows)).collect()))


def test_order_and_repeats(spark, table):
    rows = documents()
    mixed = mix(table(rows))
    order = [r.position for r in training_order(mixed).collect()]
    assert order == sorted(order) and len(order) == sum(r.copies for r in mixed.collect())
    out = repeated(table(rows))
    assert out.columns == table(rows).columns
    assert out.count() == len(order)


def test_rows_that_differ_in_other_columns_stay(spark):
    rows = [(1, "one two three", "x", "p", {"k": 1}), (1, "one two three", "y", "q", {"k": 2}), (1, "one two three", "x", "r", {}), (None, "four five", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_a string, `a.b` map<string, int>")
    mixed = {(r.doc_id, r.source, r.copies) for r in mix(docs).collect()}
    out = repeated(docs)
    assert out.columns == docs.columns
    got = {tuple(r) for r in out.select("doc_id", "source", "mix_a").collect()}
    assert got <= {(r[0], r[2], r[3]) for r in rows} and {row[:2] for row in got} == {(i, s) for i, s, n in mixed if n}
    assert {"q"} <= {row[2] for row in got}


def test_even_schedule_shows_the_mix_at_any_time(spark, table):
    flat = [(((0.0, 1.0), (1.0, 1.0)))]
    shown = training_order(mix(table(documents()), schedules=flat)).where("position < 0.5").groupBy("source").agg(F.sum("size").alias("words"))
    half = {r.source: r.words for r in shown.collect()}
    for r in mix(table(documents())).select("source", "target").distinct().collect():
        assert r.target == 0 or abs(half.get(r.source, 0) - r.target / 2) < max(600, 0.1 * r.target)


def test_empty_table(spark, table):
    assert mix(table([])).count() == 0
    assert repeated(table([])).count() == 0


def test_positions_follow_the_words_that_are_shown(spark, table):
    """A source that shows a part of its documents, or a part once more, shows them over the whole time, as its schedule says."""
    rows = [(i, "word " * (i * 7 % 90 + 1), f"s{i % 6}") for i in range(1800)]
    rows += [(None, "no id", "s0"), (7, "twice two", "s0"), (7, "twice two", "s0"), (9000, None, "s0"), (9001, "alone " * 50, "s6"), (9002, " ", "s7"), (9003, "null source", None)]
    mixed = mix(table(rows)).collect()
    numbers = {name: i for i, name in enumerate(["s0", "s1", "s2", "s3", "s4", "s5", "s6", "s7", None])}
    assert {r.source for r in mixed if r.source_size and r.target % r.source_size > 0} >= {"s0", "s1", "s2", "s3", "s4", "s5"}

    def share(knots, time):
        done = total = 0.0
        for (t0, v0), (t1, v1) in zip(knots, knots[1:]):
            total += (t1 - t0) * (v0 + v1) / 2
            x = min(max(time - t0, 0.0), t1 - t0)
            done += v0 * x + (v1 - v0) / (t1 - t0) * x * x / 2
        return done / total

    for name, number in numbers.items():
        copies = sorted((p, r.size) for r in mixed if r.source == name for p in r.positions)
        taken, done = sum(size for _, size in copies), 0
        assert taken == sum(r.taken for r in mixed if r.source == name)
        for position, size in copies:
            assert share(SCHEDULES[number % 3], position) == pytest.approx((done + size / 2) / taken, abs=1e-6)
            done += size
