import random

from letterlens import scale
from letterlens.llm import cotrain, graph, jaccard, running
from letterlens.llm.jaccard import jaccard_components, one_per_group
from letterlens.scale import materialize


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, size=5):
    found = words(text)
    if not found:
        return frozenset()
    width = min(size, len(found))
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def brute(rows):
    """component by index of row"""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= 80 * (len(a) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    lowest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lowest[find(i)] = min(key, lowest.get(find(i), key))
    return sorted(
        ((key, len(a), key if not a else lowest.get(find(i))) for i, ((key, _), a) in enumerate(zip(rows, sets))), key=repr
    )


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    common = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows = []
    for group in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.choice((1, 1, 2, 6))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), (common + " " if rng.random() < 0.4 else "") + " ".join(copy)))
    return rows


def found(df):
    return sorted(((r["id"], r["n"], r["component"]) for r in df.collect()), key=repr)


def test_against_all_pairs(spark, table):
    rows = corpus(1) + corpus(2)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    long = " ".join(f"t{i % 977}x{i // 7}" for i in range(30_000))
    rows += [
        (900, None), (901, ""), (902, " \t\n"), (903, "One TWO"), (904, "one two"), (None, rows[0][1]), (None, "only null ids here now"),
        (905, rows[3][1]), (905, rows[3][1]), (906, long), (907, long + " end"), (908, "one two"), (909, "éa b c d e"), (910, "Éa b c d e"),
    ]
    assert found(jaccard_components(table(rows))) == brute(rows)


def test_empty_table(spark, table):
    assert jaccard_components(table([])).count() == 0
    assert one_per_group(table([])).count() == 0


def test_one_per_group(spark, table):
    text = " ".join(f"a{i}" for i in range(60))
    near = text.replace("a30", "b30", 1) + " x"
    rows = [(5, text), (3, near), (3, near), (9, "other words in here"), (None, text), (7, None), (8, ""), (7, None)]
    kept = sorted(((r.doc_id, r.text) for r in one_per_group(table(rows)).collect()), key=repr)
    assert kept == sorted([(3, near), (9, "other words in here"), (7, None), (7, None), (8, "")], key=repr)
    assert one_per_group(table(rows)).columns == table(rows).columns


def test_large_group_is_not_compared_pair_by_pair(spark, table, monkeypatch):
    """Copies altered in places of their own: most are no leader's neighbours, and many pairs of them do not link."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 401):
        copy = list(base)
        for place in rng.sample(range(120), 2):
            copy[place] = f"x{i}y{place}"
        rows.append((i, " ".join(copy)))
    compared, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    assert found(jaccard_components(table(rows))) == brute(rows)
    assert sum(compared) < 40 * len(rows)


def test_tables_in_between_are_discarded(spark, table, monkeypatch, tmp_path):
    kept = set()
    for module in (jaccard, graph):
        monkeypatch.setattr(module, "materialize", lambda df, label, **options: kept.add(label) or materialize(df, label, **options))
    monkeypatch.setattr(scale, "scratch_dir", lambda spark: str(tmp_path))
    text = " ".join(f"a{i}" for i in range(60))
    one_per_group(table([(5, text), (3, text + " x"), (4, text + " y"), (9, "other words in here")])).collect()
    left = {path.name.rsplit("-", 1)[0] for path in (tmp_path / "letterlens").iterdir()}
    assert {"shingles", "nodes", "lists", "sets", "pairs", "links", "wanted", "close", "components"} <= kept - left


def test_narrow_tables_are_stored_in_few_files(spark, table, monkeypatch):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    most, files = max(10, 2 * spark.sparkContext.defaultParallelism), {}

    def counted(df, label, **options):
        stored = materialize(df, label, **options)
        files[label] = max(files.get(label, 0), len(stored.inputFiles()))
        return stored

    monkeypatch.setattr(graph, "materialize", counted)
    monkeypatch.setattr(jaccard, "materialize", counted)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 160)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rng = random.Random(5)
        rows = [(2 * i + j, f"{text}{' end' * j}") for i in range(150) for text in [" ".join(str(rng.random()) for _ in range(40))] for j in (0, 1)]
        found = {r.id: r.component for r in jaccard_components(table(rows)).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == {i: i - i % 2 for i in range(300)}
    assert {k: n for k, n in files.items() if n > most}.keys() <= {"shingles", "nodes", "lists", "sets", "close"}


def test_tables_of_wide_shuffles_are_stored_in_few_files(spark, table, monkeypatch):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    most, files = 2 * spark.sparkContext.defaultParallelism, {}

    def counted(df, label, **options):
        stored = materialize(df, label, **options)
        files[label] = max(files.get(label, 0), len(stored.inputFiles()))
        return stored

    for module in (jaccard, cotrain, running):
        monkeypatch.setattr(module, "materialize", counted)
    rng = random.Random(5)
    texts = [" ".join(str(rng.random()) for _ in range(40)) for _ in range(60)]
    rows = [(2 * i + j, f"{text}{' end' * j}") for i, text in enumerate(texts) for j in (0, 1)]
    words = spark.createDataFrame([([i, 2000 + i // 2], i % 2, -1) for i in range(2000)], "words array<long>, text_low int, text_toxic int")
    sums = spark.createDataFrame([(i % 3 // 2, i, 1) for i in range(2000)], "number int, at int, one long")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        components = {r.id: r.component for r in jaccard_components(table(rows)).collect()}
        counts = {r.word: r.seen_low for r in cotrain.word_counts(words).collect()}
        before = {(r.number, r["at"]): r.before for r in running.totals_before(sums, "number", ["at"], "one", "before").collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert components == {i: i - i % 2 for i in range(120)}
    assert counts == {None: 2000, **{i: 1 + (i >= 2000) for i in range(3000)}}
    at = {0: 0, 1: 0}
    for i in range(2000):
        number = i % 3 // 2
        assert before[number, i] == at[number]
        at[number] += 1
    assert {"nodes", "lists", "sets", "close", "words", "slices"} <= files.keys()
    assert {k: n for k, n in files.items() if n > most}.keys() <= {"shingles"}
