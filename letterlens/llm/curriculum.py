"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from letterlens.llm.running import totals_before
from letterlens.scale import materialize

WEIGHTS = (1.0, 2.0, 3.0)
REPEATS = 3
# Weight over training time as (time, weight) knots with straight lines between; time runs from 0 to 1. Each source
# takes the schedule with its number, repeating: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The rows (source, source_size, ...) with number and target: all words shared by weight, but no source above
    `repeats` times its own; what is cut off is shared again by weight until none is above.

    The sources that end at their limit are those with the least limit per weight, so one sorted pass finds them. The
    table has one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(repeats))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "number")
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    left = F.sum("source_size").over(everything) - before("most")
    rows = rows.withColumn("level", left / (F.sum("weight").over(everything) - before("weight")))
    first = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(F.col("most") / F.col("weight"), "number", "level")))
    rows = rows.withColumn("level", first.over(everything)["level"])
    target = F.least("most", F.col("level") * F.col("weight"))
    return rows.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("weight", "most", "level")


def time_of(share: Column, number: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source has shown `share` of its words: the inverse of the integral of its schedule."""
    cases = []
    for i, knots in enumerate(schedules):
        areas = [(t1 - t0) * (v0 + v1) / 2 for (t0, v0), (t1, v1) in zip(knots, knots[1:])]
        total, done = sum(areas), 0.0
        for (t0, v0), (t1, v1), area in zip(knots, knots[1:], areas):
            rest = F.greatest(share * total - done, F.lit(0.0))
            slope = (v1 - v0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(v0 * v0) + 2 * slope * rest, F.lit(0.0)))
            inner = F.when(rest <= 0, F.lit(t0)).otherwise(F.least(t0 + 2 * rest / (v0 + root), F.lit(t1)))
            done += area
            cases.append(((number % len(schedules) == i) & (share * total <= done + 1e-12), inner))
    first, *others = cases
    return reduce(lambda c, case: c.when(*case), others, F.when(*first)).otherwise(F.lit(1.0))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, repeats: int = REPEATS,
    schedules=SCHEDULES, place: tuple[str, str] | None = None,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken, positions) for every row.

    A source that must give r times its words shows every document floor(r) times and a share of them once more. That
    share is cut where only documents up to the source's mean size stand, so that its words come close to the target:
    of the larger ones, in order of size, an even share is put before the cut and the rest behind it. positions are the times in training, from 0 to 1, at which the copies
    are shown: the words that the source has shown at the middle of the copy, as a share of all that it shows, through the inverse
    of its cumulative schedule. It shows everything floor(r) times and then the documents that are shown once more, each time in the
    order of a hash of id and text. Null texts and texts without words have size 0 and are not taken; null sources are one
    source; repeated rows count each. `place` names two columns of hashes to be used instead of those of id and text. Reruns agree. Extra columns are ignored."""
    places = place or (F.xxhash64(key, text), F.xxhash64(text, key))
    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.col(source).alias("source"), *(c.alias(name) for c, name in zip(map(_column, places), ("place", "place_too"))),
    )
    rows = materialize(rows, "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean"))
    table = targets(sizes, weights, repeats).withColumn("ratio", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    table = table.withColumn("whole", F.floor("ratio")).withColumn("part", F.col("ratio") - F.col("whole"))
    table = materialize(table.withColumnRenamed("source", "of"), "targets")
    joined = rows.join(table, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumns({"one": F.lit(1).cast("long"), "falling": -F.col("size")})
    by_size = totals_before(joined, "number", ["falling", "place"], "one", "larger")
    drawn = F.floor((F.col("larger") + 1) * F.col("part")) > F.floor(F.col("larger") * F.col("part"))
    sided = by_size.withColumn("side", F.when(F.col("size") <= F.col("mean"), 1).when(drawn, 0).otherwise(2))
    chosen = totals_before(sided, "number", ["side", "place", "size"], "size", "before_cut")
    extra = F.col("before_cut") + F.col("size") / 2.0 < F.col("part") * F.col("source_size")
    again = chosen.withColumn("again", F.when(extra, F.col("size")).otherwise(F.lit(0)))
    ahead = totals_before(
        again, "number", ["place", "size", "again"], "size", "ahead", more={"again_ahead": "again"}, whole={"again_all": "again"}
    )
    all_, whole = F.col("source_size"), F.col("whole")
    copies = F.when(F.col("size") > 0, whole + (F.col("again") > 0).cast("long")).otherwise(F.lit(0)).cast("int")
    shown = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    before = lambda i: all_ * i + F.when(i < whole, F.col("ahead")).otherwise(F.col("again_ahead"))
    total = all_ * whole + F.col("again_all")
    positions = F.transform(
        shown, lambda i: time_of((before(i) + F.col("size") / 2.0) / total, F.col("number"), schedules)
    )
    return ahead.withColumn("copies", copies).select(
        "doc_id", "size", "source", all_.cast("long").alias("source_size"), "target", "copies",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), positions.alias("positions"), "place", "place_too",
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by position in training."""
    return mixed.select("*", F.explode("positions").alias("position")).drop("positions").orderBy("position", "place")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, range-sorted by position in training. Rows are named by two hashes of all
    their columns, so those with one id and different sources or other columns are told apart; rows that agree in every
    column are one and the same, and one of them stands for all copies that they were given together."""
    first, second, position = (_unused(name, docs.columns) for name in ("mix_a", "mix_b", "mix_position"))
    values = [F.to_json(F.struct(f"`{c.name}`")) if "map<" in c.dataType.simpleString() else F.col(f"`{c.name}`") for c in docs.schema]
    # Being never null, the hashes let the join reuse the shuffle that finds repeated rows.
    named = docs.withColumns({first: F.xxhash64(*values), second: F.xxhash64(F.lit(1), *values)})
    shown = mix(named, key, text, source, place=(first, second), **options).select(
        F.col("place").alias(first), F.col("place_too").alias(second), F.explode("positions").alias(position)
    )
    copies = named.dropDuplicates([first, second]).join(shown, [first, second])
    return copies.orderBy(position, first).select([f"`{name}`" for name in docs.columns])


def _unused(name: str, columns: list[str]) -> str:
    taken = {column.lower() for column in columns}
    while name in taken:
        name = f"_{name}"
    return name
