"""Names that do not collide."""

from pyspark.sql import DataFrame, functions as F

from letterlens.functions.names import numbered_name
from letterlens.scale import materialize, ordered_rank

NUMBERED = r"^(.*)_(\d{3,})(\.[^.]*)$"


def unique_names(rows: DataFrame, keys: list[str], base: str, prior: DataFrame | None = None) -> DataFrame:
    """(keys, base, file_name, collision): the first use of a name keeps it, later ones get _001,
    _002 and so on, in key order. Names of an earlier run (prior, column filename) count as taken.

    A numbered name that a message bears itself is a taken slot of the name without the number, so
    one ranked pass hands out the free slots and no name is tried twice.
    """
    wanted = materialize(rows.select(*keys, F.col(base).alias("wanted")), "names")
    ranks = ordered_rank(wanted, ["wanted"], keys, "nth")
    zero = F.lit(0).cast("bigint")
    if prior is None:
        placed = ranks.withColumn("taken", zero)
    else:
        placed = ranks.join(_taken_before(prior), "wanted", "left").withColumn("taken", F.coalesce("taken", zero))
    placed = placed.withColumn("in_line", F.col("taken") + F.col("nth") - 1)
    number = F.when(F.col("in_line") == 0, zero).otherwise(F.col("in_line") + F.col("passed"))
    return _slots_passed(materialize(placed, "in-line"), wanted).withColumn("number", number).select(
        *keys, F.col("wanted").alias("base"), numbered_name(F.col("wanted"), F.col("number")).alias("file_name"),
        (F.col("number") > 0).alias("collision"),
    )


def _slots_passed(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """placed with the number of own slots that each row in line steps over.

    The i-th own slot s of a name (from 0) moves on all rows whose place in line is s - i or more. Rows and slots are put
    in one order by that value and ranked together, in range slices; a row's rank less its rank among rows is the number of slots
    before it. So neither slots nor rows of a name are ever gathered."""
    taken = placed.groupBy("wanted").agg(F.max("taken").alias("taken"))
    slots = _own_slots(wanted).join(taken, "wanted").filter(F.col("slot") >= F.greatest("taken", F.lit(1)))
    slots = materialize(slots.select("wanted", "slot"), "slots")
    if slots.isEmpty():
        return placed.withColumn("passed", F.lit(0).cast("bigint"))
    steps = ordered_rank(slots, ["wanted"], ["slot"], "i").select(
        "wanted", (F.col("slot") - F.col("i") + 1).alias("value"), F.lit(0).alias("kind"), F.col("i").alias("tie")
    )
    families = slots.select("wanted").distinct()
    rows = placed.join(families, "wanted", "left_semi").select("wanted", F.col("in_line").alias("value"), F.lit(1).alias("kind"), F.col("nth").alias("tie"))
    ranked = ordered_rank(rows.unionByName(steps), ["wanted"], ["value", "kind", "tie"], "at").filter("kind = 1")
    passed = ranked.select("wanted", F.col("tie").alias("nth"), (F.col("at") - F.col("tie")).alias("passed"))
    return placed.join(passed, ["wanted", "nth"], "left").withColumn("passed", F.coalesce("passed", F.lit(0).cast("bigint")))


def _family(name) -> list:
    return [
        F.regexp_replace(name, NUMBERED, "$1$3").alias("wanted"),
        F.regexp_extract(name, NUMBERED, 2).cast("bigint").alias("slot"),
    ]


def _own_slots(wanted: DataFrame) -> DataFrame:
    """(wanted, slot): the numbers of a name that messages bear as their own names."""
    own = wanted.select("wanted").distinct()
    numbered = own.filter(F.col("wanted").rlike(NUMBERED)).select(F.col("wanted").alias("own"), *_family(F.col("wanted")))
    numbered = numbered.filter(numbered_name(F.col("wanted"), F.col("slot")) == F.col("own"))
    return numbered.join(own, "wanted", "left_semi").select("wanted", "slot")


def _taken_before(prior: DataFrame) -> DataFrame:
    """(wanted, taken): how many names of each family an earlier run has used up: x.eml, x_001.eml, ..."""
    name = F.col("filename")
    own = prior.select(name.alias("wanted"), F.lit(0).cast("bigint").alias("slot"))
    family = prior.filter(name.rlike(NUMBERED)).select(*_family(name))
    return own.unionByName(family).groupBy("wanted").agg((F.max("slot") + 1).alias("taken"))


def failure_names(failed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file_name): failed_email_0001.eml and so on, in key order."""
    ranks = ordered_rank(failed, [], keys, "nth")
    return ranks.select(*keys, F.format_string("failed_email_%04d.eml", F.col("nth")).alias("file_name"))
