"""Totals over earlier rows of a group, for groups of any size."""

from pyspark.sql import DataFrame, Window, functions as F

from letterlens.scale import few_dealt, materialize


def totals_before(
    df: DataFrame, group: str, order: list[str], weight: str, name: str, more: dict[str, str] | None = None,
    whole: dict[str, str] | None = None,
) -> DataFrame:
    """df with the sum of `weight` over the earlier rows of the same group (0 for the first). `more` and `whole` name further
    sums as {name: weight}: over the same earlier rows, and over all rows of the group.

    Rows are cut into slices by range over group and order, so a group that holds most rows spreads over many tasks; each
    slice is summed by itself and the slices before it are added. Rows that are equal in group and order follow each
    other in any order. The slices are written once, since both uses must see the same cut."""
    before, whole = {name: weight, **(more or {})}, whole or {}
    sliced = few_dealt(df.repartitionByRange(group, *order).withColumn("slice", F.spark_partition_id()))
    sliced = materialize(sliced, "slices")
    within = Window.partitionBy(group, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(group)
    offsets = sliced.groupBy(group, "slice").agg(*(F.sum(w).alias(w) for w in dict.fromkeys([*before.values(), *whole.values()])))
    offsets = offsets.select(
        group, "slice", F.struct(*(F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(n) for n, w in before.items())).alias("earlier"),
        *(F.sum(w).over(everything).alias(n) for n, w in whole.items()),
    )
    inner = sliced.withColumns({n: F.coalesce(F.sum(w).over(within), F.lit(0)) for n, w in before.items()})
    totals = {n: F.col(n) + F.col("earlier")[n] for n in before}
    return inner.join(offsets, [group, "slice"]).withColumns(totals).drop("slice", "earlier")
