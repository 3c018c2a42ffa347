"""Array helpers used by the matching functions."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, where a lambda body would compute it per element."""
    return F.transform(F.array(value), body)[0]


def running_starts(steps: Column) -> Column:
    """For bigint steps [a, b, c] the running totals before each one: [0, a, a + b].

    Totals are built block by block, so that a long array is not copied once per element.
    """

    def in_blocks(values: Column) -> Column:
        count = F.size(values)
        numbers = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(
            F.slice(F.flatten(_carry(blocks)), F.lit(1), count)
        )

    return let(steps, in_blocks)


def _carry(blocks: Column) -> Column:
    def with_bases(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return let(
            _scan(sums, F.lit(0).cast("bigint")),
            lambda bases: F.transform(
                parts,
                lambda p, i: let(_scan(p, bases[i]), lambda s: F.slice(s, F.lit(1), F.size(p))),
            ),
        )

    return let(blocks, with_bases)


def _scan(values: Column, base: Column) -> Column:
    """[base, base + v1, base + v1 + v2, ...]: one element more than values."""
    return F.aggregate(
        values,
        F.array(base),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )


def first_per_key(items: Column, key: str, order: list[str]) -> Column:
    """Of an array of structs, the first one per key value, in the given order.

    Sorting instead of a not-yet-seen test keeps long arrays out of quadratic time.
    """
    by_key = F.sort_array(
        F.transform(items, lambda x: F.struct(x[key].alias("k"), *[x[c].alias(c) for c in order], x.alias("item")))
    )
    firsts = let(
        by_key,
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"])),
    )
    in_order = F.sort_array(
        F.transform(firsts, lambda x: F.struct(*[x[c].alias(c) for c in order], x["item"].alias("item")))
    )
    return F.transform(in_order, lambda x: x["item"])
