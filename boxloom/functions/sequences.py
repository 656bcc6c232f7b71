"""Functions over arrays: edit distance, first largest entry, lookups with a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and changes that turn array a into array b; null if either is null.

    A fold over a: each step makes the next row of the table of distances from the last one.
    """
    first = F.sequence(F.lit(0), F.size(b))

    def row(last: Column, x: Column) -> Column:
        def cell(out: Column, j: Column) -> Column:
            change = F.get(last, j) + F.when(F.get(b, j).eqNullSafe(x), 0).otherwise(1)
            drop = F.get(last, j + 1) + 1
            return F.concat(out, F.array(F.least(change, drop, F.get(out, j) + 1)))

        steps = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(steps, F.array(F.get(last, F.lit(0)) + 1), cell)

    return F.when(a.isNotNull() & b.isNotNull(), F.element_at(F.aggregate(a, first, row), -1))


def arg_max(values: Column) -> Column:
    """Position from 0 of the first largest value; null for an empty array."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)) - 1)


def look_up(mapping: dict, key: Column, default) -> Column:
    """The value of key in a small mapping, else the default."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))
