"""First appearance in row order as a cheap aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_RANGE = 2**31


def first_seen(df: DataFrame, order: list[str]) -> Column:
    """Smallest position of a group in the order of ``order``.

    One column is its own position. A bigint followed by up to two ints (non-negative, as indices are) packs
    exactly into a 38-digit decimal. Both have fixed width, so Spark aggregates them in a hash table; other
    orders fall back to a struct, which it has to sort for.
    """
    if len(order) == 1:
        return F.min(order[0])
    types = [df.schema[name].dataType.simpleString() for name in order]
    if len(order) <= 3 and types[0] in ("int", "bigint") and all(kind == "int" for kind in types[1:]):
        packed = F.col(order[0]).cast("decimal(19,0)")
        for name in order[1:]:
            packed = (packed * F.lit(INT_RANGE).cast("decimal(10,0)") + F.col(name)).cast("decimal(38,0)")
        return F.min(packed)
    return F.min(F.struct(*order))
