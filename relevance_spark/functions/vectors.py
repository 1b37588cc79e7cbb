"""Vector expressions over array columns; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays zero."""
    # The length is bound once; inside the inner lambda it would be taken anew for every component.
    length = F.array(F.greatest(norm(v), F.lit(FLOOR)))
    return F.element_at(F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def truncated(v: Column, dim: int) -> Column:
    """The first dim components, of unit length again."""
    return unit(F.slice(v, 1, dim))


def is_valid(v: Column, dim: int) -> Column:
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def pooled(states: Column, mask: Column, how: str) -> Column:
    """One vector from an array of vectors and a 0/1 mask: mean, first or last masked position."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["s"])
    if how == "first":
        return F.element_at(states, 1)
    if how == "last":
        return F.element_at(kept, -1)
    if how != "mean":
        raise ValueError(f"unknown pooling: {how}")
    zero = F.transform(F.element_at(states, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))
