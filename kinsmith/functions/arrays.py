"""Array expressions that keep order and never fail out of bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def head(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def longest(c: Column) -> Column:
    """The longest string, of equal ones the first in the array; null if empty."""
    return F.aggregate(c, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def without_repeats(c: Column) -> Column:
    """Each run of equal elements once."""
    return F.filter(c, lambda x, i: (i == 0) | (x != F.get(c, i - 1)))


def filled(c: Column) -> Column:
    """Without empty strings."""
    return F.filter(c, lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared of all distinct elements; 0 if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def coverage(a: Column, b: Column) -> Column:
    """Share of b's elements that a has; 0 if b is empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ordered_join(pos: str, value: str, sep: str) -> Column:
    """Aggregate: values of a group in order of pos, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]), sep)


def distinct_join(c: Column, sep: str) -> Column:
    """Aggregate: sorted distinct values of a group, as one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)
