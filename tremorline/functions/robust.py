"""Robust statistics and small regressions as Column expressions; null is missing and never NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Scale of the median absolute deviation that estimates a standard deviation of normal data.
MAD = 1.4826


def median(column: Column | str) -> Column:
    """The middle value by linear interpolation; usable as an aggregate and over a frame."""
    return F.percentile(column, 0.5)


def array_median(values: Column) -> Column:
    """The median of an array's non-null elements; null if it has none."""
    kept = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(kept)
    return F.when(n > 0, (F.get(kept, F.floor((n - 1) / 2).cast("int")) + F.get(kept, F.floor(n / 2).cast("int"))) / 2)


def array_mad(values: Column) -> Column:
    """Scaled median absolute deviation of an array."""
    centre = array_median(values)
    return MAD * array_median(F.transform(values, lambda x: F.abs(x - centre)))


def theil_sen(xs: Column, ys: Column) -> Column:
    """Median of the slopes of all pairs with increasing x; null without such a pair."""
    at = F.sequence(F.lit(0), F.size(xs) - 1)

    def slopes(i: Column) -> Column:
        rise = F.transform(at, lambda j: F.when(F.get(xs, j) > F.get(xs, i), (F.get(ys, j) - F.get(ys, i)) / (F.get(xs, j) - F.get(xs, i))))
        return F.filter(rise, lambda s: s.isNotNull())

    return F.when(F.size(xs) > 1, array_median(F.flatten(F.transform(at, slopes))))


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), column))


def finite(column: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def parsed_double(text: Column) -> Column:
    """A number as Python would read it, else null (Java's type suffixes are not numbers)."""
    return F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))
