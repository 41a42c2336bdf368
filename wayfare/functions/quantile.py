"""Exact quantiles of many small groups, as column expressions over a sorted array; those of large groups are in ``metrics.quantiles``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_values(c: Column) -> Column:
    """An aggregate: the values of a group in order; nulls do not count."""
    return F.sort_array(F.collect_list(c))


def quantile_of(values: Column | str, q: float) -> Column:
    """The linearly interpolated quantile of a sorted array; null if it is empty."""
    values = F.col(values) if isinstance(values, str) else values
    at = q * (F.size(values) - 1)
    low, high = F.floor(at), F.ceil(at)
    a, b = F.get(values, low.cast("int")), F.get(values, high.cast("int"))
    return F.when(a == b, a).otherwise((high - at) * a + (at - low) * b)
