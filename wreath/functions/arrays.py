"""Array (list column) helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile(arr: Column, n: int) -> Column:
    """The array repeated ``n`` times end to end (numpy ``tile`` of a 1-D series)."""
    return F.flatten(F.array_repeat(arr, n))


def first_where(arr: Column, pred) -> Column:
    """First element satisfying ``pred``, null when none."""
    return F.get(F.filter(arr, pred), 0)
