"""Predicates on keys. A null bound is unbounded; the empty key is a key like any other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(key: Column, lo, hi) -> Column:
    """lo <= key < hi, either bound None for unbounded."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (key >= F.lit(lo))
    if hi is not None:
        cond = cond & (key < F.lit(hi))
    return cond


def covers(lo: Column, hi: Column, key: Column) -> Column:
    """Whether the range [lo, hi) holds key; a null hi is unbounded."""
    return (lo <= key) & (hi.isNull() | (key < hi))
