"""Histograms of frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(h: Column) -> Column:
    total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(h, lambda x: x / total)).otherwise(h)


def intersection(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
