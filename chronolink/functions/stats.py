"""Statistics that return null where they are undefined, and window recipes."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import IDX, UNIT


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null for constants."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def complete(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def by_time(*more: str) -> WindowSpec:
    return Window.partitionBy(UNIT, *more).orderBy(IDX)


def average_rank(order: Column, *by: str) -> Column:
    """Ranks with ties averaged."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(w.partitionBy(*by, order)) - 1) / 2.0


def first_by(by: list, order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
