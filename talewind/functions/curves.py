"""Curve expressions: resampling and correlation of velocity curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talewind.functions.text import ColumnOrName, col

CURVE_POINTS = 48
_VARIANCE_FLOOR = 1e-18


def resample_curve(curve: ColumnOrName, points: int = CURVE_POINTS) -> Column:
    """Linear interpolation at ``points`` evenly spaced positions between the first and the last value."""
    arr = col(curve)
    last = F.size(arr) - 1

    def at(i: Column) -> Column:
        position = i * last / (points - 1)
        lower = F.least(F.floor(position).cast("int"), last)
        upper = F.least(lower + 1, last)
        share = position - lower
        return F.get(arr, lower) * (1 - share) + F.get(arr, upper) * share

    return F.when(F.size(arr) > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda a plain expression is computed again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def standardize_curve(curve: ColumnOrName) -> Column:
    """Zero mean, unit length; null for a missing or flat curve. The Pearson correlation of two standardised
    curves is their dot product, so a join on curves needs one pass per pair."""

    def centred(arr: Column) -> Column:
        mean = F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v) / F.size(arr)
        return bind(mean, lambda m: F.transform(arr, lambda v: v - m))

    def scaled(arr: Column) -> Column:
        square = F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v * v)
        return bind(square, lambda q: F.when(q > _VARIANCE_FLOOR, F.transform(arr, lambda v: v / F.sqrt(q))))

    return bind(col(curve), lambda c: bind(centred(c), scaled))


def standardized_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """(Pearson + 1) / 2 of two standardised curves; 0 where either is null."""
    x, y = col(a), col(b)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(F.lit(0.0), (dot + 1) / 2)).otherwise(0.0)


def curve_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """(Pearson + 1) / 2 of the resampled curves; 0 where a curve is missing, empty or flat."""
    left, right = standardize_curve(resample_curve(a)), standardize_curve(resample_curve(b))
    return bind(left, lambda x: bind(right, lambda y: standardized_similarity(x, y)))
