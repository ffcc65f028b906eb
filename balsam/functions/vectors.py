"""Array<double> expressions (kept JVM-side; no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lerp(a: Column, b: Column, t: Column) -> Column:
    """a + t * (b - a), element-wise."""
    return F.zip_with(a, b, lambda x, y: x + t * (y - x))


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2norm(a: Column) -> Column:
    return F.sqrt(vsum(F.transform(a, lambda v: v * v)))


def _bcast(value: Column, like: Column) -> Column:
    """A scalar repeated to the length of ``like``: lets a lambda see a per-row
    scalar as its own argument instead of re-evaluating an outer expression."""
    return F.array_repeat(value, F.size(like))


def scale(a: Column, s: Column) -> Column:
    """a / s element-wise for a per-row scalar s."""
    return F.zip_with(a, _bcast(s, a), lambda v, d: v / d)


def softmax(logits: Column) -> Column:
    """Numerically stable softmax of an array column."""
    ex = F.zip_with(logits, _bcast(F.array_max(logits), logits), lambda v, m: F.exp(v - m))
    return _normalise_sum(ex)


def _normalise_sum(ex: Column) -> Column:
    return scale(ex, vsum(ex))


def argmax(a: Column) -> Column:
    """0-based index of the maximum; lowest index on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
