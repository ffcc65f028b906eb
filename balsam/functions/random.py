"""Deterministic uniform draws u(seed, key) in [0, 1).

Every random choice in the library (split, folds, undersampling, synthetic
points, bootstrap weights) is a pure function of a seed string and a row key,
so results do not depend on partitioning, task order or retries, and the same
number can be computed by any SQL engine with md5:

    u = int(first 13 hex digits of md5(seed || ':' || key)) / 2**52
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(seed, key) -> Column:
    """Column expression u(seed, key); ``key`` is a column name or Column."""
    k = _col(key).cast("string")
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), k))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO_POW_52))


def uniform_value(seed: str, key) -> float:
    """u(seed, key) of one key, as a number."""
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / TWO_POW_52
