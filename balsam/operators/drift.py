"""Drift of columns between periods (J20): population stability index and Jensen-Shannon divergence.

Categories are compared by their exact counts. A numeric column keeps one mergeable quantile sketch per
period; the cuts are the base period's quantiles, and the shares between cuts come from the sketches'
ranks, so that all columns and periods take one pass, and sketches of new rows can be merged later
without reading the old ones.

Shares are smoothed by ``EPS`` before logarithms. Null values are a category of their own ('' for
strings is another); null numbers are left out. A period without rows does not occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
NULL = "(null)"
#: Size of a sketch: the error of a rank is about 1.65 / SKETCH.
SKETCH = 800


def _measures(p: Column, q: Column) -> tuple[Column, Column]:
    """Terms of both measures for the shares of the base (p) and of the period (q)."""
    a, b = p + EPS, q + EPS
    m = (a + b) / 2
    return (b - a) * F.log(b / a), (a * F.log(a / m) + b * F.log(b / m)) / 2


def category_drift(df: DataFrame, columns: list[str], period: str, base) -> DataFrame:
    """(column, period, psi, js) of every other period against ``base``."""
    cells = df.select(F.col(period).alias("period"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias("value")) for c in columns])).alias("s")) \
        .select("period", "s.*").filter("period is not null")
    n = cells.groupBy("column", "period", "value").agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("column", "period").agg(F.sum("n").alias("size"))
    share = n.join(size, ["column", "period"]).select("column", "period", "value", (F.col("n") / F.col("size")).alias("share"))
    first = share.filter(F.col("period") == F.lit(base)).select("column", "value", F.col("share").alias("p"))
    # every value of a period or of the base, with 0 where it does not occur
    others = size.filter(F.col("period") != F.lit(base)).select("column", "period")
    keys = others.join(first.select("column", "value"), "column").unionByName(
        share.filter(F.col("period") != F.lit(base)).select("column", "period", "value")).distinct()
    both = keys.join(first, ["column", "value"], "left").join(share, ["column", "period", "value"], "left")
    psi, js = _measures(F.coalesce("p", F.lit(0.0)), F.coalesce("share", F.lit(0.0)))
    return both.groupBy("column", "period").agg(F.sum(psi).alias("psi"), F.sum(js).alias("js"))


def sketches(df: DataFrame, columns: list[str], period: str) -> DataFrame:
    """(column, period, n, sketch): one mergeable quantile sketch for each column and period."""
    cells = df.select(F.col(period).alias("period"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")) \
        .select("period", "s.*").filter("period is not null and v is not null and not isnan(v)")
    return cells.groupBy("column", "period").agg(F.count(F.lit(1)).alias("n"), F.expr(f"kll_sketch_agg_double(v, {SKETCH})").alias("sketch"))


def merged(*parts: DataFrame) -> DataFrame:
    """Sketches of several sets of rows as those of all their rows."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("column", "period").agg(F.sum("n").alias("n"), F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def numeric_drift(found: DataFrame, base, bins: int = 10) -> DataFrame:
    """(column, period, n, psi, js) of every other period of the sketches against ``base``."""
    at = ", ".join(f"{j / bins}D" for j in range(1, bins))
    first = found.filter(F.col("period") == F.lit(base))
    # a rank needs its cuts as constants: (columns x bins) numbers come to the driver
    cuts = {r["column"]: sorted(set(r["cuts"])) for r in first.select(
        "column", F.expr(f"kll_sketch_get_quantile_double(sketch, array({at}))").alias("cuts")).collect()}
    out = None
    for c, values in sorted(cuts.items()):
        ranks = F.expr(f"kll_sketch_get_rank_double(sketch, array({', '.join(f'{v!r}D' for v in values)}))")
        edges = F.concat(F.array(F.lit(0.0)), ranks, F.array(F.lit(1.0)))
        n = len(values) + 1
        share = F.zip_with(F.slice(edges, 2, n), F.slice(edges, 1, n), lambda b, a: b - a)
        one = found.filter(F.col("column") == c).withColumn("share", share)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = found.limit(0).withColumn("share", F.array().cast("array<double>"))
    p = out.filter(F.col("period") == F.lit(base)).select("column", F.col("share").alias("p"))
    rows = out.filter(F.col("period") != F.lit(base)).join(p, "column") \
        .select("column", "period", "n", F.explode(F.arrays_zip("p", F.col("share").alias("q"))).alias("s"))
    psi, js = _measures(F.col("s.p"), F.col("s.q"))
    return rows.groupBy("column", "period", "n").agg(F.sum(psi).alias("psi"), F.sum(js).alias("js"))
