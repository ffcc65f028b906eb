"""Calibration fits (J15): isotonic regression by pool-adjacent-violators, and Platt scaling.

Isotonic: equal scores are summed first, then the scores are dealt by range and every partition pools
its own adjacent violators into blocks (lowest score, sum of labels, weight). Pooling blocks again
gives the same fit as pooling all scores, so neighbouring partitions are merged ``FAN`` at a time
until one is left, and only blocks move. What the last round holds are the steps of the fit, the
model itself.

Platt: a and b of 1 / (1 + exp(-(a z + b))) by Newton steps; each is one aggregation of five sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balsam.session import cut_lineage

FAN = 16
_BLOCK = "lo double, y double, w double"


def pool(lo: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, in order of score, pooled until their means rise."""
    out: list[list[float]] = []
    for a, s, n in zip(lo.tolist(), y.tolist(), w.tolist()):
        out.append([a, s, n])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, s, n = out.pop()
            out[-1][1] += s
            out[-1][2] += n
    a, s, n = (np.array(c, float) for c in zip(*out)) if out else (np.zeros(0),) * 3
    return a, s, n


def _pooled(table: pa.Table) -> pa.RecordBatch:
    lo, y, w = (table.column(c).to_numpy() for c in ("lo", "y", "w"))
    order = np.argsort(lo, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array(c) for c in pool(lo[order], y[order], w[order])], names=["lo", "y", "w"])


def isotonic_fit(df: DataFrame, y: str, p: str, weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """The steps (lo, value, w): the calibrated value of scores from ``lo`` up to the next step. Null scores
    or labels are left out."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(p).cast("double").alias("lo"), (F.col(y) * w).cast("double").alias("y"), w.alias("w")) \
        .groupBy("lo").agg(F.sum("y").alias("y"), F.sum("w").alias("w")).filter("w > 0")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield _pooled(pa.Table.from_batches(got))

    # number of the range partition, by which neighbours are merged; written once, since range bounds are sampled
    blocks = cut_lineage(sums.repartitionByRange(n, "lo").mapInArrow(run, _BLOCK).withColumn("part", F.spark_partition_id()))
    while n > 1:
        n = -(-n // FAN)
        blocks = cut_lineage(blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part")
                             .applyInArrow(_merge, f"{_BLOCK}, part int"))
    return blocks.select("lo", (F.col("y") / F.col("w")).alias("value"), "w")


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    done = pa.Table.from_batches([_pooled(table)])
    return done.append_column("part", pa.array([key[0].as_py()] * done.num_rows, pa.int32()))


def isotonic_apply(df: DataFrame, steps: DataFrame, p: str, out: str = "calibrated") -> DataFrame:
    """``df`` with the value of the step that each score falls into (scores below the first step take
    the first value; a null score stays null). The steps are the model and are broadcast."""
    rows = steps.select("lo", "value").toArrow().sort_by("lo")
    shared = df.sparkSession.sparkContext.broadcast((rows.column("lo").to_numpy(), rows.column("value").to_numpy()))

    @F.pandas_udf("double")
    def value(s):
        import pandas as pd
        lo, v = shared.value
        known = s.notna().to_numpy()
        got = np.full(len(s), np.nan)
        if len(lo):
            got[known] = v[np.maximum(np.searchsorted(lo, s.to_numpy()[known], side="right") - 1, 0)]
        return pd.Series(got).where(pd.Series(known), None)

    return df.withColumn(out, value(F.col(p).cast("double")))


def platt_fit(df: DataFrame, y: str, z: str, steps: int = 8, ridge: float = 1e-6) -> tuple[float, float]:
    """(a, b) after so many Newton steps from (0, 0), with ``ridge`` on the diagonal."""
    rows = df.filter(F.col(y).isNotNull() & F.col(z).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    a = b = 0.0
    for _ in range(steps):
        q = platt_apply(F.col("z"), a, b)
        d, h = q - F.col("y"), q * (1 - q)
        r = rows.agg(*[F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in (
            ("ga", d * F.col("z")), ("gb", d), ("aa", h * F.col("z") * F.col("z")), ("ab", h * F.col("z")), ("bb", h))]).first()
        aa, bb, ab = r["aa"] + ridge, r["bb"] + ridge, r["ab"]
        det = aa * bb - ab * ab
        a, b = a - (bb * r["ga"] - ab * r["gb"]) / det, b - (aa * r["gb"] - ab * r["ga"]) / det
    return a, b


def platt_apply(z: Column, a: float, b: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(float(a)) * z + F.lit(float(b)))))
