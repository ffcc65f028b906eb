"""Majority and stratified baselines (README-declared, J12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balsam.functions.random import uniform
from balsam.operators.metrics import attach


def class_priors(train: DataFrame, target: str = "target") -> DataFrame:
    """One row: array<struct<cls, cum>> of cumulative class shares (class order)."""
    c = train.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(target).rowsBetween(Window.unboundedPreceding, 0)
    c = c.select(F.col(target).alias("cls"), "n", F.sum("n").over(w).alias("cum"),
                 F.sum("n").over(Window.partitionBy()).alias("tot"))
    return c.agg(F.array_sort(F.collect_list(F.struct("cls", (F.col("cum") / F.col("tot")).alias("cum"))))
                 .alias("__priors"),
                 F.max_by("cls", F.struct("n", -F.col("cls"))).alias("__major"))


def baseline_majority(train: DataFrame, test: DataFrame, target: str = "target",
                      out: str = "prediction") -> DataFrame:
    """Predict the most frequent training class (smallest class on ties)."""
    return attach(test, class_priors(train, target).select("__major")).withColumnRenamed("__major", out)


def baseline_stratified(train: DataFrame, test: DataFrame, id_col: str = "id",
                        target: str = "target", seed: str = "42",
                        out: str = "prediction") -> DataFrame:
    """Draw a class per row with the training priors: first class whose cumulative
    share exceeds u(seed, id)."""
    u = uniform(seed, F.col(id_col))
    pick = F.filter(F.col("__priors"), lambda s: s["cum"] > u)
    res = attach(test, class_priors(train, target).select("__priors"))
    return (res.withColumn(out, F.coalesce(pick[0]["cls"], F.element_at("__priors", -1)["cls"]).cast("int"))
            .drop("__priors"))
