"""Exact stratified splits, folds and undersampling (inventory E).

Per-class sizes follow the library rules (test size ceil(f * n), shared out by
largest remainder); which rows go where is decided by u(seed, id), so a run is
reproducible on any partitioning. No step sorts or windows a whole class in one
task: split and undersample use the histogram selection of
:func:`balsam.operators.order.lowest_per_group`; folds need a full rank and use
range-partitioned positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balsam.functions.random import uniform
from balsam.operators.order import lowest_per_group, positions


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))


def allocate(counts: DataFrame, target: str, test_size: float) -> DataFrame:
    """Per-class test counts on the (tiny) class-count table.

    n_test = ceil(f * n), n_train = n - n_test; train shares n_c * n_train / n are
    floored and the remaining rows go to the largest remainders (ties: smaller
    class value first); test = n_c - train.
    """
    w_all = Window.partitionBy()
    c = (counts.withColumn("__n", F.sum("n_c").over(w_all))
         .withColumn("__ntest", F.ceil(F.lit(float(test_size)) * F.col("__n")))
         .withColumn("__ntrain", F.col("__n") - F.col("__ntest"))
         .withColumn("__cont", F.col("n_c").cast("double") * F.col("__ntrain") / F.col("__n"))
         .withColumn("__fl", F.floor("__cont"))
         .withColumn("__rem", F.col("__cont") - F.col("__fl"))
         .withColumn("__need", F.col("__ntrain") - F.sum("__fl").over(w_all))
         .withColumn("__rk", F.row_number().over(Window.orderBy(F.desc("__rem"), F.col(target)))))
    train = F.col("__fl") + F.when(F.col("__rk") <= F.col("__need"), 1).otherwise(0)
    return c.select(target, "n_c", (F.col("n_c") - train).cast("long").alias("k"))


def stratified_split(df: DataFrame, id_col: str = "id", target: str = "target",
                     test_size: float = 0.4, seed: str = "42",
                     out: str = "is_test") -> DataFrame:
    """Add a boolean ``is_test``: per class the k rows with the smallest u(seed, id)."""
    keyed = df.withColumn("__u", uniform(seed, F.col(id_col)))
    return lowest_per_group(keyed, target, "__u", id_col, lambda c: allocate(c, target, test_size), out).drop("__u")


def train_test(df: DataFrame, materialize: bool = True, **kw) -> tuple[DataFrame, DataFrame]:
    """(train, test) parts. The flagged split is checkpointed once (shared folder) so
    the two parts and everything fitted on them do not each re-run the selection."""
    flagged = stratified_split(df, **kw)
    if materialize:
        from balsam.session import cut_lineage
        flagged = cut_lineage(flagged)
    out = kw.get("out", "is_test")
    return flagged.where(~F.col(out)).drop(out), flagged.where(F.col(out)).drop(out)


def stratified_kfold(df: DataFrame, k: int = 5, id_col: str = "id", target: str = "target",
                     seed: str = "42", out: str = "fold") -> DataFrame:
    """fold = (start of the class in class order + rank in class by u - 1) mod k.

    That reproduces the library's fold sizes per class (each class is dealt
    round-robin continuing where the previous class stopped). The rank is a
    range-partitioned position, so a huge class spreads over many tasks.
    """
    keyed = df.withColumn("__u", uniform(seed, F.col(id_col)))
    pos = positions(keyed, [F.col(target), F.col("__u"), F.col(id_col)], "__pos")
    return pos.withColumn(out, F.pmod(F.col("__pos"), F.lit(k)).cast("int")).drop("__u", "__pos")


def fold_guard(folded: DataFrame, fold: str = "fold", target: str = "target") -> DataFrame:
    """Folds whose validation part holds a single class are skipped (flag per fold)."""
    return (folded.groupBy(fold).agg(F.count(F.lit(1)).alias("n"),
                                     F.countDistinct(target).alias("n_classes"))
            .withColumn("usable", F.col("n_classes") >= 2))


def undersample(df: DataFrame, majority: int = 0, size: int = 1000, id_col: str = "id",
                target: str = "target", seed: str = "42", check: bool = True) -> DataFrame:
    """Keep ``size`` majority rows (smallest u) and every other row; raises if the
    majority has fewer rows than ``size`` (the library refuses too)."""
    spark = df.sparkSession
    if check:
        n_maj = df.where(F.col(target) == majority).count()
        if size > n_maj:
            raise ValueError(f"cannot keep {size} rows of class {majority}: only {n_maj}")
    quota = spark.createDataFrame([(int(majority), int(size))], f"{target} int, k long")
    keyed = df.withColumn("__u", uniform(seed, F.col(id_col)))
    sel = lowest_per_group(keyed, target, "__u", id_col, quota, "__keep")
    return sel.where(F.col("__keep") | (F.col(target) != majority)).drop("__u", "__keep")


def temporal_split(df: DataFrame, ts_col: str, cutoff, out: str = "is_test") -> DataFrame:
    """Out-of-time split: rows at or after ``cutoff`` are the test part."""
    return df.withColumn(out, F.coalesce(F.col(ts_col) >= F.lit(cutoff), F.lit(False)))


def grouped_kfold(df: DataFrame, group_col: str, k: int = 5, seed: str = "42",
                  out: str = "fold") -> DataFrame:
    """Every row of a group lands in the same fold: fold = floor(k * u(seed, group))."""
    return df.withColumn(out, F.floor(uniform(seed, F.col(group_col)) * k).cast("int"))
