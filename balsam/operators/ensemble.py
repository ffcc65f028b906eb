"""Stacking without leakage (J14), hold-outs of whole groups (J17) and cross-validation by time and
group (J11)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.functions.random import uniform
from balsam.operators import train as TR
from balsam.operators.metrics import macro_metrics
from balsam.operators.score import predict_proba
from balsam.operators.split import stratified_kfold
from balsam.session import cut_lineage

#: At most so many groups are larger than a LARGE-th of the rows; these are dealt one by one.
LARGE = 5_000


def _scores(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """(id, target, p_<model>...) of every row, joined by id."""
    parts = [predict_proba(m, df, ["id", "target"]).select("id", "target", F.col("score").alias(f"p_{n}")) for n, m in models.items()]
    return reduce(lambda a, b: a.join(b.drop("target"), "id"), parts)


def _parallel(spark, fn, items: list, at_once: int) -> list:
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))


def out_of_fold(train: DataFrame, models: list[str], k: int = 3, seed: str = "42", at_once: int = 2) -> DataFrame:
    """(id, target, fold, p_<model>...): each row scored by models that were fitted on the other folds.
    Ids must be unique."""
    folded = cut_lineage(stratified_kfold(train, k=k, seed=seed + ":stack"))

    def one(f: int) -> DataFrame:
        rest, mine = folded.filter(F.col("fold") != f).drop("fold"), folded.filter(F.col("fold") == f)
        fitted = {n: TR.fit_pipeline(rest, n) for n in models}
        return _scores(fitted, mine).withColumn("fold", F.lit(f))

    parts = _parallel(train.sparkSession, one, list(range(k)), at_once)
    return cut_lineage(reduce(DataFrame.unionByName, parts))


class Stack:
    """First-level models fitted on all rows, and a logistic regression over their out-of-fold scores."""

    def __init__(self, train: DataFrame, models: list[str], k: int = 3, seed: str = "42"):
        self.names = list(models)
        self.level_one = out_of_fold(train, self.names, k, seed)
        self.meta = TR.fit_pipeline(self._inputs(self.level_one), "lr")
        self.models = {n: TR.fit_pipeline(train, n) for n in self.names}

    def _inputs(self, scores: DataFrame) -> DataFrame:
        return scores.select("id", "target", F.array(*[F.col(f"p_{n}") for n in self.names]).alias("x"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(id, target, prediction, probability, score) of rows (id, x, target)."""
        return predict_proba(self.meta, self._inputs(_scores(self.models, df)), ["id", "target"])


def hold_outs(df: DataFrame, group: str, model: str = "lr", at_once: int = 2) -> DataFrame:
    """Leave one group out: per group the rows in it, macro F1 and accuracy of a model fitted on the
    others, the same of that model on its own training rows, and the gap. Groups are a parameter of the
    study (provinces): one fit each, ``at_once`` at a time on one checkpoint. A group is left out where
    the others have one class only."""
    rows = cut_lineage(df)
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]

    def one(g) -> DataFrame | None:
        mine = rows[group].eqNullSafe(F.lit(g))
        rest, held = rows.filter(~mine), rows.filter(mine)
        if len(rest.select("target").distinct().take(2)) < 2:
            return None
        fitted = TR.fit_pipeline(rest.select("id", "x", "target"), model)
        both = rest.withColumn("part", F.lit("rest")).unionByName(held.withColumn("part", F.lit("held")))
        m = macro_metrics(fitted.transform(both), "target", "prediction", ["part"])
        pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
        return m.agg(pick("held", "n").alias("n"), pick("held", "f1_macro").alias("f1_macro"), pick("held", "accuracy").alias("accuracy"),
                     pick("rest", "f1_macro").alias("f1_rest")) \
            .select(F.lit(g).alias(group), "*", (F.col("f1_rest") - F.col("f1_macro")).alias("gap"))

    found = [r for r in _parallel(df.sparkSession, one, groups, at_once) if r is not None]
    if not found:
        raise ValueError("no group can be held out")
    return reduce(DataFrame.unionByName, found)


def expanding_windows(df: DataFrame, ts: str, cuts: list) -> DataFrame:
    """Temporal cross-validation: for each window i rows before ``cuts[i]`` train and rows from there to
    before ``cuts[i + 1]`` (after the last cut: all) test. Adds ``window`` and ``is_test``; a row is
    in every window that it is not too late for. Rows without a time are in none."""
    ends = [*cuts[1:], None]
    windows = F.array(*[F.struct(F.lit(i).alias("window"), F.lit(a).alias("a"), F.lit(b).cast(df.schema[ts].dataType).alias("b"))
                        for i, (a, b) in enumerate(zip(cuts, ends))])
    each = df.withColumn("__w", F.explode(windows)).filter(F.col(ts).isNotNull() & (F.col("__w.b").isNull() | (F.col(ts) < F.col("__w.b"))))
    return each.withColumn("window", F.col("__w.window")).withColumn("is_test", F.col(ts) >= F.col("__w.a")).drop("__w")


def balanced_group_folds(df: DataFrame, group: str, target: str = "target", k: int = 5, seed: str = "42") -> DataFrame:
    """(group, fold, n, positives): every group in one fold, folds balanced in positives and rows.

    Groups with more than a ``LARGE``-th of the rows, at most that many, are dealt one by one, largest
    first: to the fold with the fewest positives where the group has any, else with the fewest rows; ties
    go to fewer rows, then to the smaller fold. All other groups go, in an order drawn by hash, one fold
    after the other, those with positives by themselves; each is too small to matter."""
    g = cut_lineage(df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(target) == 1).cast("long")).alias("positives"))
                    .withColumn("positives", F.coalesce("positives", F.lit(0))))
    total = g.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") > total // LARGE
    loads = [[0, 0, f] for f in range(k)]
    dealt = []
    for r in g.filter(large).orderBy(F.desc("n"), F.desc("positives"), group).collect():
        best = min(loads, key=lambda v: (v[0], v[1], v[2]) if r["positives"] else (v[1], v[2], v[0]))
        best[0] += r["positives"]
        best[1] += r["n"]
        dealt.append((r[group], best[2]))
    kind = g.schema[group].dataType.simpleString()
    first = F.broadcast(df.sparkSession.createDataFrame(dealt, f"g__ {kind}, fold int"))
    rest = g.filter(~large)
    from balsam.operators.order import positions
    ranked = positions(rest.withColumn("u__", uniform(seed, F.col(group))).withColumn("has__", (F.col("positives") > 0).cast("int")),
                       [F.col("has__"), F.col("u__"), F.col(group)], "pos__")
    small = ranked.select(group, F.pmod("pos__", F.lit(k)).cast("int").alias("fold"), "n", "positives")
    big = g.filter(large).join(first, g[group].eqNullSafe(F.col("g__"))).select(group, "fold", "n", "positives")
    return big.unionByName(small)
