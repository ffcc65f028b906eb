"""Exact evaluation tables (inventory I).

Everything is an aggregation over (label, prediction) or (label, score); curve
prefix sums go through :func:`balsam.operators.order.running_totals`, never a
single-partition window over the scored rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balsam.operators.order import running_totals


def _literal(v):
    """Python value (scalar, Row, list) -> literal Column."""
    from pyspark.sql import Row
    if isinstance(v, Row):
        return F.struct(*[_literal(x).alias(k) for k, x in v.asDict().items()])
    if isinstance(v, (list, tuple)):
        return F.array(*[_literal(x) for x in v])
    return F.lit(v)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the values of a one-row aggregate to every row as literals.

    The aggregate is collected (one row by construction, checked), so no join —
    in particular no nested-loop / cartesian join — appears in the plan."""
    rows = one_row.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("attach() expects a one-row DataFrame")
    types = {f.name: f.dataType for f in one_row.schema.fields}
    vals = rows[0].asDict(recursive=False) if rows else {c: None for c in one_row.columns}
    return df.select("*", *[(_literal(v) if v is not None else F.lit(None)).cast(types[c]).alias(c)
                            for c, v in vals.items()])


def _keys(group_cols) -> list[str]:
    return list(group_cols or [])


def confusion_matrix(df: DataFrame, y: str = "target", pred: str = "prediction",
                     group_cols: list[str] | None = None) -> DataFrame:
    """(group..., y_true, y_pred, n) including zero cells; labels = union of true and
    predicted labels (per group). The label grid is built by exploding the
    collected label set, which is bounded by the number of classes."""
    g = _keys(group_cols)
    counts = (df.groupBy(*g, F.col(y).cast("int").alias("y_true"), F.col(pred).cast("int").alias("y_pred"))
              .agg(F.count(F.lit(1)).alias("n")))
    labels = (counts.select(*g, F.col("y_true").alias("l"))
              .unionByName(counts.select(*g, F.col("y_pred").alias("l")))
              .groupBy(*g).agg(F.array_sort(F.collect_set("l")).alias("ls")))
    grid = (labels.select(*g, F.explode("ls").alias("y_true"), "ls")
            .select(*g, "y_true", F.explode("ls").alias("y_pred")))
    return (grid.join(counts, [*g, "y_true", "y_pred"], "left")
            .select(*g, "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def class_stats(df: DataFrame, y: str = "target", pred: str = "prediction",
                group_cols: list[str] | None = None) -> DataFrame:
    """(group..., label, support, predicted, tp) in ONE aggregation: every row adds a
    record for its true label and one for its predicted label, so the label set is
    the union of both and map-side combine leaves one row per class per task."""
    g = _keys(group_cols)
    yt, yp = F.col(y).cast("int"), F.col(pred).cast("int")
    roles = F.array(
        F.struct(yt.alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"), (yt == yp).cast("int").alias("t")),
        F.struct(yp.alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))
    return (df.select(*g, F.explode(roles).alias("__r"))
            .groupBy(*g, F.col("__r.label").alias("label"))
            .agg(F.sum("__r.s").cast("long").alias("support"), F.sum("__r.p").cast("long").alias("predicted"),
                 F.sum("__r.t").cast("long").alias("tp")))


def classification_report(df: DataFrame, y: str = "target", pred: str = "prediction",
                          group_cols: list[str] | None = None) -> DataFrame:
    """Per class: precision, recall, f1, support; zero denominators give 0."""
    g = _keys(group_cols)
    per = class_stats(df, y, pred, g)
    return per.select(*g, "label",
                      _safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
                      _safe_div(F.col("tp"), F.col("support")).alias("recall"),
                      _safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
                      "support", "tp", "predicted")


def macro_metrics(df: DataFrame, y: str = "target", pred: str = "prediction",
                  group_cols: list[str] | None = None) -> DataFrame:
    """Macro F1 / precision / recall and accuracy (per group)."""
    g = _keys(group_cols)
    rep = classification_report(df, y, pred, g)
    return rep.groupBy(*g).agg(
        F.avg("f1").alias("f1_macro"), F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.sum("support").cast("long").alias("n"))


def log_loss(df: DataFrame, y: str, proba: str, eps: float = 1e-15,
             group_cols: list[str] | None = None) -> DataFrame:
    """Average -ln p(true class) and accuracy of argmax, for any scored set."""
    g = _keys(group_cols)
    p_true = F.element_at(F.col(proba), F.col(y).cast("int") + 1)
    p = F.least(F.greatest(p_true, F.lit(eps)), F.lit(1 - eps))
    pred = (F.array_position(F.col(proba), F.array_max(F.col(proba))) - 1).cast("int")
    return df.groupBy(*g).agg(F.avg(-F.log(p)).alias("loss"),
                              F.avg((pred == F.col(y)).cast("double")).alias("accuracy"))


# ---------------------------------------------------------------- curves

def _score_table(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score: map-side combined aggregation."""
    return (df.groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.sum(F.col(y).cast("long")).alias("pos"),
                 F.sum(1 - F.col(y).cast("long")).alias("neg")))


def _cumulated(df: DataFrame, y: str, score: str) -> DataFrame:
    """Distinct scores, descending, with inclusive cumulative tps/fps and a 0-based index."""
    s = _score_table(df, y, score).withColumn("one", F.lit(1).cast("long"))
    return (running_totals(s, [F.desc("score")], ["pos", "neg", "one"], ["tps", "fps", "idx"])
            .withColumn("idx", F.col("idx") - 1))


def _totals(cum: DataFrame) -> DataFrame:
    return cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("M"))


def roc_curve(df: DataFrame, y: str = "target", score: str = "score",
              drop_intermediate: bool = True) -> DataFrame:
    """ROC points (threshold, fps, tps, fpr, tpr), thresholds descending, starting at
    (+inf, 0, 0). ``drop_intermediate`` drops a point whose step equals the next
    point's step (collinear, equal spacing), as the library does by default."""
    cum = _cumulated(df, y, score)
    tot = _totals(cum)
    pts = attach(cum, tot)
    if drop_intermediate:
        nxt = cum.select((F.col("idx") - 1).alias("idx"), F.col("pos").alias("npos"), F.col("neg").alias("nneg"))
        pts = pts.join(nxt, "idx", "left")
        keep = ((F.col("M") <= 2) | (F.col("idx") == 0) | (F.col("idx") == F.col("M") - 1)
                | (F.col("npos") != F.col("pos")) | (F.col("nneg") != F.col("neg")))
        pts = pts.where(keep)
    start = tot.select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("fps"),
                       F.lit(0).cast("long").alias("tps"), "P", "N")
    body = pts.select(F.col("score").alias("threshold"), "fps", "tps", "P", "N")
    allp = start.unionByName(body)
    return allp.select("threshold", "fps", "tps",
                       F.when(F.col("N") > 0, F.col("fps") / F.col("N")).alias("fpr"),
                       F.when(F.col("P") > 0, F.col("tps") / F.col("P")).alias("tpr"))


def roc_auc(df: DataFrame, y: str = "target", score: str = "score") -> DataFrame:
    """Trapezoid area under the ROC curve (ties handled as a diagonal step)."""
    cum = _cumulated(df, y, score)
    tot = _totals(cum)
    area = cum.agg(F.sum(F.col("neg") * (2 * F.col("tps") - F.col("pos"))).alias("twice"))
    return (attach(area, tot)
            .select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                           F.col("twice") / (2.0 * F.col("P") * F.col("N"))).alias("roc_auc")))


def pr_curve(df: DataFrame, y: str = "target", score: str = "score") -> DataFrame:
    """(threshold, precision, recall): one point per distinct score plus the final
    (recall 0, precision 1) point with a null threshold. No-positive input gives
    recall 1 everywhere, as the library does."""
    cum = _cumulated(df, y, score)
    tot = _totals(cum)
    pts = attach(cum, tot)
    rec = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tps") / F.col("P"))
    body = pts.select(F.col("score").alias("threshold"),
                      _safe_div(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
                      rec.alias("recall"))
    end = tot.select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"))
    return body.unionByName(end)


def pr_auc(df: DataFrame, y: str = "target", score: str = "score") -> DataFrame:
    """Trapezoid area under the PR curve over recall, including the (0, 1) end point."""
    cum = _cumulated(df, y, score)
    tot = _totals(cum)
    prev_t = F.col("tps") - F.col("pos")
    prev_f = F.col("fps") - F.col("neg")
    p = F.col("tps") / (F.col("tps") + F.col("fps"))
    p_prev = F.when(prev_t + prev_f == 0, F.lit(1.0)).otherwise(prev_t / (prev_t + prev_f))
    area = cum.agg(F.sum(F.col("pos") * (p + p_prev) / 2.0).alias("s"))
    return (attach(area, tot)
            .select(F.when(F.col("P") > 0, F.col("s") / F.col("P")).alias("pr_auc")))


# ---------------------------------------------------------------- results tables

RESULT_METRICS = ["cv_score", "f1_macro", "accuracy", "precision", "recall",
                  "test_f1_macro", "test_accuracy", "test_precision", "test_recall"]


def cv_summary(fold_metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Mean of per-fold metrics; cv_score is the mean fold macro F1."""
    return fold_metrics.groupBy(model_col).agg(
        F.avg("f1_macro").alias("cv_score"), F.avg("f1_macro").alias("f1_macro"),
        F.avg("accuracy").alias("accuracy"), F.avg("precision_macro").alias("precision"),
        F.avg("recall_macro").alias("recall"), F.count(F.lit(1)).alias("n_folds"))


def best_fold(fold_metrics: DataFrame, model_col: str = "model", fold_col: str = "fold",
              score: str = "f1_macro") -> DataFrame:
    """Fold with the best score per model; first (lowest fold) on ties."""
    best = F.max_by(F.struct(F.col(score).alias("s"), (-F.col(fold_col)).alias("nf")),
                    F.struct(F.col(score), -F.col(fold_col)))
    return (fold_metrics.groupBy(model_col).agg(best.alias("b"))
            .select(model_col, (-F.col("b.nf")).cast("int").alias("best_fold"), F.col("b.s").alias("best_score")))


def best_model(results: DataFrame, metric: str = "cv_score", model_col: str = "model",
               order_col: str | None = None) -> DataFrame:
    """First maximum of ``metric`` (ties: earliest by ``order_col`` if given, then model name)."""
    ties = [F.col(order_col)] if order_col else []
    return results.orderBy(F.desc_nulls_last(metric), *ties, F.col(model_col)).limit(1)


def compare_models(results: DataFrame, metric: str = "cv_score", model_col: str = "model"):
    """(model, metric); an unknown metric lists the available ones and returns None."""
    if metric not in results.columns:
        avail = [c for c in results.columns
                 if any(x in c for x in ("f1", "accuracy", "precision", "recall", "cv_score"))]
        warnings.warn(f"Metric '{metric}' not found. Available: {avail}")
        return None
    return results.select(model_col, metric)


def cv_vs_test(results: DataFrame, model_col: str = "model") -> DataFrame:
    return results.select(model_col, "cv_score", "test_f1_macro",
                          (F.col("cv_score") - F.col("test_f1_macro")).alias("gap"))


def metrics_long(results: DataFrame, model_col: str = "model",
                 metrics: list[str] = ("test_f1_macro", "test_accuracy", "test_precision", "test_recall")) -> DataFrame:
    """Test metrics in long form (model, metric, value); only those present."""
    present = [m for m in metrics if m in results.columns]
    if not present:
        raise ValueError("no test metrics found")
    return results.select(model_col, *[F.col(m).cast("double") for m in present]).unpivot(
        [model_col], present, "metric", "value")
