"""Plans for evaluation tables (I) and result tables.

Metrics need no trained model: the "models" here are fixed rules on embedding
coordinates (predict 1 when x[d] > 0), so every table is exact and has a SQL
oracle. Cross-validation follows the reference's flow: exact stratified split,
stratified folds on the training part, per-fold metrics on the validation part,
metrics of each model on the untouched test part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from balsam.operators import metrics as M
from balsam.operators import split
from balsam.plans.registry import query
from balsam.plans.sql import E, U, split_flags
from balsam.sources.tables import embedding_set

SEED = "42"
RULE_DIMS = [0, 1, 2]
K = 3


def _r(c):
    return F.round(F.col(c).cast("double"), 6).alias(c)


def _scored(spark, sf):
    """Scores at full precision on half the rows, with ties on the others."""
    e = embedding_set(spark, sf)
    return e.select("id", "target", (F.col("x")[0] > 0).cast("int").alias("prediction"),
                    F.when(F.col("id") % 2 == 0, F.col("x")[0]).otherwise(F.round(F.col("x")[0], 2) + F.lit(0.0)).alias("score"))


_SCORED = f"(SELECT id, target, CAST(x[1] > 0 AS INTEGER) AS prediction, CASE WHEN id % 2 = 0 THEN x[1] ELSE round(x[1], 2) + 0.0 END AS score FROM {E})"


def macro_sql(rel: str, g: list[str]) -> str:
    """Grouped macro metrics over a relation with (g..., target, prediction)."""
    gp = "".join(f"{c}, " for c in g)
    on = " AND ".join([f"lab.{c} = p.{c}" for c in g] + ["TRUE"])
    gsel = "".join(f"lab.{c}, " for c in g)
    return f"""(WITH p AS {rel},
lab AS (SELECT DISTINCT {gp}l FROM (SELECT {gp}target AS l FROM p UNION ALL SELECT {gp}prediction FROM p)),
per AS (SELECT {gsel}lab.l,
          count(*) FILTER (WHERE p.target = lab.l AND p.prediction = lab.l) AS tp,
          count(*) FILTER (WHERE p.target = lab.l) AS sup,
          count(*) FILTER (WHERE p.prediction = lab.l) AS pp
        FROM lab JOIN p ON {on} GROUP BY {gsel}lab.l)
SELECT {gp}avg(CASE WHEN sup + pp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (sup + pp) END) AS f1_macro,
  avg(CASE WHEN pp = 0 THEN 0.0 ELSE tp::DOUBLE / pp END) AS precision_macro,
  avg(CASE WHEN sup = 0 THEN 0.0 ELSE tp::DOUBLE / sup END) AS recall_macro,
  sum(tp)::DOUBLE / sum(sup) AS accuracy, CAST(sum(sup) AS BIGINT) AS n
FROM per GROUP BY ALL)"""


@query("confusion_matrix", f"""WITH p AS {_SCORED},
lab AS (SELECT target AS l FROM p UNION SELECT prediction FROM p)
SELECT t.l AS y_true, q.l AS y_pred,
  CAST((SELECT count(*) FROM p WHERE p.target = t.l AND p.prediction = q.l) AS BIGINT) AS n
FROM lab t, lab q""")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(_scored(spark, sf), "target", "prediction")


@query("classification_report", f"""WITH p AS {_SCORED},
lab AS (SELECT target AS l FROM p UNION SELECT prediction FROM p),
per AS (SELECT l, count(*) FILTER (WHERE target = l AND prediction = l) AS tp,
   count(*) FILTER (WHERE target = l) AS sup, count(*) FILTER (WHERE prediction = l) AS pp FROM lab, p GROUP BY l)
SELECT l AS label, round(CASE WHEN pp = 0 THEN 0 ELSE tp::DOUBLE / pp END, 6) AS precision,
  round(CASE WHEN sup = 0 THEN 0 ELSE tp::DOUBLE / sup END, 6) AS recall,
  round(CASE WHEN sup + pp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (sup + pp) END, 6) AS f1,
  CAST(sup AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, CAST(pp AS BIGINT) AS predicted FROM per""")
def q_classification_report(spark, sf):
    r = M.classification_report(_scored(spark, sf), "target", "prediction")
    return r.select("label", _r("precision"), _r("recall"), _r("f1"), "support", "tp", "predicted")


_MACRO_COLS = ("f1_macro", "precision_macro", "recall_macro", "accuracy")


@query("macro_metrics", f"""SELECT round(f1_macro, 6) AS f1_macro, round(precision_macro, 6) AS precision_macro,
  round(recall_macro, 6) AS recall_macro, round(accuracy, 6) AS accuracy, n FROM {macro_sql(_SCORED, [])}""")
def q_macro_metrics(spark, sf):
    m = M.macro_metrics(_scored(spark, sf), "target", "prediction")
    return m.select(*[_r(c) for c in _MACRO_COLS], "n")


_CURVE_BASE = f"""WITH g AS (SELECT score, sum(target) AS pos, sum(1 - target) AS neg FROM {_SCORED} GROUP BY score),
c AS (SELECT score, pos, neg,
  sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
  row_number() OVER (ORDER BY score DESC) - 1 AS idx,
  lead(pos) OVER (ORDER BY score DESC) AS npos, lead(neg) OVER (ORDER BY score DESC) AS nneg,
  count(*) OVER () AS m, sum(pos) OVER () AS tp_all, sum(neg) OVER () AS tn_all FROM g)"""


@query("roc_curve", f"""{_CURVE_BASE}
SELECT 'inf'::DOUBLE AS threshold, 0::BIGINT AS fps, 0::BIGINT AS tps, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT score, CAST(fps AS BIGINT), CAST(tps AS BIGINT), round(fps::DOUBLE / tn_all, 6), round(tps::DOUBLE / tp_all, 6)
FROM c WHERE m <= 2 OR idx = 0 OR idx = m - 1 OR npos <> pos OR nneg <> neg""")
def q_roc_curve(spark, sf):
    r = M.roc_curve(_scored(spark, sf), "target", "score")
    return r.select("threshold", "fps", "tps", _r("fpr"), _r("tpr"))


@query("roc_auc", f"""{_CURVE_BASE}
SELECT round(sum(neg * (2 * tps - pos))::DOUBLE / (2.0 * max(tp_all) * max(tn_all)), 6) AS roc_auc FROM c""")
def q_roc_auc(spark, sf):
    return M.roc_auc(_scored(spark, sf), "target", "score").select(_r("roc_auc"))


@query("pr_curve", f"""{_CURVE_BASE}
SELECT score AS threshold, round(tps::DOUBLE / (tps + fps), 6) AS precision, round(tps::DOUBLE / tp_all, 6) AS recall FROM c
UNION ALL SELECT NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE""")
def q_pr_curve(spark, sf):
    r = M.pr_curve(_scored(spark, sf), "target", "score")
    return r.select("threshold", _r("precision"), _r("recall"))


@query("pr_auc", f"""{_CURVE_BASE}
SELECT round(sum(pos * (tps::DOUBLE / (tps + fps) + CASE WHEN tps - pos + fps - neg = 0 THEN 1.0
   ELSE (tps - pos)::DOUBLE / (tps - pos + fps - neg) END) / 2.0) / max(tp_all), 6) AS pr_auc FROM c""")
def q_pr_auc(spark, sf):
    return M.pr_auc(_scored(spark, sf), "target", "score").select(_r("pr_auc"))


@query("log_loss", f"""SELECT round(avg(-ln(least(greatest(CASE WHEN target = 1 THEN p ELSE 1 - p END, 1e-15), 1 - 1e-15))), 6) AS loss,
  round(avg(CASE WHEN (CASE WHEN p > 1 - p THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM (SELECT target, 1.0 / (1.0 + exp(-5.0 * x[1])) AS p FROM {E})""")
def q_log_loss(spark, sf):
    """Loss and accuracy of a probability vector (any scored set)."""
    e = embedding_set(spark, sf)
    p = 1.0 / (1.0 + F.exp(-5.0 * F.col("x")[0]))
    s = e.select("target", F.array(1.0 - p, p).alias("probability"))
    return M.log_loss(s, "target", "probability").select(_r("loss"), _r("accuracy"))


# ------------------------------------------------------------------ CV result tables

def _rule_predictions(df, dims=RULE_DIMS, threshold=0.0):
    """Long form (model, ...) with one prediction per rule model."""
    models = F.array(*[F.struct(F.lit(f"dim{d}").alias("model"),
                                (F.col("x")[d] > threshold).cast("int").alias("prediction")) for d in dims])
    return df.select("*", F.explode(models).alias("m")).select("*", "m.model", "m.prediction").drop("m", "x")


def _cv_frames(spark, sf, threshold=0.0):
    e = embedding_set(spark, sf)
    flagged = split.stratified_split(e, test_size=0.4, seed=SEED)
    train = flagged.where(~F.col("is_test")).drop("is_test")
    test = flagged.where(F.col("is_test")).drop("is_test")
    folded = split.stratified_kfold(train, k=K, seed=SEED + ":cv")
    fold_m = M.macro_metrics(_rule_predictions(folded, threshold=threshold), "target", "prediction",
                             ["model", "fold"])
    test_m = M.macro_metrics(_rule_predictions(test, threshold=threshold), "target", "prediction", ["model"])
    return fold_m, test_m


def _results(spark, sf, threshold=0.0):
    fold_m, test_m = _cv_frames(spark, sf, threshold)
    cv = M.cv_summary(fold_m)
    t = test_m.select("model", F.col("f1_macro").alias("test_f1_macro"), F.col("accuracy").alias("test_accuracy"),
                      F.col("precision_macro").alias("test_precision"), F.col("recall_macro").alias("test_recall"))
    return cv.join(t, "model").select("model", *[_r(c) for c in M.RESULT_METRICS])


def _sql_frames(threshold=0.0):
    rel = split_flags(E, 0.4, SEED)
    folded = f"""(SELECT id, target, x, CAST((row_number() OVER (ORDER BY target, {U(SEED + ':cv', 'id')}, id) - 1) % {K} AS INTEGER) AS fold
  FROM {rel} WHERE NOT is_test)"""
    rules = " UNION ALL ".join(
        f"SELECT *, 'dim{d}' AS model, CAST(x[{d + 1}] > {threshold!r} AS INTEGER) AS prediction FROM {{src}}"
        for d in RULE_DIMS)
    fold_p = "(" + rules.format(src=folded) + ")"
    test_p = "(" + rules.format(src=f"(SELECT * FROM {rel} WHERE is_test)") + ")"
    return macro_sql(fold_p, ["model", "fold"]), macro_sql(test_p, ["model"])


def _results_sql(threshold=0.0):
    fm, tm = _sql_frames(threshold)
    return f"""(SELECT cv.model, round(cv.cv_score, 6) AS cv_score, round(cv.f1_macro, 6) AS f1_macro,
  round(cv.accuracy, 6) AS accuracy, round(cv.precision, 6) AS precision, round(cv.recall, 6) AS recall,
  round(t.f1_macro, 6) AS test_f1_macro, round(t.accuracy, 6) AS test_accuracy,
  round(t.precision_macro, 6) AS test_precision, round(t.recall_macro, 6) AS test_recall
FROM (SELECT model, avg(f1_macro) AS cv_score, avg(f1_macro) AS f1_macro, avg(accuracy) AS accuracy,
        avg(precision_macro) AS precision, avg(recall_macro) AS recall FROM {fm} GROUP BY model) cv
JOIN {tm} t ON cv.model = t.model)"""


_FM_SQL, _TM_SQL = _sql_frames()


@query("fold_metrics", f"""SELECT model, fold, round(f1_macro, 6) AS f1_macro, round(precision_macro, 6) AS precision_macro,
  round(recall_macro, 6) AS recall_macro, round(accuracy, 6) AS accuracy, n FROM {_FM_SQL}""")
def q_fold_metrics(spark, sf):
    fm, _ = _cv_frames(spark, sf)
    return fm.select("model", "fold", *[_r(c) for c in _MACRO_COLS], "n")


@query("cv_summary", f"""SELECT model, round(avg(f1_macro), 6) AS cv_score, round(avg(accuracy), 6) AS accuracy,
  CAST(count(*) AS BIGINT) AS n_folds FROM {_FM_SQL} GROUP BY model""")
def q_cv_summary(spark, sf):
    fm, _ = _cv_frames(spark, sf)
    return M.cv_summary(fm).select("model", _r("cv_score"), _r("accuracy"), "n_folds")


@query("best_fold", f"""SELECT model, CAST(arg_max(fold, (f1_macro, -fold)) AS INTEGER) AS best_fold,
  round(max(f1_macro), 6) AS best_score FROM {_FM_SQL} GROUP BY model""")
def q_best_fold(spark, sf):
    fm, _ = _cv_frames(spark, sf)
    return M.best_fold(fm).select("model", "best_fold", _r("best_score"))


@query("results_table", f"SELECT * FROM {_results_sql()}")
def q_results_table(spark, sf):
    return _results(spark, sf)


@query("best_model", f"SELECT model, cv_score, test_f1_macro FROM {_results_sql()} ORDER BY cv_score DESC, model LIMIT 1")
def q_best_model(spark, sf):
    return M.best_model(_results(spark, sf), "cv_score").select("model", "cv_score", "test_f1_macro")


@query("compare_models", f"SELECT model, test_f1_macro FROM {_results_sql()}")
def q_compare_models(spark, sf):
    return M.compare_models(_results(spark, sf), "test_f1_macro")


@query("cv_vs_test", f"SELECT model, cv_score, test_f1_macro, round(cv_score - test_f1_macro, 6) AS gap FROM {_results_sql()}")
def q_cv_vs_test(spark, sf):
    r = M.cv_vs_test(_results(spark, sf))
    return r.withColumn("gap", F.round("gap", 6))


@query("metrics_long", f"""SELECT model, metric, value FROM (UNPIVOT {_results_sql()}
  ON test_f1_macro, test_accuracy, test_precision, test_recall INTO NAME metric VALUE value)""")
def q_metrics_long(spark, sf):
    return M.metrics_long(_results(spark, sf))


@query("combine_results", f"""WITH u AS (SELECT 'rule_gt_0' AS run, * FROM {_results_sql(0.0)}
  UNION ALL SELECT 'rule_gt_0.05' AS run, * FROM {_results_sql(0.05)})
SELECT run, model, cv_score, test_f1_macro,
  (row_number() OVER (ORDER BY cv_score DESC, run, model)) = 1 AS is_best FROM u""")
def q_combine_results(spark, sf):
    """Results of two runs in one table, with the best (run, model) pair flagged."""
    a = _results(spark, sf, 0.0).withColumn("run", F.lit("rule_gt_0"))
    b = _results(spark, sf, 0.05).withColumn("run", F.lit("rule_gt_0.05"))
    u = a.unionByName(b)
    best = M.best_model(u, "cv_score", order_col="run").select("run", "model", F.lit(True).alias("is_best"))
    return (u.join(F.broadcast(best), ["run", "model"], "left")
            .select("run", "model", "cv_score", "test_f1_macro",
                    F.coalesce("is_best", F.lit(False)).alias("is_best")))
