import numpy as np
import pytest
from pyspark.sql import functions as F

from balsam.operators import metrics as M
from balsam.operators.prep import PopulationScaler, class_weights


def _scored(spark, n=400, seed=0, ties=True):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = rng.normal(size=n) + y
    if ties:
        s = np.round(s, 1)
    p = (s > 0.5).astype(int)
    rows = [(int(i), int(y[i]), int(p[i]), float(s[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, target int, prediction int, score double"), y, p, s


def _sk_roc(y, s, drop=True):
    """The library's ROC definition, spelled out in numpy."""
    o = np.argsort(-s, kind="mergesort")
    ys, ss = y[o], s[o]
    idx = np.r_[np.where(np.diff(ss))[0], len(ss) - 1]
    tps = np.cumsum(ys)[idx]
    fps = 1 + idx - tps
    thr = ss[idx]
    if drop and len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    return np.r_[0, fps], np.r_[0, tps], np.r_[np.inf, thr]


def test_confusion_and_macro(spark):
    df, y, p, _ = _scored(spark)
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df).collect()}
    for a in (0, 1):
        for b in (0, 1):
            assert cm[(a, b)] == int(((y == a) & (p == b)).sum())
    m = M.macro_metrics(df).first()
    f1s, ps, rs = [], [], []
    for c in (0, 1):
        tp = ((y == c) & (p == c)).sum(); pp = (p == c).sum(); sup = (y == c).sum()
        pr = tp / pp if pp else 0.0; rc = tp / sup if sup else 0.0
        f1s.append(2 * pr * rc / (pr + rc) if pr + rc else 0.0); ps.append(pr); rs.append(rc)
    assert m["f1_macro"] == pytest.approx(np.mean(f1s))
    assert m["precision_macro"] == pytest.approx(np.mean(ps))
    assert m["recall_macro"] == pytest.approx(np.mean(rs))
    assert m["accuracy"] == pytest.approx((y == p).mean())


def test_zero_cells_and_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "target int, prediction int")
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert rep[1]["precision"] == 0.0 and rep[1]["f1"] == 0.0


def test_roc_curve_matches_library_definition(spark):
    df, y, _, s = _scored(spark)
    got = M.roc_curve(df).toPandas().sort_values(["fps", "tps", "threshold"], ascending=[True, True, False])
    fps, tps, thr = _sk_roc(y, s)
    assert list(got.fps) == list(fps) and list(got.tps) == list(tps)
    auc_pairs = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert M.roc_auc(df).first()[0] == pytest.approx(auc_pairs)


def test_pr_curve_and_auc(spark):
    df, y, _, s = _scored(spark, ties=False)
    pr = M.pr_curve(df).toPandas()
    assert ((pr.threshold.isna()) & (pr.precision == 1.0) & (pr.recall == 0.0)).sum() == 1
    o = np.argsort(-s)
    tps = np.cumsum(y[o]); fps = np.cumsum(1 - y[o])
    prec = np.r_[1.0, tps / (tps + fps)]; rec = np.r_[0.0, tps / tps[-1]]
    area = np.sum(np.diff(rec) * (prec[1:] + prec[:-1]) / 2)
    assert M.pr_auc(df).first()[0] == pytest.approx(area)


def test_population_scaler(spark):
    rows = [(i, [float(v), 5.0]) for i, v in enumerate([1, 2, 4])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    z = np.array([r["x"] for r in PopulationScaler().fit(df).transform(df).orderBy("id").collect()])
    assert z[:, 0] == pytest.approx((np.array([1, 2, 4]) - 7 / 3) / np.std([1, 2, 4]))
    assert z[:, 1] == pytest.approx([0, 0, 0])  # zero variance -> 0


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "target int")
    w = {r["target"]: r["weight"] for r in class_weights(df).distinct().collect()}
    assert w[0] == pytest.approx(8 / 12) and w[1] == pytest.approx(8 / 4)
