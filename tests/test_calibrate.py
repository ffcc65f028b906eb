import numpy as np
import pytest
from pyspark.sql import functions as F

from balsam.operators import calibrate as C
from balsam.operators import ensemble as EN
from balsam.operators import train as TR
from balsam.operators.features import ece
from balsam.operators.score import predict_proba
from balsam.operators.split import stratified_kfold


def max_min(p, y):
    """Isotonic fit by its max-min formula, for each different score."""
    order = np.argsort(p, kind="stable")
    u, at = np.unique(p[order], return_index=True)
    s = np.add.reduceat(y[order], at)
    n = np.diff(np.append(at, len(p)))
    cs, cn = np.append(0, np.cumsum(s)), np.append(0, np.cumsum(n))
    mean = lambda a, b: (cs[b + 1] - cs[a]) / (cn[b + 1] - cn[a])
    return dict(zip(u, [max(min(mean(a, b) for b in range(i, len(u))) for a in range(i + 1)) for i in range(len(u))]))


@pytest.mark.parametrize("parts, fan", [(1, 16), (7, 2), (20, 3)])
def test_isotonic_matches_the_max_min_formula(spark, monkeypatch, parts, fan):
    monkeypatch.setattr(C, "FAN", fan)
    rng = np.random.default_rng(parts)
    p = np.round(rng.random(150), 2)
    y = (rng.random(150) < 0.5 + 0.4 * np.sin(5 * p)).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)] + [(None, 1), (0.5, None)], "p double, y int")
    steps = C.isotonic_fit(df, "y", "p", partitions=parts)
    values = [r["value"] for r in steps.orderBy("lo").collect()]
    assert all(a < b for a, b in zip(values, values[1:]))
    got = {(r["p"], r["calibrated"]) for r in C.isotonic_apply(df, steps, "p").collect()}
    want = max_min(p, y)
    assert (None, None) in got
    assert all(c == pytest.approx(want[q]) for q, c in got if q is not None)
    assert C.isotonic_fit(df.limit(0), "y", "p").count() == 0


def test_calibration_lowers_the_error_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z - 1)))
    df = spark.createDataFrame([(i, float(a), float(1 / (1 + np.exp(-3 * a))), int(b)) for i, (a, b) in enumerate(zip(z, y))], "id long, z double, p double, y int")
    fit, test = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    raw = ece(test, "y", "p").first()[0]
    a, b = C.platt_fit(fit, "y", "z")
    assert a == pytest.approx(0.5, abs=0.1) and b == pytest.approx(-1, abs=0.15)
    platt = ece(test.withColumn("q", C.platt_apply(F.col("z"), a, b)), "y", "q").first()[0]
    iso = ece(C.isotonic_apply(test, C.isotonic_fit(fit, "y", "p"), "p", "q"), "y", "q").first()[0]
    assert platt < raw / 3 and iso < raw / 3
    grad = fit.agg(F.sum((C.platt_apply(F.col("z"), a, b) - F.col("y")) * F.col("z")), F.sum(C.platt_apply(F.col("z"), a, b) - F.col("y"))).first()
    assert all(abs(v) < 1e-2 for v in grad)  # the optimum


def _rows(spark, n=240):
    rng = np.random.default_rng(1)
    y = (rng.random(n) < 0.4).astype(int)
    x = rng.normal(size=(n, 3)) + y[:, None]
    return spark.createDataFrame([(i, r.tolist(), int(t), "abc"[i % 3], None) for i, (r, t) in enumerate(zip(x, y))],
                                 "id long, x array<double>, target int, province string, other string")


def test_stacking_scores_come_from_other_folds(spark):
    df = _rows(spark).select("id", "x", "target")
    oof = EN.out_of_fold(df, ["lr"], k=2)
    assert oof.count() == 240
    folded = stratified_kfold(df, k=2, seed="42:stack")
    for f in (0, 1):
        model = TR.fit_pipeline(folded.filter(f"fold <> {f}").drop("fold"), "lr")
        want = {r["id"]: r["score"] for r in predict_proba(model, folded.filter(f"fold = {f}"), ["id"]).collect()}
        got = {r["id"]: r["p_lr"] for r in oof.filter(f"fold = {f}").collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_hold_outs(spark):
    got = EN.hold_outs(_rows(spark), "province").collect()
    assert sorted(r["province"] for r in got) == ["a", "b", "c"] and all(r["n"] == 80 for r in got)
    assert all(r["f1_macro"] > 0.6 and r["gap"] == pytest.approx(r["f1_rest"] - r["f1_macro"]) for r in got)
    with pytest.raises(ValueError):
        EN.hold_outs(_rows(spark), "other")


def test_group_folds_are_balanced(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"g{g}", int(rng.random() < 0.1)) for g in range(60) for _ in range(int(rng.integers(1, 40)))] + [(None, 1)] * 9
    df = spark.createDataFrame(rows, "g string, target int")
    for large in (EN.LARGE, 40, 1):
        monkeypatch.setattr(EN, "LARGE", large)
        got = EN.balanced_group_folds(df, "g", k=4).collect()
        assert len(got) == 61 and sum(r["n"] for r in got) == len(rows)
        size, pos = ([sum(r[c] for r in got if r["fold"] == f) for f in range(4)] for c in ("n", "positives"))
        assert max(pos) - min(pos) <= (max(r["positives"] for r in got) if large > 100 else sum(pos))
        assert min(size) > 0
    assert EN.balanced_group_folds(df.limit(0), "g").count() == 0
