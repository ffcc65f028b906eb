import math

import numpy as np
import pytest

from balsam.operators import drift as D


def measures(p, q):
    a, b = np.asarray(p) + D.EPS, np.asarray(q) + D.EPS
    m = (a + b) / 2
    return float(((b - a) * np.log(b / a)).sum()), float((a * np.log(a / m) + b * np.log(b / m)).sum() / 2)


def test_numeric_drift_from_sketches(spark):
    rng = np.random.default_rng(0)
    data = {1: rng.normal(size=6000), 2: rng.normal(size=5000), 3: rng.normal(0.8, 1.5, 4000)}
    df = spark.createDataFrame([(p, float(v), float(i % 3)) for p, x in data.items() for i, v in enumerate(x)] + [(1, None, None), (None, 1.0, 1.0)],
                               "period int, v double, few double").repartition(6)
    whole = D.sketches(df, ["v", "few"], "period")
    parts = D.merged(D.sketches(df.filter("v < 0"), ["v", "few"], "period"), D.sketches(df.filter("v >= 0"), ["v", "few"], "period"))
    cuts = np.quantile(data[1], np.arange(1, 10) / 10)
    share = lambda x: np.diff(np.concatenate([[0], [(x <= c).mean() for c in cuts], [1]]))
    for found in (whole, parts):
        got = {(r["column"], r["period"]): r for r in D.numeric_drift(found, 1).collect()}
        assert set(got) == {("v", 2), ("v", 3), ("few", 2), ("few", 3)}
        for p in (2, 3):
            psi, js = measures(share(data[1]), share(data[p]))
            r = got["v", p]
            assert r["n"] == len(data[p]) and r["psi"] == pytest.approx(psi, abs=0.03) and r["js"] == pytest.approx(js, abs=0.01)
        assert got["v", 3]["psi"] > 0.3 > 0.02 > got["v", 2]["psi"] and got["few", 3]["psi"] < 0.01


def test_category_drift(spark):
    rows = [("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 5 + [("b", None)] * 5 + [("c", "x")] * 3 + [("c", "y")] * 1 + [(None, "x")]
    df = spark.createDataFrame(rows, "period string, v string")
    got = {r["period"]: (r["psi"], r["js"]) for r in D.category_drift(df, ["v"], "period", "a").collect()}
    assert got["b"] == pytest.approx(measures([0.75, 0.25, 0], [0.5, 0, 0.5]))
    assert got["c"] == pytest.approx((0, 0), abs=1e-12) and set(got) == {"b", "c"}
    assert 0 < got["b"][1] < math.log(2)
    assert D.category_drift(df.limit(0), ["v"], "period", "a").count() == 0
