import numpy as np
import pytest
from pyspark.sql import functions as F

from balsam.operators import resample as RS
from balsam.operators.knn import knn, knn_approx


def _vecs(spark, n=300, d=8, pos=40, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    y = np.zeros(n, dtype=int)
    y[rng.choice(n, pos, replace=False)] = 1
    X[y == 1] += 1.0
    rows = [(int(i), X[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x array<double>, target int"), X, y


def _brute(X, ids, k):
    out = {}
    for i in range(len(X)):
        d2 = ((X - X[i]) ** 2).sum(1)
        d2[i] = np.inf
        order = np.lexsort((ids, d2))[:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def _as_lists(df):
    out = {}
    for r in df.orderBy("q_id", "rank").collect():
        out.setdefault(r["q_id"], []).append(r["nn_id"])
    return out


@pytest.mark.parametrize("options", [{}, {"strategy": "broadcast"}, {"cells": 1, "block_rows": 64}, {"cells": 40, "block_rows": 7}])
def test_knn_exact(spark, options):
    df, X, _ = _vecs(spark)
    X[250:] = X[:50]  # ties
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, x array<double>")
    assert _as_lists(knn(df, df, 5, **options)) == _brute(X, np.arange(len(X)), 5)


def test_knn_edges(spark):
    df, X, _ = _vecs(spark, n=6, pos=2)
    none = df.limit(0)
    assert knn(df, none, 3).count() == 0 and knn(none, df, 3).count() == 0
    assert knn(df, df, 9).count() == 6 * 5  # fewer rows than k
    with pytest.raises(ValueError):
        knn(df, df, 3, strategy="other")
    names = df.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "x")
    got = _as_lists(knn(names, names, 2))
    assert got == {f"r{q}": [f"r{n}" for n in ns] for q, ns in _brute(X, np.arange(6), 2).items()}


def test_knn_on_clusters_looks_at_few_pairs(spark):
    from balsam.operators.knn import CellIndex, _prep
    rng = np.random.default_rng(3)
    X = rng.normal(size=(1500, 6)) * 0.05 + rng.integers(0, 20, (1500, 1)) * 3.0
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, x array<double>")
    rows = _prep(df, "id", "x")
    index = CellIndex(rows)
    near = index.search(index.first_visits(rows, 5), 5, True)
    bounds = near.groupBy("q_id", "rank").agg(F.min("d2").alias("d2")).where("rank = 5") \
        .select("q_id", F.sqrt("d2").alias("bound"))
    looked = index.pairs(index.first_visits(rows, 5)) + index.pairs(index.other_visits(rows, bounds, 5))
    assert looked < 0.15 * len(X) ** 2
    assert _as_lists(knn(df, df, 5)) == _brute(X, np.arange(len(X)), 5)


def _recall(got, ref):
    return sum(len(set(got.get(q, [])) & set(v)) for q, v in ref.items()) / sum(map(len, ref.values()))


def test_knn_approx_recall(spark):
    for spread in (0.0, 2.0):  # without and with clusters
        _, X, _ = _vecs(spark, n=1200, d=8)
        X += np.random.default_rng(1).integers(0, 6, (1200, 1)) * spread
        df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, x array<double>")
        assert _recall(_as_lists(knn_approx(df, df, 5)), _brute(X, np.arange(len(X)), 5)) >= 0.9


@pytest.mark.parametrize("n_maj", [0, 9])
def test_svm_smote_makes_all_rows_whichever_set_is_empty(spark, monkeypatch, n_maj):
    """All support vectors safe (no neighbour of the other class), or all in danger."""
    df, X, y = _vecs(spark)
    monkeypatch.setattr(RS, "_majority_share", lambda df, q, m, mino, **kw: q.select("id", F.lit(n_maj).alias("n_maj")))
    c = _counts(RS.svm_smote(df, seed="2"))
    assert c[0] == c[1] == (y == 0).sum()


def test_approximate_neighbours_lose_no_draw(spark, monkeypatch):
    """Bases with fewer than k neighbours, or none, still give their points."""
    df, X, y = _vecs(spark)
    real = RS._knn_exact
    monkeypatch.setattr(RS, "knn_approx", lambda q, r, k, **kw: real(q, r, k).where("q_id % 3 <> 0 and rank <= 1 + q_id % 2"))
    c = _counts(RS.smote(df, approx=True))
    assert c[0] == c[1]


@pytest.mark.parametrize("name", ["random_oversample", "smote", "adasyn", "smote_enn"])
def test_string_keys(spark, name):
    df, X, y = _vecs(spark)
    names = df.withColumn("id", F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")))
    out, want = RS.resample_by_name(names, name, seed="4"), RS.resample_by_name(df, name, seed="4")
    assert _counts(out) == _counts(want)
    own = {r["id"] for r in out.where("id like 'k%'").collect()}
    assert own == {f"k{r['id']:04d}" for r in want.where("id >= 0").collect()}
    assert out.where("id not like 'k%' and id not like 'synthetic-%'").count() == 0


def _counts(df):
    return {r["target"]: r["n"] for r in df.groupBy("target").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("name", ["random_oversample", "smote", "adasyn", "borderline_smote", "svm_smote"])
def test_oversamplers_balance(spark, name):
    df, X, y = _vecs(spark)
    out = RS.resample_by_name(df, name, seed="1").cache()
    c = _counts(out)
    assert c[0] == (y == 0).sum()
    if name in ("random_oversample", "smote", "borderline_smote"):
        assert c[1] == c[0]
    else:
        assert abs(c[1] - c[0]) <= 0.05 * c[0] + 2
    assert out.select("id").distinct().count() == out.count()


def test_smote_points_on_segments(spark):
    df, X, y = _vecs(spark)
    out = RS.smote(df, seed="3").where("id < 0").toPandas()
    for _, r in out.iterrows():
        b, n, x = X[r.base_id], X[r.nn_id], np.asarray(r.x)
        assert np.allclose(x, b + r.step * (n - b))
        assert 0 <= r.step < 1 and y[r.base_id] == 1 and y[r.nn_id] == 1


def test_edited_nn_and_tomek(spark):
    df, X, y = _vecs(spark)
    ids = np.arange(len(X))
    nn3 = _brute(X, ids, 3)
    keep = {i for i in ids if all(y[j] == y[i] for j in nn3[i])}
    assert {r["id"] for r in RS.edited_nn(df, 3).collect()} == keep
    nn1 = _brute(X, ids, 1)
    links = {i for i in ids if nn1[nn1[i][0]][0] == i and y[nn1[i][0]] != y[i]}
    assert {r["id"] for r in RS.tomek_pairs(df).collect()} == links


def test_unknown_resampler(spark):
    df, _, _ = _vecs(spark, n=50, pos=10)
    with pytest.raises(KeyError):
        RS.resample_by_name(df, "nope")


@pytest.mark.parametrize("name", ["random_oversample", "smote", "adasyn", "borderline_smote"])
def test_multiclass_not_majority(spark, name):
    rng = np.random.default_rng(4)
    sizes = {0: 150, 1: 40, 2: 25}
    rows, i = [], 0
    for c, n in sizes.items():
        for _ in range(n):
            rows.append((i, (rng.normal(size=6) + c).tolist(), c))
            i += 1
    df = spark.createDataFrame(rows, "id long, x array<double>, target int")
    out = RS.resample_by_name(df, name, seed="9")
    c = _counts(out)
    assert c[0] == 150
    for cls in (1, 2):
        if name in ("random_oversample", "smote"):
            assert c[cls] == 150
        elif name == "adasyn":  # per-base rounding
            assert abs(c[cls] - 150) <= sizes[cls] // 2
    assert out.select("id").distinct().count() == out.count()
    assert out.where("id < 0").select("target").distinct().count() >= 1


def test_approximate_neighbours_option(spark):
    df, X, y = _vecs(spark, n=200, d=4)
    exact = {r["id"] for r in RS.edited_nn(df, 3).collect()}
    approx = {r["id"] for r in RS.edited_nn(df, 3, approx=True).collect()}
    assert len(exact ^ approx) <= 0.25 * len(exact)


def _exact_support(X, s, gamma, C, steps=20000):
    """Support rows of the exact kernel machine: its dual by the pair that violates most."""
    K = np.exp(-gamma * ((X[:, None] - X[None]) ** 2).sum(-1))
    a, g = np.zeros(len(X)), -np.ones(len(X))
    for _ in range(steps):
        up = np.where(((s > 0) & (a < C - 1e-12)) | ((s < 0) & (a > 1e-12)), -s * g, -np.inf)
        low = np.where(((s < 0) & (a < C - 1e-12)) | ((s > 0) & (a > 1e-12)), -s * g, np.inf)
        i, j = int(up.argmax()), int(low.argmin())
        if up[i] - low[j] < 1e-9:
            break
        t = (up[i] - low[j]) / max(K[i, i] + K[j, j] - 2 * K[i, j], 1e-12)
        t = min(t, C - a[i] if s[i] > 0 else a[i], a[j] if s[j] > 0 else C - a[j])
        a[i] += s[i] * t
        a[j] -= s[j] * t
        g += s * t * (K[:, i] - K[:, j])
    return {int(i) for i in np.flatnonzero(a > 1e-8)}


def _rings(spark, n=160):
    """A minority inside a ring: no line parts them."""
    rng = np.random.default_rng(6)
    y = np.array([1] * 40 + [0] * (n - 40))
    turn, far = rng.uniform(0, 2 * np.pi, n), np.where(y == 1, rng.uniform(0, 1.3, n), rng.uniform(1.0, 2.5, n))
    X = np.c_[far * np.cos(turn), far * np.sin(turn)]
    return spark.createDataFrame([(i, X[i].tolist(), int(y[i])) for i in range(n)], "id long, x array<double>, target int"), X, y


def test_support_vectors_equal_the_exact_kernel_machine(spark):
    df, X, y = _rings(spark)
    gamma = 1 / (2 * X.var())
    want = {i for i in _exact_support(X, np.where(y == 1, 1.0, -1.0), gamma, 1.0) if y[i] == 1}
    got = {r["id"] for r in RS.support_vectors(df, 1, landmarks=200).collect()}
    assert want and len(got & want) >= 0.95 * len(got | want)
    few = {r["id"] for r in RS.support_vectors(df, 1, landmarks=40).collect()}
    assert len(few & want) >= 0.9 * len(few | want)
    line = {r["id"] for r in RS.support_vectors(df, 1, kernel="linear").collect()}
    assert len(line) > len(want)  # no line keeps an inner row outside the margin
    with pytest.raises(ValueError):
        RS.support_vectors(df, 1, kernel="cubic")


def test_kernel_map_keeps_the_kernel(spark):
    df, X, _ = _rings(spark, n=60)
    rows = RS.kernel_map(df, landmarks=60, gamma=0.5).orderBy("id").collect()
    P = np.array([r["phi"] for r in rows])
    K = np.exp(-0.5 * ((X[:, None] - X[None]) ** 2).sum(-1))
    assert np.abs(P @ P.T - K).max() < 1e-4
    same = spark.createDataFrame([(i, [1.0, 2.0], i % 2) for i in range(6)], "id long, x array<double>, target int")
    assert RS.kernel_map(same).count() == 6 and RS.kernel_map(df.limit(0).union(same)).count() == 6


def test_beta_quantile():
    rng = np.random.default_rng(0)
    draws = np.sort(rng.beta(10, 10, 200_000))
    for p in (0.01, 0.25, 0.5, 0.9):
        assert abs(RS.beta_quantile(p, 10, 10) - draws[int(p * len(draws))]) < 0.005
    assert abs(RS.beta_quantile(0.3, 1, 1) - 0.3) < 1e-9


def test_uniform_value_equals_the_column(spark):
    from balsam.functions.random import uniform, uniform_value
    assert [r[0] for r in spark.range(5).select(uniform("7:f", "id")).collect()] == [uniform_value("7:f", i) for i in range(5)]


def test_a_query_is_sent_once_to_a_unit(spark):
    """Where no cell can be left out, a query still goes to each unit of cells once, not to each cell."""
    from balsam.operators.knn import BLOCKS, CellIndex, _prep
    df, X, _ = _vecs(spark, n=900, d=24)
    rows = _prep(df, "id", "x")
    index = CellIndex(rows, block_rows=16)  # small blocks grow with the table
    visits = index.other_visits(rows, rows.select(F.col("id").alias("q_id"), F.lit(1e9).alias("bound")), 3)
    assert visits.count() == len(X) and index.pairs(visits) > 0.8 * len(X) ** 2
    assert visits.agg(F.max(F.size("units"))).first()[0] <= 2 * BLOCKS
    assert _as_lists(knn(df, df, 3, block_rows=16)) == _brute(X, np.arange(len(X)), 3)


def test_knn_copies_and_repeated_ids(spark):
    """Large groups of equal vectors, ids that come twice, vectors of any length."""
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e-30, 1e30):
        X = rng.normal(size=(160, 6)) * scale
        X[40:120] = X[0]
        df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, x array<double>")
        assert _as_lists(knn(df, df, 4, block_rows=32)) == _brute(X, np.arange(len(X)), 4)
    twice = df.unionByName(df.where("id < 50"))
    q = df.where("id = 60")
    got = [(r["nn_id"], r["rank"]) for r in knn(q, twice, 4).orderBy("rank").collect()]
    assert got == [(0, 1), (0, 2), (40, 3), (40, 4)]


def test_resample_summary_searches_the_same_rows_once(spark, monkeypatch):
    """Every method is called and counts as it does by itself; no search is made twice."""
    df, _, _ = _vecs(spark, n=150, pos=30)
    names = ["smote", "adasyn", "smote_enn", "smote_tomek"]
    alone = {(n, r["target"]): r["n"] for n in names for r in RS.resample_by_name(df, n, "42").groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    searches, exact, called = [], RS._knn_exact, []
    monkeypatch.setattr(RS, "_knn_exact", lambda q, r, k, **kw: (searches.append((q.count(), r.count())), exact(q, r, k, **kw))[1])
    by_name = RS.resample_by_name
    monkeypatch.setattr(RS, "resample_by_name", lambda d, n, *a, **kw: (called.append(n), by_name(d, n, *a, **kw))[1])
    got = {(r["method"], r["target"]): r["n"] for r in RS.resample_summary(df, names).collect()}
    assert got == alone and called == names
    assert sorted(searches) == [(30, 30), (30, 150), (240, 240)]
    RS.tomek_links(df)
    RS.tomek_links(df)
    assert len(searches) == 5  # nothing is kept for later calls
