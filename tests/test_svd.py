import numpy as np
import pytest

from balsam.operators import svd as V


def _docs(n=120, seed=0):
    rng = np.random.default_rng(seed)
    topics = [[f"t{k}w{i}" for i in range(25)] for k in range(6)]
    out = []
    for i in range(n):
        k = i % 6
        words = list(rng.choice(topics[k], 20)) + list(rng.choice(topics[rng.integers(6)], 6))
        out.append(" ".join(words))
    return out


def _dense(texts, buckets, idf):
    r, c, v = V._rows(texts, buckets, idf)
    a = np.zeros((len(texts), buckets))
    a[r, c] = v
    return a


def test_error_is_within_one_percent_of_an_exact_svd(spark):
    texts = _docs()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    model = V.fit_svd(df, "text", dim=12, buckets=200, passes=3)
    a = _dense(texts, 200, model.idf)
    df_of = (_dense(texts, 200, np.ones(200)) > 0).sum(0)
    assert np.allclose(model.idf, np.log((len(texts) + 1) / (df_of + 1)) + 1)
    s = np.linalg.svd(a, compute_uv=False)
    got = np.linalg.norm(a - a @ model.basis @ model.basis.T)
    assert got <= 1.01 * np.sqrt((s[12:] ** 2).sum())
    assert np.allclose(model.basis.T @ model.basis, np.eye(12), atol=1e-8) and np.allclose(model.singular[:4], s[:4], rtol=0.01)
    rows = {r["id"]: r["embedding"] for r in model.transform(df, "text", "id", scale=False).collect()}
    assert np.allclose([rows[i] for i in range(len(texts))], a @ model.basis)


def test_neighbours_of_near_copies_and_edges(spark):
    texts = _docs(90, 2)
    copies = [" ".join(t.split()[1:]) + " extra" for t in texts[:20]]
    rows = list(enumerate(texts + copies)) + [(500, None), (501, ""), (501, "?!"), (None, texts[0])]
    df = spark.createDataFrame(rows, "id long, text string")
    model = V.fit_svd(df, "text", dim=40, buckets=300)
    got = model.transform(df, "text", "id").collect()
    x = np.array([r["embedding"] for r in got if r["id"] is not None and r["id"] < 110])
    near = x @ x.T - 2 * np.eye(110)
    assert (near[90:110].argmax(1) == np.arange(20)).mean() >= 0.95
    assert all(not any(r["embedding"]) for r in got if r["id"] is not None and r["id"] >= 500)
    assert len(got) == len(rows) and model.transform(df.limit(0), "text", "id").count() == 0
    empty = V.fit_svd(df.limit(0), "text", dim=4, buckets=16)
    assert empty.basis.shape == (16, 4) and empty.singular == pytest.approx(np.zeros(4))


def test_blocks_are_multiplied_over_their_own_columns():
    from balsam.operators import svd
    texts = ["a b b", None, "c a d d d", ""]
    r, c, v = svd._rows(texts, 64, np.linspace(1, 2, 64))
    columns, rows = svd._dense(r, c, v, len(texts))
    full = np.zeros((len(texts), 64))
    full[r, c] = v
    q = np.random.default_rng(0).normal(size=(64, 5))
    assert len(columns) < 6 and rows.shape == (4, len(columns))
    assert np.allclose(svd._times(r, c, v, len(texts), q), full @ q)
