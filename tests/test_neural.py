import numpy as np
import pytest
from pyspark.ml import PipelineModel

from balsam.operators import neural as N
from balsam.operators import train as TR


def _rows(n=300, d=4, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, (np.abs(x[:, 0]) + x[:, 1] > 0.8).astype(float)


def _frame(spark, x, y):
    return TR.to_ml(spark.createDataFrame([(i, r.tolist(), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, x array<double>, target int"))


def test_gradient_matches_finite_differences():
    x, y = _rows(n=30)
    w = np.linspace(0.5, 2, 30)
    layers = [4, 5, 3, 1]
    flat = N.first_weights(layers, 1)
    loss, grad = N.sums(flat, layers, x, y, w)
    for i in range(0, len(flat), 3):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert grad[i] == pytest.approx((N.sums(up, layers, x, y, w)[0] - N.sums(down, layers, x, y, w)[0]) / 2e-6, abs=1e-4)
    assert loss == pytest.approx(sum(N.sums(flat, layers, x[i:i + 7], y[i:i + 7], w[i:i + 7])[0] for i in range(0, 30, 7)))


def test_sums_over_partitions_match_one_pass(spark, monkeypatch):
    monkeypatch.setattr(N, "FAN", 2)  # sums in two rounds
    x, y = _rows(n=90)
    layers = [4, 6, 1]
    flat = N.first_weights(layers, 3)
    df = spark.createDataFrame([(r.tolist(), float(t), 1.0) for r, t in zip(x, y)], "x array<double>, y double, w double")
    for parts in (1, 7):
        loss, n, right, grad = N.total(df.repartition(parts), flat, layers, parts)
        want, want_grad = N.sums(flat, layers, x, y, np.ones(90))
        assert n == 90 and loss == pytest.approx(want) and np.allclose(grad, want_grad)
        assert right == ((N.forward(flat, layers, x)[-1][:, 0] > 0) == (y > 0.5)).sum()
    assert N.total(df.limit(0), flat, layers)[1] == 0


def test_training_stops_early_and_the_best_epoch_is_taken(spark, tmp_path):
    x, y = _rows()
    df = _frame(spark, x, y)
    est = N.ReluNet(hiddenLayers=[16, 8], learningRate=0.02, batchSize=100, maxIter=40, patience=4, validation=0.2)
    model = est.fit(df)
    h = model.getHistory()
    best = max(h, key=lambda e: (e["val_accuracy"], -e["epoch"]))
    assert [e["epoch"] for e in h if e["best"]] == [best["epoch"]] and h[-1]["epoch"] < 40
    assert h[-1]["train_loss"] < h[0]["train_loss"] and best["val_accuracy"] > 0.75
    path = str(tmp_path / "m")
    PipelineModel(stages=[model]).write().overwrite().save(path)
    a, b = (m.transform(df).select("id", "probability", "prediction").orderBy("id").collect() for m in (model, PipelineModel.load(path)))
    assert a == b and all(r["prediction"] == float(r["probability"][1] > 0.5) for r in a)


def test_edges(spark):
    x, y = _rows(n=20)
    df = _frame(spark, x, y)
    model = N.ReluNet(hiddenLayers=[3], maxIter=1, validation=0.0).fit(df)
    assert model.getHistory()[0]["val_loss"] is None and model.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        N.ReluNet().fit(df.limit(0))


def test_a_step_sends_one_vector_to_the_driver(spark, monkeypatch):
    from balsam.operators import neural
    df = spark.createDataFrame([([float(i), 1.0], float(i % 2), 1.0) for i in range(20)], "x array<double>, y double, w double").repartition(5)
    flat, layers = neural.first_weights([2, 3, 1], 1), [2, 3, 1]
    seen, real = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(real(self)) or seen[-1])
    loss, n, _, grad = neural.total(df, flat, layers, 5)
    x, y = np.array([[float(i), 1.0] for i in range(20)]), np.arange(20) % 2.0
    want = neural.sums(flat, layers, x, y, np.ones(20))
    assert len(seen[-1]) == 1 and n == 20 and np.isclose(loss, want[0]) and np.allclose(grad, want[1])
