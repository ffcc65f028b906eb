import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from balsam.operators import train as TR
from balsam.operators.metrics import macro_metrics


def _data(spark, n=240, d=6, seed=0):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.25).astype(int)
    X = rng.normal(size=(n, d)) + y[:, None] * 1.5
    return spark.createDataFrame([(int(i), X[i].tolist(), int(y[i])) for i in range(n)],
                                 "id long, x array<double>, target int")


def test_macro_evaluator_matches_table(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (1.0, 0.0)], "label double, prediction double")
    ev = TR.MacroEvaluator()
    assert ev.evaluate(df) == pytest.approx(macro_metrics(df, "label", "prediction").first()["f1_macro"])
    assert ev.isLargerBetter()


def test_nested_cv_and_trainer(spark, tmp_path):
    df = _data(spark)
    res = TR.nested_cv(df, "lr", "random_oversample", k=2, inner_k=2)
    assert len(res.fold_metrics) == 2 and 0 <= res.cv_score <= 1 and "regParam" in res.best_params
    tr = TR.Trainer(spark, k=2, inner_k=2).fit_all(df, models=["lr", "nope"], samplers=["random_oversample"])
    tr.evaluate(df)
    tab = tr.results_table()
    assert tab.count() == 1 and tab.first()["test_f1_macro"] is not None
    key, model = tr.best()
    assert key == "lr_random_oversample"
    path = str(tmp_path / "m")
    model.write().overwrite().save(path)
    a = model.transform(df).select("id", "prediction").orderBy("id").collect()
    b = PipelineModel.load(path).transform(df).select("id", "prediction").orderBy("id").collect()
    assert a == b


def test_predict_by_name_or_best_and_scoring(spark):
    df = _data(spark)
    tr = TR.Trainer(spark, k=2, inner_k=2, scoring="recall_macro", use_scaler=False) \
        .fit_all(df, models=["lr", "svm"], samplers=["random_oversample"])
    assert {r["model"] for r in tr.results} == {"lr_random_oversample", "svm_random_oversample"}
    assert tr.predict(df).count() == 240
    by_name = tr.predict(df, "svm_random_oversample", ["id"])
    assert by_name.columns == ["id", "prediction"]
    with pytest.raises(KeyError):
        tr.predict(df, "nope")


def test_unknown_sampler_and_errors_are_not_swallowed(spark, monkeypatch):
    df = _data(spark)
    with pytest.raises(KeyError):
        TR.nested_cv(df, "lr", "nope", k=2)

    def broken(*a, **k):
        raise RuntimeError("a Spark error")
    monkeypatch.setattr(TR, "resample_by_name", broken)
    with pytest.raises(RuntimeError, match="a Spark error"):
        TR.nested_cv(df, "lr", "smote", k=2)


def test_fold_that_a_sampler_cannot_use_is_left_out(spark, monkeypatch):
    df, calls = _data(spark), []
    real = TR.resample_by_name

    def first_fails(*a, **k):
        calls.append(1)
        if len(calls) == 1:
            raise TR.NotApplicable("too few rows")
        return real(*a, **k)
    monkeypatch.setattr(TR, "resample_by_name", first_fails)
    with pytest.warns(UserWarning, match="left out"):
        assert len(TR.nested_cv(df, "lr", "random_oversample", k=2, inner_k=2).fold_metrics) == 1


def test_history_ends_at_the_full_fit(spark):
    from pyspark.ml.classification import LogisticRegression
    df = TR.to_ml(_data(spark))
    h = {(r["iteration"], r["part"]): r for r in TR.training_history(LogisticRegression(), df, df, (1, 4, 16)).collect()}
    assert h[(1, "train")]["loss"] > h[(4, "train")]["loss"] >= h[(16, "train")]["loss"]
    assert h[(16, "train")]["loss"] == h[(16, "validation")]["loss"]


def test_encoder_is_built_once_per_name():
    from balsam.operators import text as TX
    built = []

    def factory():
        built.append(1)
        return lambda texts: [[0.0]] * len(texts)
    assert TX._encoder("one", factory) is TX._encoder("one", factory) and len(built) == 1
    assert TX._encoder(None, factory) is not TX._encoder(None, factory)


def test_training_history_fits_the_stages_before_the_model_once(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from balsam.operators.metrics import log_loss
    from balsam.operators.prep import PopulationScaler
    df = TR.add_weights(_data(spark).withColumn("label", F.col("target").cast("double")))
    stages = [PopulationScaler(inputCol="x", outputCol="x"), TR.ArrayToVector(), LogisticRegression(weightCol="weight")]
    fits, fit = [], PopulationScaler._fit
    monkeypatch.setattr(PopulationScaler, "_fit", lambda self, d: fits.append(1) or fit(self, d))
    got = TR.training_history(Pipeline(stages=stages), df, df, (1, 4)).collect()
    assert len(fits) == 1 and len(got) == 4
    whole = Pipeline(stages=[*stages[:2], LogisticRegression(weightCol="weight", maxIter=4)]).fit(df).transform(df)
    want = log_loss(whole.select("label", vector_to_array("probability").alias("p")), "label", "p").first()
    assert [r["loss"] for r in got if r["iteration"] == 4] == [pytest.approx(want["loss"], rel=1e-9)] * 2
