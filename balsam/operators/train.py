"""Training (G5-G15): estimators, macro-F1 evaluator, grid search, nested CV.

Nested CV keeps every fitted thing inside the training part of each outer fold:
scaler fitted on the fold's training rows, resampler applied to them only, inner
grid search on the resampled rows, scores from the untouched validation rows.
The driver loops over folds, models and samplers (small, bounded counts); every
step inside is a lazy Spark plan, and each fold's input is checkpointed once.
"""

from __future__ import annotations

import math
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balsam.operators.boost import SecondOrderBoost
from balsam.operators.metrics import log_loss, macro_metrics
from balsam.operators.neural import ReluNet
from balsam.operators.prep import PopulationScaler, class_weights
from balsam.operators.resample import RESAMPLERS, NotApplicable, resample_by_name
from balsam.operators.score import predict, predict_proba
from balsam.operators.split import fold_guard, stratified_kfold
from balsam.session import cut_lineage

SEED = 42


class ArrayToVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """array<double> -> ml Vector (persistable pipeline stage)."""

    @keyword_only
    def __init__(self, inputCol="x", outputCol="features"):
        super().__init__()
        self._setDefault(inputCol="x", outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.col(self.getInputCol()).cast("array<double>")))


class MacroEvaluator(Evaluator):
    """Macro F1 (or macro precision / recall / accuracy) from the exact report.
    pyspark's MulticlassClassificationEvaluator 'f1' is weighted, not macro."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction", metric: str = "f1_macro"):
        super().__init__()
        self.labelCol, self.predictionCol, self.metric = labelCol, predictionCol, metric

    def _evaluate(self, dataset: DataFrame) -> float:
        r = macro_metrics(dataset, self.labelCol, self.predictionCol).first()
        return float(r[self.metric]) if r is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True

    def copy(self, extra=None):
        return MacroEvaluator(self.labelCol, self.predictionCol, self.metric)


def to_ml(df: DataFrame, weight: bool = True) -> DataFrame:
    """(id, x, target) -> + features vector, label double, balanced weight."""
    out = df.withColumn("features", array_to_vector(F.col("x").cast("array<double>"))) \
            .withColumn("label", F.col("target").cast("double"))
    return add_weights(out) if weight else out


def add_weights(df: DataFrame) -> DataFrame:
    """Balanced class weights plus positive-class weights 1 and 3 (the reference's
    ``scale_pos_weight`` grid, expressed as alternative ``weightCol`` columns)."""
    out = class_weights(df, "target", "weight")
    return (out.withColumn("w_pos1", F.lit(1.0))
            .withColumn("w_pos3", F.when(F.col("target") == 1, F.lit(3.0)).otherwise(F.lit(1.0))))


def make_estimator(name: str, dim: int, fast: bool = True):
    """(estimator, param maps). The full grids mirror the reference's (depths, feature subsets,
    rates); ``fast`` keeps two points of each and few trees, rounds or steps."""
    if name == "rfc":
        est = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                     seed=SEED, minInstancesPerNode=1, featureSubsetStrategy="sqrt")
        g = ParamGridBuilder()
        if fast:
            g = g.addGrid(est.numTrees, [20]).addGrid(est.maxDepth, [3, 5])
        else:
            g = (g.addGrid(est.numTrees, [200]).addGrid(est.maxDepth, [10, 20, 30])
                 .addGrid(est.featureSubsetStrategy, ["sqrt", "log2"]))
        return est, g.build()
    if name == "gbt":
        est = GBTClassifier(featuresCol="features", labelCol="label", seed=SEED, subsamplingRate=0.8,
                            featureSubsetStrategy="0.8", weightCol="w_pos1")
        g = ParamGridBuilder()
        if fast:
            g = g.addGrid(est.maxIter, [10]).addGrid(est.maxDepth, [3]).addGrid(est.stepSize, [0.1, 0.3])
        else:
            g = (g.addGrid(est.maxIter, [200]).addGrid(est.maxDepth, [3, 6, 9])
                 .addGrid(est.stepSize, [0.01, 0.1]).addGrid(est.weightCol, ["w_pos1", "w_pos3"]))
        return est, g.build()
    if name == "mlpc":
        est = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", seed=SEED,
                                             layers=[dim, 100, 50, 2], blockSize=64)
        return est, ParamGridBuilder().addGrid(est.maxIter, [50, 100] if fast else [200, 500]).build()
    if name == "xgb":
        est = SecondOrderBoost(featuresCol="features", labelCol="label", subsample=0.8, colsample=0.8, seed=SEED)
        g = ParamGridBuilder()
        if fast:
            g = g.addGrid(est.maxIter, [5]).addGrid(est.maxDepth, [3]).addGrid(est.stepSize, [0.1, 0.3])
        else:
            g = (g.addGrid(est.maxIter, [200]).addGrid(est.maxDepth, [3, 6, 9])
                 .addGrid(est.stepSize, [0.01, 0.1]).addGrid(est.scalePosWeight, [1.0, 3.0]))
        return est, g.build()
    if name == "net":
        est = ReluNet(featuresCol="features", labelCol="label", hiddenLayers=[100, 50], learningRate=0.001, batchSize=64, seed=SEED)
        return est, ParamGridBuilder().addGrid(est.maxIter, [10 if fast else 500]).addGrid(est.alpha, [0.0001, 0.001]).build()
    if name == "lr":
        est = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50)
        return est, ParamGridBuilder().addGrid(est.regParam, [0.0, 0.1] if fast else [0.0, 0.01, 0.1]).build()
    if name == "svm":
        est = LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50)
        return est, ParamGridBuilder().addGrid(est.regParam, [0.0, 0.1] if fast else [0.0, 0.01, 0.1]).build()
    raise KeyError(name)


MODELS = ("rfc", "gbt", "mlpc", "lr", "svm", "xgb", "net")


def grid_search(train: DataFrame, name: str, dim: int, k: int = 3, fast: bool = True,
                seed: str = "42", parallelism: int = 2, scoring: str = "f1_macro"):
    """Inner search: stratified folds as ``foldCol``, scored by ``scoring`` (a column of the macro
    metrics), refit of the best point on all rows. Returns (CrossValidatorModel, best params);
    ``avgMetrics`` of the model are in the order of the grid of :func:`make_estimator`."""
    est, grid = make_estimator(name, dim, fast)
    folded = stratified_kfold(train, k=k, seed=seed + ":inner")
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=MacroEvaluator(metric=scoring),
                        numFolds=k, foldCol="fold", parallelism=parallelism, seed=SEED)
    m = cv.fit(to_ml(folded))
    scores = list(m.avgMetrics)
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return m, {p.name: v for p, v in grid[best].items()}


def preprocessors(use_scaler: bool = True, steps=()) -> list:
    """Fresh, unfitted stages: the scaler and copies of the caller's own stages."""
    return [*([PopulationScaler(inputCol="x", outputCol="x")] if use_scaler else []), *[s.copy() for s in steps]]


def _width(df: DataFrame) -> int:
    return int(df.select(F.max(F.size("x"))).first()[0])


@dataclass
class CVResult:
    model: str
    sampler: str
    fold_metrics: list[dict] = field(default_factory=list)
    best_params: dict = field(default_factory=dict)

    @property
    def cv_score(self) -> float:
        return sum(m["f1_macro"] for m in self.fold_metrics) / len(self.fold_metrics)


def nested_cv(df: DataFrame, name: str, sampler: str, k: int = 5, inner_k: int = 3,
              fast: bool = True, seed: str = "42", scoring: str = "f1_macro", use_scaler: bool = True,
              steps=()) -> CVResult:
    """Outer stratified folds; per fold fresh preprocessors -> resample -> inner search -> score.

    A fold that the sampler cannot work on (:class:`NotApplicable`) is left out with a warning;
    every other error ends the run."""
    if sampler not in RESAMPLERS:
        raise KeyError(f"unknown resampler {sampler!r}; known: {sorted(RESAMPLERS)}")
    dim = _width(df)
    folded = cut_lineage(stratified_kfold(df, k=k, seed=seed))
    usable = [r["fold"] for r in fold_guard(folded).collect() if r["usable"]]  # <= k rows
    res, per_fold = CVResult(name, sampler), []
    for f in sorted(usable):
        tr = folded.where(F.col("fold") != f).drop("fold")
        va = folded.where(F.col("fold") == f).drop("fold")
        chain = Pipeline(stages=preprocessors(use_scaler, steps)).fit(tr)
        try:
            rs = cut_lineage(resample_by_name(chain.transform(tr), sampler, seed=seed).select("id", "x", "target"))
        except NotApplicable as e:
            warnings.warn(f"fold {f} is left out: {e}")
            continue
        cvm, params = grid_search(rs, name, dim, inner_k, fast, seed, scoring=scoring)
        pred = cvm.bestModel.transform(to_ml(chain.transform(va), weight=False))
        m = macro_metrics(pred, "label", "prediction").first()
        res.fold_metrics.append({"fold": f, "f1_macro": m["f1_macro"], "accuracy": m["accuracy"],
                                 "precision": m["precision_macro"], "recall": m["recall_macro"]})
        per_fold.append(params)
    if not res.fold_metrics:
        raise RuntimeError(f"no usable fold for {name}/{sampler}")
    key = {"precision_macro": "precision", "recall_macro": "recall"}.get(scoring, scoring)
    scores = [m[key] for m in res.fold_metrics]
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    res.best_params = per_fold[best]
    return res


def retrain_full(df: DataFrame, name: str, sampler: str, params: dict, fast: bool = True,
                 seed: str = "42", use_scaler: bool = True, steps=()) -> PipelineModel:
    """Preprocessors fitted on all training rows, resampled, best params, one fit.
    Returns a PipelineModel (preprocessors -> vector -> classifier) for scoring."""
    dim = _width(df)
    chain = Pipeline(stages=preprocessors(use_scaler, steps)).fit(df)
    rs = cut_lineage(resample_by_name(chain.transform(df), sampler, seed=seed).select("id", "x", "target"))
    est, _ = make_estimator(name, dim, fast)
    est = est.copy({est.getParam(k): v for k, v in params.items()})
    clf = est.fit(to_ml(rs))
    return PipelineModel(stages=[*chain.stages, ArrayToVector(inputCol="x", outputCol="features"), clf])


class Trainer:
    """Models x samplers with nested CV, a final refit each, test evaluation and a
    results table (one row per ``model_sampler``)."""

    def __init__(self, spark: SparkSession, fast: bool = True, k: int = 5, inner_k: int = 3, seed: str = "42",
                 scoring: str = "f1_macro", use_scaler: bool = True, steps=(), parallelism: int = 2):
        self.spark, self.fast, self.k, self.inner_k, self.seed = spark, fast, k, inner_k, seed
        self.scoring, self.use_scaler, self.steps, self.parallelism = scoring, use_scaler, steps, parallelism
        self.results: list[dict] = []
        self.models: dict[str, PipelineModel] = {}

    def _fit(self, train: DataFrame, name: str, sampler: str) -> tuple[dict, PipelineModel]:
        cv = nested_cv(train, name, sampler, self.k, self.inner_k, self.fast, self.seed, self.scoring,
                       self.use_scaler, self.steps)
        model = retrain_full(train, name, sampler, cv.best_params, self.fast, self.seed, self.use_scaler, self.steps)
        avg = {m: sum(r[m] for r in cv.fold_metrics) / len(cv.fold_metrics)
               for m in ("f1_macro", "accuracy", "precision", "recall")}
        return {"model": f"{name}_{sampler}", "cv_score": cv.cv_score,
                "best_params": {k: str(v) for k, v in cv.best_params.items()}, **avg}, model

    def fit_all(self, train: DataFrame, models=("rfc", "gbt", "mlpc"), samplers=None) -> "Trainer":
        """Every model with every sampler; ``parallelism`` of these independent fits run at once."""
        unknown = [n for n in models if n not in MODELS]
        if unknown:
            warnings.warn(f"unknown models are left out: {unknown}; known: {list(MODELS)}")
        pairs = [(n, s) for n in models if n in MODELS for s in samplers or list(RESAMPLERS)]
        with ThreadPoolExecutor(max_workers=max(1, self.parallelism)) as pool:
            done = list(pool.map(inheritable_thread_target(self.spark)(lambda p: self._fit(train, *p)), pairs))
        for row, model in done:
            self.results.append(row)
            self.models[row["model"]] = model
        return self

    def evaluate(self, test: DataFrame) -> "Trainer":
        for r in self.results:
            pred = self.models[r["model"]].transform(test.withColumn("label", F.col("target").cast("double")))
            m = macro_metrics(pred, "label", "prediction").first()
            r.update(test_f1_macro=m["f1_macro"], test_accuracy=m["accuracy"],
                     test_precision=m["precision_macro"], test_recall=m["recall_macro"])
        return self

    def results_table(self) -> DataFrame:
        """createDataFrame of the driver-side result rows (one per model/sampler)."""
        cols = ["model", "cv_score", "best_params", "f1_macro", "accuracy", "precision", "recall",
                "test_f1_macro", "test_accuracy", "test_precision", "test_recall"]
        rows = [tuple(r.get(c) for c in cols) for r in self.results]
        schema = ("model string, cv_score double, best_params map<string,string>, f1_macro double, "
                  "accuracy double, precision double, recall double, test_f1_macro double, "
                  "test_accuracy double, test_precision double, test_recall double")
        return self.spark.createDataFrame(rows, schema)

    def best(self, metric: str = "cv_score") -> tuple[str, PipelineModel]:
        vals = [(r.get(metric) if r.get(metric) is not None else -math.inf, -i, r["model"])
                for i, r in enumerate(self.results)]
        key = max(vals)[2]
        return key, self.models[key]


    def model(self, name: str | None = None) -> PipelineModel:
        """The model called ``name``, or the best one."""
        if name is None:
            return self.best()[1]
        if name not in self.models:
            raise KeyError(f"no model {name!r}; trained: {sorted(self.models)}")
        return self.models[name]

    def predict(self, df: DataFrame, name: str | None = None, keep: list[str] | None = None) -> DataFrame:
        return predict(self.model(name), df, keep)

    def predict_proba(self, df: DataFrame, name: str | None = None, keep: list[str] | None = None) -> DataFrame:
        return predict_proba(self.model(name), df, keep)


def training_history(estimator, train: DataFrame, validation: DataFrame,
                     iterations=(1, 2, 4, 8, 16, 32)) -> DataFrame:
    """(iteration, part, loss, accuracy) of a logistic regression, or a pipeline that ends in one,
    after so many iterations, on the training rows and on rows it has not seen. The optimiser is
    deterministic, so stopping it earlier gives the state at that iteration. The stages before the
    regression are fitted and applied once; what they give is checkpointed."""
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    last, before = stages[-1], stages[:-1]
    if before:  # fitted and applied once: they are the same for each number of iterations
        train = cut_lineage(train)
        chain = Pipeline(stages=before).fit(train)
        train, validation = chain.transform(train), chain.transform(validation)
    used = [c for c in dict.fromkeys((last.getFeaturesCol(), last.getLabelCol(), "label",
                                      *([last.getWeightCol()] if last.isDefined(last.weightCol) else []))) if c]
    train, validation = cut_lineage(train.select(*used)), cut_lineage(validation.select(*used))
    out = None
    for i in iterations:
        model = last.copy({last.maxIter: i}).fit(train)
        for part, rows in (("train", train), ("validation", validation)):
            scored = model.transform(rows).select("label", vector_to_array("probability").alias("p"))
            one = log_loss(scored, "label", "p").select(F.lit(i).alias("iteration"), F.lit(part).alias("part"),
                                                        "loss", "accuracy")
            out = one if out is None else out.unionByName(one)
    return out


def fit_pipeline(train: DataFrame, name: str = "lr", fast: bool = True) -> PipelineModel:
    """Scaler -> vector -> classifier fitted on (id, x, target) rows."""
    est, grid = make_estimator(name, _width(train), fast)
    est = est.copy(grid[0]) if grid else est
    p = Pipeline(stages=[PopulationScaler(inputCol="x", outputCol="x"),
                         ArrayToVector(inputCol="x", outputCol="features"), est])
    return p.fit(add_weights(train.withColumn("label", F.col("target").cast("double"))))
