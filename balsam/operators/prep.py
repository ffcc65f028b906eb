"""Preprocessing stages (G1-G4, G8) as pyspark.ml stages on array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _ScalerParams(HasInputCol, HasOutputCol):
    pass


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / scale element-wise; scale = population std, 1 where it is 0."""

    mean = Param(Params._dummy(), "mean", "per-dimension mean", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "per-dimension scale", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol="x", outputCol="x", mean=None, scale=None):
        super().__init__()
        self._setDefault(inputCol="x", outputCol="x", mean=[], scale=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mu = F.array(*[F.lit(float(v)) for v in self.getOrDefault(self.mean)])
        sc = F.array(*[F.lit(float(v)) for v in self.getOrDefault(self.scale)])
        x = F.col(self.getInputCol()).cast("array<double>")
        z = F.zip_with(F.zip_with(x, mu, lambda a, m: a - m), sc, lambda d, s: d / s)
        return dataset.withColumn(self.getOutputCol(), z)


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Standard scaling with the population standard deviation (pyspark.ml's
    StandardScaler uses the sample one). One pass with ``Summarizer``; the fitted
    state is two vectors of the feature width."""

    @keyword_only
    def __init__(self, inputCol="x", outputCol="x"):
        super().__init__()
        self._setDefault(inputCol="x", outputCol="x")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer
        v = array_to_vector(F.col(self.getInputCol()).cast("array<double>"))
        s = dataset.select(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).first()["s"]
        n = float(s["count"])
        mean = s["mean"].toArray().tolist()
        var = s["variance"].toArray()
        factor = (n - 1.0) / n if n > 1 else 0.0
        scale = [(float(vv * factor) ** 0.5) if vv * factor > 0 else 1.0 for vv in var]
        return PopulationScalerModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                                     mean=mean, scale=scale)


class FunctionTransformer(Transformer):
    """A stage that applies a caller's ``df -> df`` function, with the way back if there is one.
    It has no fitted state, so each fold's copy does the same."""

    def __init__(self, func: Callable[[DataFrame], DataFrame],
                 inverse: Callable[[DataFrame], DataFrame] | None = None):
        super().__init__()
        self.func, self.inverse_func = func, inverse

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.func(dataset)

    def inverse(self, dataset: DataFrame) -> DataFrame:
        if self.inverse_func is None:
            raise NotImplementedError("this step was built without a way back")
        return self.inverse_func(dataset)


def class_weights(df: DataFrame, target: str = "target", out: str = "weight",
                  mode: str = "balanced", pos_weight: float = 1.0, positive: int = 1) -> DataFrame:
    """Per-row weights: 'balanced' n / (k * n_c) (broadcast join of the class-count
    table, one row per class), or 'pos' = ``pos_weight`` for the positive class."""
    if mode == "pos":
        return df.withColumn(out, F.when(F.col(target) == positive, F.lit(float(pos_weight))).otherwise(1.0))
    c = df.groupBy(target).agg(F.count(F.lit(1)).alias("__nc"))
    from pyspark.sql import Window
    w = Window.partitionBy()
    c = c.select(target, (F.sum("__nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("__nc"))).alias(out))
    return df.join(F.broadcast(c), target)
