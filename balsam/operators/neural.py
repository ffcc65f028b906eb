"""A ReLU network for two classes (G7), trained by synchronous mini-batch Adam.

The rows are dealt to the steps of an epoch by a hash of their content and written once, a folder for
each step, so that a step reads only its own rows. A step is one job: every task sums loss and
gradient over its Arrow blocks, the tasks' sums are added in groups of ``FAN`` partitions, so that
the driver gets one vector a step up to that many, and the driver moves the weights, whose number depends on the layers alone.
A share of the rows is kept for validation; after ``patience`` epochs without a better accuracy there
training ends and the best weights are taken.

``batchSize`` is the number of rows of a step; there are at most ``MAX_STEPS`` steps in an epoch,
and on larger tables a step takes more rows. Equal rows share a step and a part, so that copies made
by a sampler are not on both sides of the validation split.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.session import scratch_path

MAX_STEPS = 64
FAN = 32


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, kind)


def shapes(layers: list[int]) -> list[tuple[int, ...]]:
    """Weights and offsets of each layer, in the order of the flat vector."""
    return [s for a, b in zip(layers, layers[1:]) for s in ((a, b), (b,))]


def unpacked(flat: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(layers):
        n = int(np.prod(s))
        out.append(flat[at:at + n].reshape(s))
        at += n
    return out


def first_weights(layers: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(layers, layers[1:]):
        bound = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def forward(flat: np.ndarray, layers: list[int], x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer; the last one is the logit."""
    ws, out = unpacked(flat, layers), [x]
    for i in range(0, len(ws), 2):
        z = out[-1] @ ws[i] + ws[i + 1]
        out.append(np.maximum(z, 0.0) if i + 2 < len(ws) else z)
    return out


def sums(flat: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted sums over the rows of the cross-entropy and of its gradient."""
    ws, act = unpacked(flat, layers), forward(flat, layers, x)
    z = act[-1][:, 0]
    loss = float((w * (np.logaddexp(0.0, z) - y * z)).sum())
    back = (w * (1.0 / (1.0 + np.exp(-z)) - y))[:, None]
    grads: list[np.ndarray] = []
    for i in range(len(ws) - 2, -1, -2):
        a = act[i // 2]
        grads = [(a.T @ back).ravel(), back.sum(0), *grads]
        back = (back @ ws[i].T) * (a > 0)
    return loss, np.concatenate(grads)


def decay_mask(layers: list[int]) -> np.ndarray:
    """1 for weights, 0 for offsets: only weights are decayed."""
    return np.concatenate([np.full(int(np.prod(s)), float(len(s) == 2)) for s in shapes(layers)])


_OUT = "loss double, rows double, correct double, gradient binary"


def total(df: DataFrame, flat: np.ndarray, layers: list[int], partitions: int | None = None) -> tuple[float, float, float, np.ndarray]:
    """(loss, weight, weight of right predictions, gradient) summed over the rows (x, y, w) of ``df``,
    which has so many ``partitions``."""
    shared = df.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n, right, grad = 0.0, 0.0, 0.0, np.zeros(len(shared.value))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, layers[0])
                y, w = b.column(1).to_numpy(), b.column(2).to_numpy()
                loss, g = sums(shared.value, layers, x, y, w)
                z = forward(shared.value, layers, x)[-1][:, 0]
                have, n, right, grad = have + loss, n + w.sum(), right + w[(z > 0) == (y > 0.5)].sum(), grad + g
        if n:
            yield _row(have, n, right, grad)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(r["loss"], r["rows"], r["correct"], r["gradient"]) for b in batches for r in b.to_pylist()]
        if got:  # sorted: they arrive in any order
            yield _row(*(sum(v) for v in zip(*((a, b, c, np.frombuffer(g)) for a, b, c, g in sorted(got)))))

    part = df.select("x", "y", "w").mapInArrow(run, _OUT)
    if partitions is not None and partitions > 1:
        part = part.repartition(-(-partitions // FAN)).mapInArrow(add, _OUT)
    rows = part.collect()  # one vector per FAN partitions
    shared.destroy()
    zero = np.zeros(len(flat))
    return (sum(r["loss"] for r in rows), sum(r["rows"] for r in rows), sum(r["correct"] for r in rows),
            sum((np.frombuffer(r["gradient"]) for r in rows), zero))


def _row(loss, n, right, grad) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(loss)]), pa.array([float(n)]), pa.array([float(right)]), pa.array([grad.tobytes()], pa.binary())],
                                      names=["loss", "rows", "correct", "gradient"])


class Adam:
    def __init__(self, size: int, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0
        self.rate, self.b1, self.b2, self.eps = rate, b1, b2, eps

    def step(self, flat: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = self.b1 * self.m + (1 - self.b1) * grad
        self.v = self.b2 * self.v + (1 - self.b2) * grad * grad
        rate = self.rate * np.sqrt(1 - self.b2 ** self.t) / (1 - self.b1 ** self.t)
        return flat - rate * self.m / (np.sqrt(self.v) + self.eps)


class _NetParams(HasFeaturesCol, HasLabelCol):
    weightCol = _param("weightCol", "row weights; none: 1", TypeConverters.toString)
    hiddenLayers = _param("hiddenLayers", "sizes of the hidden layers", TypeConverters.toListInt)
    alpha = _param("alpha", "L2 on the weights", TypeConverters.toFloat)
    learningRate = _param("learningRate", "first step size", TypeConverters.toFloat)
    batchSize = _param("batchSize", "rows of a step, at least", TypeConverters.toInt)
    maxIter = _param("maxIter", "epochs, at most", TypeConverters.toInt)
    validation = _param("validation", "share of the rows for early stopping; 0: none", TypeConverters.toFloat)
    patience = _param("patience", "epochs without a better validation accuracy", TypeConverters.toInt)
    tol = _param("tol", "least gain in accuracy", TypeConverters.toFloat)
    seed = _param("seed", "seed of weights and draws", TypeConverters.toInt)


class ReluNet(Estimator, _NetParams, DefaultParamsReadable, DefaultParamsWritable):
    """Labels are 0 and 1; rows without a label are left out."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", weightCol=None, hiddenLayers=(100, 50), alpha=1e-4,
                 learningRate=1e-3, batchSize=64, maxIter=500, validation=0.1, patience=10, tol=1e-4, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", hiddenLayers=[100, 50], alpha=1e-4, learningRate=1e-3,
                         batchSize=64, maxIter=500, validation=0.1, patience=10, tol=1e-4, seed=42)
        self._set(**{k: list(v) if k == "hiddenLayers" else v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "ReluNetModel":
        get = self.getOrDefault
        spark, c = dataset.sparkSession, get("featuresCol")
        x = vector_to_array(c) if dict(dataset.dtypes)[c] != "array<double>" else F.col(c)
        w = F.col(get("weightCol")).cast("double") if self.isDefined("weightCol") else F.lit(1.0)
        rows = dataset.filter(F.col(get("labelCol")).isNotNull()).select(x.alias("x"), F.col(get("labelCol")).cast("double").alias("y"), w.alias("w"))
        h = F.xxhash64(F.lit(get("seed")), "x", "y")
        held = F.pmod(h, F.lit(10_000)) < int(get("validation") * 10_000)
        path = scratch_path(spark, "net")
        rows.withColumn("held", held).withColumn("draw", F.pmod(F.shiftrightunsigned(h, 16), F.lit(2 ** 30)).cast("int")) \
            .write.partitionBy("held").parquet(f"{path}/rows")
        schema = "x array<double>, y double, w double, draw int, held boolean"
        both = spark.read.schema(schema).parquet(f"{path}/rows")
        train, check = both.filter("not held"), both.filter("held")
        n = train.count()
        if not n:
            raise ValueError("there are no rows to learn from")
        steps = min(MAX_STEPS, max(1, -(-n // get("batchSize"))))
        train.select("x", "y", "w", (F.col("draw") % steps).alias("step")).write.partitionBy("step").parquet(f"{path}/steps")
        dealt = spark.read.schema("x array<double>, y double, w double, step int").parquet(f"{path}/steps")
        batches = [dealt.filter(F.col("step") == s) for s in range(steps)]
        parts = [b.rdd.getNumPartitions() for b in (batches[0], check)]  # the steps are of one size
        layers = [len(both.select("x").first()["x"]), *get("hiddenLayers"), 1]
        flat, mask = first_weights(layers, get("seed")), decay_mask(layers)
        adam, order = Adam(len(flat), get("learningRate")), np.random.default_rng(get("seed"))
        best, best_score, wait, history = flat, -np.inf, 0, []
        for epoch in range(1, get("maxIter") + 1):
            loss = weight = 0.0
            for s in order.permutation(steps):
                part, size, _, grad = total(batches[s], flat, layers, parts[0])
                if size:
                    loss += part + get("alpha") / 2 * float((mask * flat * flat).sum())
                    weight += size
                    flat = adam.step(flat, (grad + get("alpha") * mask * flat) / size)
            entry = {"epoch": epoch, "train_loss": loss / weight}
            v_loss, v_weight, right, _ = total(check, flat, layers, parts[1]) if get("validation") > 0 else (0.0, 0.0, 0.0, None)
            score = right / v_weight if v_weight else -entry["train_loss"]
            entry |= {"val_loss": v_loss / v_weight if v_weight else None, "val_accuracy": score if v_weight else None}
            better = score > best_score + get("tol")
            wait = 0 if better else wait + 1
            if score > best_score:
                best, best_score = flat, score
                for e in history:
                    e["best"] = False
            history.append(entry | {"best": best is flat})
            if wait >= get("patience"):
                break
        return ReluNetModel(featuresCol=c, layers=layers, weights=base64.b64encode(best.tobytes()).decode(), history=json.dumps(history))


class ReluNetModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction, probability and prediction; ``getHistory()`` has a dict for each epoch."""

    layers = _param("layers", "sizes of all layers", TypeConverters.toListInt)
    weights = _param("weights", "flat weights, base64", TypeConverters.toString)
    history = _param("history", "epochs as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", layers=None, weights="", history="[]"):
        super().__init__()
        self._setDefault(featuresCol="features", layers=[], weights="", history="[]")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def getHistory(self) -> list[dict]:
        return json.loads(self.getOrDefault("history"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers = self.getOrDefault("layers")
        shared = dataset.sparkSession.sparkContext.broadcast(np.frombuffer(base64.b64decode(self.getOrDefault("weights"))))

        @F.pandas_udf("double")
        def logit(x: pd.Series) -> pd.Series:
            return pd.Series(forward(shared.value, layers, np.stack(x.to_numpy()))[-1][:, 0] if len(x) else [], dtype=float)

        c = self.getOrDefault("featuresCol")
        x = vector_to_array(c) if dict(dataset.dtypes)[c] != "array<double>" else F.col(c)
        z, p = F.col("logit__"), 1.0 / (1.0 + F.exp(-F.col("logit__")))
        return dataset.withColumn("logit__", logit(x)).withColumn("rawPrediction", array_to_vector(F.array(-z, z))) \
            .withColumn("probability", array_to_vector(F.array(1.0 - p, p))) \
            .withColumn("prediction", (p > 0.5).cast("double")).drop("logit__")
