"""A text classifier trained by epochs (G9) with its history (G10).

Subword ids are looked up in an embedding table, averaged over the text, and go through one ReLU layer
to a logit. The encoded rows are written once to the shared folder and dealt to ``parts`` by hash. In
an epoch every part is read as a stream of mini-batches in an order drawn anew, and trains its own
copy of the model with Adam, weight decay, clipped gradients and a rate that falls to 0 over the
epochs; then the parts' changes are averaged by their numbers of rows. Only the rows of the embedding
table that a part has touched leave it, and they are summed by Spark, so the driver sees at most one
model. After each epoch the model is written to the shared folder and all rows are scored by it: the
history comes from these predictions, and the epoch with the least validation loss is the one used.

The loss is weighted by class (``class_weight``: 'balanced', or a pair of weights such as (1, 49)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balsam.operators.subwords import Automaton, encode_subwords
from balsam.session import scratch_path


@dataclass
class Net:
    """Embeddings (V, d), hidden layer (d, h), (h,), output (h,) and its offset, as one list."""

    w: list[np.ndarray]

    @classmethod
    def new(cls, vocabulary: int, dim: int, hidden: int, seed: int) -> "Net":
        rng = np.random.default_rng(seed)
        s = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6.0 / (a + b))
        return cls([rng.normal(0, 0.3, (vocabulary, dim)), s(dim, hidden), np.zeros(hidden), s(hidden, 1)[:, 0], np.zeros(1)])

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        e, w1, b1, w2, b2 = self.w
        share = mask / np.maximum(mask.sum(1, keepdims=True), 1)
        pooled = np.einsum("nld,nl->nd", e[ids], share)
        z1 = pooled @ w1 + b1
        h = np.maximum(z1, 0)
        return share, pooled, z1, h, h @ w2 + b2[0]

    def gradient(self, ids, mask, y, weight) -> tuple[float, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(loss, touched embedding rows, their gradients, other gradients) of the weighted mean loss."""
        share, pooled, z1, h, z = self.forward(ids, mask)
        total = weight.sum()
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum() / total)
        d = weight * (1 / (1 + np.exp(-z)) - y) / total
        back = d[:, None] * self.w[3] * (z1 > 0)
        rows, place = np.unique(ids, return_inverse=True)
        grad = np.zeros((len(rows), self.w[0].shape[1]))
        np.add.at(grad, place.reshape(ids.shape), (back @ self.w[1].T)[:, None, :] * share[:, :, None])
        return loss, rows, grad, [pooled.T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True)]


class _Adam:
    """Adam of one part in one epoch; embedding rows that a batch does not touch stay as they are."""

    def __init__(self, net: Net, rate: float, decay: float):
        self.net, self.rate, self.decay, self.t = net, rate, decay, 0
        self.m, self.v = ([np.zeros_like(w) for w in net.w] for _ in range(2))

    def step(self, rows, grad, rest) -> None:
        norm = np.sqrt((grad ** 2).sum() + sum((g ** 2).sum() for g in rest))
        scale = min(1.0, 1.0 / max(norm, 1e-12))  # clipped to length 1
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for i, g in enumerate([grad, *rest]):
            at = rows if i == 0 else slice(None)
            m, v, w = self.m[i], self.v[i], self.net.w[i]
            m[at] = 0.9 * m[at] + 0.1 * scale * g
            v[at] = 0.999 * v[at] + 0.001 * (scale * g) ** 2
            w[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-8) + (self.rate * self.decay * w[at] if w.ndim == 2 else 0)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, ids, mask, y, weight) of up to ``size`` neighbouring rows of one part."""
    for b in batches:
        part = b.column("part").to_numpy()
        ids, mask = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("ids", "mask"))
        y, weight = b.column("y").to_numpy(), b.column("weight").to_numpy()
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
        for a, z in zip(edges, np.append(edges[1:], len(part))):
            for i in range(a, z, size):
                j = min(i + size, z)
                yield int(part[a]), ids[i:j], mask[i:j], y[i:j], weight[i:j]


def _epoch(rows: DataFrame, net: Net, rate: float, decay: float, batch: int, parts: int, seed: int, epoch: int) -> Net:
    """One pass of every part over its rows, and the average of the parts' models."""
    shared = rows.sparkSession.sparkContext.broadcast(net.w)
    sizes = [w.shape for w in net.w]
    dim = sizes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, n, touched = None, None, 0, None
        for part, ids, mask, y, weight in _blocks(batches, batch):
            if part != now:
                if now is not None:
                    yield out(state.net, n, touched)
                now, n, touched = part, 0, np.zeros(sizes[0][0], bool)
                state = _Adam(Net([w.copy() for w in shared.value]), rate, decay)
            _, at, grad, rest = state.net.gradient(ids, mask, y, weight)
            state.step(at, grad, rest)
            touched[at] = True
            n += len(y)
        if now is not None:
            yield out(state.net, n, touched)

    def out(own: Net, n: int, touched: np.ndarray) -> pa.RecordBatch:
        # changes times rows: embedding rows as they are, the rest as one vector under number -1
        at = np.flatnonzero(touched)
        deltas = [(own.w[0][i] - shared.value[0][i]) * n for i in at]
        rest = np.concatenate([(a - b).ravel() for a, b in zip(own.w[1:], shared.value[1:])]) * n
        return _changes([*at.tolist(), -1], [n] * (len(at) + 1), [*deltas, rest])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for at, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                have = sums.setdefault(at, [0, 0.0])
                have[0] += n
                have[1] = have[1] + np.frombuffer(data)
        if sums:
            yield _changes(list(sums), [v[0] for v in sums.values()], [v[1] for v in sums.values()])

    schema = "at int, n long, delta binary"
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", F.xxhash64(F.lit(seed + epoch), "row"))
    changes = dealt.select("part", "ids", "mask", "y", "weight").mapInArrow(run, schema)
    summed = changes.repartition(min(parts, 16), "at").sortWithinPartitions("at", "n", "delta").mapInArrow(add, schema)
    got = summed.collect()  # one model: a row per touched embedding and one for the rest
    total = next((r["n"] for r in got if r["at"] == -1), 0)
    new = [w.copy() for w in net.w]
    for r in got:
        delta = np.frombuffer(r["delta"]) / total
        if r["at"] >= 0:
            new[0][r["at"]] += delta
        else:
            i = 0
            for w, s in zip(new[1:], sizes[1:]):
                size = int(np.prod(s))
                w += delta[i:i + size].reshape(s)
                i += size
    shared.destroy()
    return Net(new)


def _changes(at, n, deltas) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64()), pa.array([np.asarray(d, float).tobytes() for d in deltas], pa.binary())],
                                      names=["at", "n", "delta"])


def _scores(rows: DataFrame, net: Net, *keep: str) -> DataFrame:
    """(keep..., p) of encoded rows."""
    shared = rows.sparkSession.sparkContext.broadcast(net.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(shared.value)
        for b in batches:
            p = [np.zeros(0)]
            for i in range(0, b.num_rows, 1024):
                ids, mask = (b.column(c).slice(i, 1024).flatten().to_numpy().reshape(-1, width) for c in ("ids", "mask"))
                p.append(1 / (1 + np.exp(-net.forward(ids, mask)[-1])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate(p))], names=[*keep, "p"])

    first = rows.select(F.size("ids")).first()
    width = first[0] if first else 1
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "ids", "mask").mapInArrow(run, f"{kinds}, p double")


class TextModel:
    """The fitted classifier: ``folder`` has the model of every epoch and the predictions they made."""

    def __init__(self, spark: SparkSession, folder: str, automaton: Automaton, max_length: int, best: int):
        self.spark, self.folder, self.automaton, self.max_length, self.best = spark, folder, automaton, max_length, best

    def predictions(self) -> DataFrame:
        """(epoch, part, id, target, weight, p) of all training and validation rows after each epoch."""
        return self.spark.read.parquet(f"{self.folder}/predictions")

    def history(self) -> DataFrame:
        """(epoch, train_loss, train_accuracy, val_loss, val_accuracy, best)."""
        return _history(self.predictions()).withColumn("best", F.col("epoch") == self.best)

    def net(self, epoch: int | None = None) -> Net:
        rows = self.spark.read.parquet(f"{self.folder}/models").filter(F.col("epoch") == (epoch or self.best)).collect()
        return Net([np.frombuffer(r["data"]).reshape(r["shape"]) for r in sorted(rows, key=lambda r: r["place"])])

    def transform(self, df: DataFrame, key: str = "id", text_col: str = "text", epoch: int | None = None) -> DataFrame:
        """(key, score, prediction) of every row."""
        enc = encode_subwords(df, text_col, key, self.automaton, self.max_length) \
            .select(key, F.col("input_ids").alias("ids"), F.col("attention_mask").alias("mask"))
        return _scores(enc, self.net(epoch), key).select(key, F.col("p").alias("score"), (F.col("p") > 0.5).cast("int").alias("prediction"))


def _history(predictions: DataFrame) -> DataFrame:
    loss = -F.log(F.when(F.col("target") == 1, F.col("p")).otherwise(1 - F.col("p")))
    right = ((F.col("p") > 0.5) == (F.col("target") == 1)).cast("double")
    out = []
    for part, name in (("train", "train"), ("validation", "val")):
        here = F.col("part") == part
        out += [(F.sum(F.when(here, F.col("weight") * loss)) / F.sum(F.when(here, F.col("weight")))).alias(f"{name}_loss"),
                F.avg(F.when(here, right)).alias(f"{name}_accuracy")]
    return predictions.groupBy("epoch").agg(*out)


def fit_text(train: DataFrame, validation: DataFrame | None, automaton: Automaton, epochs: int = 3, rate: float = 0.02,
             decay: float = 0.01, batch: int = 16, parts: int = 4, dim: int = 32, hidden: int = 32, max_length: int = 128,
             class_weight="balanced", seed: int = 42) -> TextModel:
    """Fit on rows (id, text, target 0/1); without ``validation`` the last epoch is used. Rows
    without a target are left out."""
    spark = train.sparkSession
    folder = scratch_path(spark, "textnet")
    named = lambda df, part: df.select("id", "text", F.col("target").cast("double").alias("target"), F.lit(part).alias("set"))
    rows = named(train, "train") if validation is None else named(train, "train").unionByName(named(validation, "validation"))
    rows = rows.filter("target is not null").withColumn("row", F.monotonically_increasing_id())
    rows.write.parquet(f"{folder}/rows")  # row numbers are given once
    rows = spark.read.parquet(f"{folder}/rows")
    size = {r["target"]: r["count"] for r in rows.filter("set = 'train'").groupBy("target").count().collect()}  # two classes
    if not size:
        raise ValueError("there are no rows to learn from")
    weights = {c: sum(size.values()) / (len(size) * n) for c, n in size.items()} if class_weight == "balanced" else dict(enumerate(class_weight))
    enc = encode_subwords(rows, "text", "row", automaton, max_length).drop("n_tokens")
    weight = F.when(F.col("target") == 1, F.lit(float(weights.get(1, 1.0)))).otherwise(F.lit(float(weights.get(0, 1.0))))
    rows.drop("text").join(enc, "row").select(
        "id", "row", "set", F.col("target").alias("y"), weight.alias("weight"), F.col("input_ids").alias("ids"), F.col("attention_mask").alias("mask"),
        F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(parts)).cast("int").alias("part")).write.parquet(f"{folder}/encoded")
    rows = spark.read.parquet(f"{folder}/encoded")
    vocabulary = 1 + max((i for d in automaton.ids for i in d.values()), default=3)
    net = Net.new(vocabulary, dim, hidden, seed)
    for epoch in range(1, epochs + 1):
        net = _epoch(rows.filter("set = 'train'"), net, rate * (1 - (epoch - 1) / epochs), decay, batch, parts, seed, epoch)
        spark.createDataFrame([(epoch, i, list(w.shape), bytearray(w.tobytes())) for i, w in enumerate(net.w)],
                              "epoch int, place int, shape array<int>, data binary").write.mode("append").parquet(f"{folder}/models")
        _scores(rows, net, "id", "set", "y", "weight").select(
            F.lit(epoch).alias("epoch"), F.col("set").alias("part"), "id", F.col("y").alias("target"), "weight", "p") \
            .write.mode("append").parquet(f"{folder}/predictions")
    done = _history(spark.read.parquet(f"{folder}/predictions")).collect()  # a row per epoch
    best = min(done, key=lambda r: (r["val_loss"], r["epoch"]))["epoch"] if validation is not None and done[0]["val_loss"] is not None else epochs
    return TextModel(spark, folder, automaton, max_length, best)
