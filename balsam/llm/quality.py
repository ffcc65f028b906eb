"""Quality classifier: supervised subword embeddings.

Every word gives its hashed form, its hashed character n-grams and a hashed pair with the next
word. Each hash has a learned vector; a document is the mean of the vectors of all its features,
and a softmax over two classes reads it. Vectors and softmax are fitted in one task by plain
stochastic gradient descent in numpy, on at most ``max_rows`` labelled documents (whole texts,
sent as feature counts).

The mean and the softmax are linear up to the last step, so scoring needs one number per feature:
the difference of the two classes' outputs. A task sums it per distinct word once and then per
document over whole Arrow batches.

Cases: a null or empty text has no features and gets the bias alone; with no labelled rows every
score is 0.5; repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import fitted, give_back, training_rows

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
#: Words remembered by a task; a memory bound without effect on results.
CACHE = 150_000
_P, _Q = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of whole words; and (word number, bucket) of their words and character n-grams, for
    all ``words`` at once. ``\\x02`` and ``\\x03`` mark a word's ends."""
    text = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    begin = np.cumsum(size) - size
    at = np.arange(len(c)) - begin[owner]
    # a word's hash: the sum of its characters, each multiplied by a power for its place
    power = np.empty(int(size.max()) if len(size) else 1, np.uint32)
    power[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(len(power) - 1, _P, np.uint32), out=power[1:])
        whole = np.add.reduceat((c * _Q ^ (c >> np.uint32(3))) * power[at], begin, dtype=np.uint32) \
            if len(words) else np.empty(0, np.uint32)
        whole = (whole ^ (whole >> np.uint32(15))) * _Q
        owners, buckets = [np.arange(len(words))], [whole % np.uint32(BUCKETS)]
        for n in GRAMS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ c[i:len(c) - n + 1 + i]) * _P
                h ^= h >> np.uint32(13)
            inside = owner[:len(h)] == owner[n - 1:]
            owners.append(owner[:len(h)][inside])
            buckets.append(((h * _Q) >> np.uint32(7))[inside] % np.uint32(BUCKETS))
    return whole, np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def pairs(h: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; a word after itself is the same feature for all words."""
    with np.errstate(over="ignore"):
        x = (h[:-1] * _P ^ h[1:]) * _Q
    x = np.where(h[:-1] == h[1:], np.uint32(1), x ^ (x >> np.uint32(15)))
    return (x % np.uint32(BUCKETS)).astype(np.int64)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    distinct, of, times = np.unique(np.array(words, object), return_inverse=True, return_counts=True)
    whole, owner, bucket = subwords(distinct.tolist())
    count = np.bincount(bucket, weights=times[owner], minlength=BUCKETS)
    count += np.bincount(pairs(whole[of]), minlength=BUCKETS)
    ids = np.flatnonzero(count)
    return ids, count[ids].astype(np.int64)


@dataclass
class Model:
    """Per bucket the difference between the outputs of class 1 and class 0, and of the biases."""

    scores: np.ndarray
    bias: float


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 16, epochs: int = 6,
        rate: float = 0.5, seed: int = 5) -> Model:
    """Stochastic gradient descent over (buckets, counts, label)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    total, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, n, y = rows[i]
            lr = rate * (1 - step / total)
            step += 1
            share = (n / max(1, n.sum())).astype(np.float32)
            v = share @ vectors[ids]
            z = out @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out.T @ p
            out -= lr * np.outer(p, v)
            bias -= lr * 0.1 * p
            # the mean divides a document's step among its features; give each its due
            vectors[ids] -= (lr * 20 * share)[:, None] * back[None, :]
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 4000,
          key: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_rows`` labelled documents that are not held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()),
                 pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary()),
                 batch.column(1)], names=["h", "ids", "n", "y"])

    def all_rows(data: pa.Table | None) -> Model:
        if data is None:
            return fit([])
        # views of the column's own memory, not copies
        ids, n = ([np.frombuffer(x.as_buffer(), np.int32) for x in data.column(c)] for c in ("ids", "n"))
        return fit([(i, k, 1 if y > 0 else 0) for i, k, y in zip(ids, n, data.column("y").to_pylist()) if len(i)])

    sample = training_rows(docs, labels, target, max_rows, key, text_col)
    return fitted(sample.mapInArrow(run, "h long, ids binary, n binary, y int"), all_rows)


class Scorer:
    """Scores batches of texts with the sums of words seen before."""

    def __init__(self, model: Model):
        self.m = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.hash, self.sum, self.n = np.empty(0, np.uint32), np.empty(0), np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        words = [(t or "").split() for t in texts]
        if len(self.place) > CACHE:
            self._clear()
        new = [w for w in dict.fromkeys(w for ws in words for w in set(ws)) if w not in self.place]
        if new:
            whole, owner, bucket = subwords(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.hash = np.append(self.hash, whole)
            self.sum = np.append(self.sum, np.bincount(owner, self.m.scores[bucket], len(new)))
            self.n = np.append(self.n, np.bincount(owner, minlength=len(new)))
        get, out = self.place.__getitem__, np.full(len(texts), self.m.bias)
        for i, ws in enumerate(words):
            if ws:
                at = np.fromiter(map(get, ws), np.int64, len(ws))
                two = pairs(self.hash[at])
                out[i] += (self.sum[at].sum() + self.m.scores[two].sum()) / (self.n[at].sum() + len(two))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, score) of every row: the probability of label 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scorer(part.column(1).to_pylist()), pa.float64())],
                    names=["key", "score"])
        del scorer
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_col).mapInArrow(run, f"key {kind}, score double") \
        .withColumnRenamed("key", key)
