"""A learned text embedding (D7): truncated SVD of TF-IDF by randomised subspace iteration.

Words fall into ``buckets`` columns by hash, so that a row of the matrix is worked out inside its
document and the factors have a size that does not depend on the data. For a basis Q of the columns'
space one pass over the documents adds up A'(A Q): every task multiplies its rows, in blocks over the columns that they have, by Q and
back, and only the rows of the product leave it, which Spark sums by column. The driver orthonormalises
(buckets x rank) numbers and starts the next pass. After the last one, (A Q)'(A Q), of rank x rank
numbers, turns Q to the singular vectors. A text's embedding is its row times these, scaled to length
1; a null, empty or wordless text has zeros.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.session import cut_lineage

_WORD = re.compile(r"[^\W_]+")
#: Documents that are multiplied at once.
BLOCK = 256


def _rows(texts: list[str | None], buckets: int, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the texts, in order of rows; each row scaled to length 1 with ``idf``."""
    row, col, val = [], [], []
    for i, t in enumerate(texts):
        found = Counter(zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in _WORD.findall((t or "").lower()))
        row += [i] * len(found)
        col += found.keys()
        val += found.values()
    r, c, v = np.array(row, np.int64), np.array(col, np.int64), np.array(val, float)
    return (r, c, v) if idf is None else (r, c, _weighted(r, c, v, len(texts), idf))


def _weighted(r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """The values of ``n`` rows of counts, each row scaled to length 1."""
    v = np.log1p(v) * idf[c]
    norm = np.sqrt(np.bincount(r, v * v, n))
    return v / np.where(norm > 0, norm, 1.0)[r]


def _dense(r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, matrix): the columns that the sparse rows have, and the rows over these alone."""
    columns, at = np.unique(c, return_inverse=True)
    out = np.zeros((n, len(columns)))
    out[r, at.ravel()] = v
    return columns, out


def _times(r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """The sparse rows times ``q``."""
    columns, rows = _dense(r, c, v, n)
    return rows @ q[columns]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            yield part, part.column(column).to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, column, count, rows) of up to ``BLOCK`` counted documents."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            cols, counts = (b.column(i).slice(at, BLOCK) for i in range(2))
            r = np.repeat(np.arange(len(cols)), cols.value_lengths().to_numpy())
            yield r, cols.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(float), len(cols)


_VECTOR = "at int, v binary"


def _summed(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Vectors added up by their number."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[at] = sums.get(at, 0.0) + np.frombuffer(v)
        if sums:
            yield _vectors(list(sums), list(sums.values()))

    return {r["at"]: np.frombuffer(r["v"]) for r in parts.repartition(tasks, "at").sortWithinPartitions("at", "v").mapInArrow(add, _VECTOR).collect()}


def _vectors(at, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([np.ascontiguousarray(r).tobytes() for r in rows], pa.binary())], names=["at", "v"])


@dataclass
class TextSVD:
    """``basis`` (buckets x dim) and singular values, with the idf of the buckets."""

    idf: np.ndarray
    basis: np.ndarray
    singular: np.ndarray

    def transform(self, df: DataFrame, text_col: str, key: str, out: str = "embedding", scale: bool = True) -> DataFrame:
        """(key, embedding): rows of A V, of length 1 with ``scale``."""
        shared = df.sparkSession.sparkContext.broadcast((self.idf, self.basis))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, basis = shared.value
            for part, texts in _texts(batches, 1):
                x = _times(*_rows(texts, len(idf), idf), len(texts), basis)
                if scale:
                    norm = np.sqrt((x * x).sum(1, keepdims=True))
                    x = x / np.where(norm > 0, norm, 1.0)
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["key", out])

        kind = df.schema[key].dataType.simpleString()
        return df.select(key, text_col).mapInArrow(run, f"key {kind}, {out} array<double>").withColumnRenamed("key", key)


def fit_svd(df: DataFrame, text_col: str, dim: int = 384, buckets: int = 8192, passes: int = 2, extra: int = 10,
            seed: int = 42) -> TextSVD:
    """Fit on all rows of ``df``. ``dim`` is at most ``buckets``; ``extra`` columns and more ``passes`` make
    the result more exact."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            r, c, v = _rows(texts, buckets, None)
            ends = pa.array(np.searchsorted(r, np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (c, v.astype(np.int32))], names=["cols", "counts"])

    # the words are looked for once; the passes read their columns and counts
    docs = cut_lineage(df.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(words, "cols array<int>, counts array<int>"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sc, rank = df.sparkSession.sparkContext, min(buckets, dim + extra)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(buckets + 1)
        for _, c, _, n in _blocks(batches):
            have[:-1] += np.bincount(c, minlength=buckets)
            have[-1] += n
        yield _vectors([0], [have])

    have = _summed(docs.mapInArrow(count, _VECTOR), 1).get(0, np.zeros(buckets + 1))
    idf = np.log((have[-1] + 1) / (have[:-1] + 1)) + 1.0

    def product(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, total, touched = shared.value, None, np.zeros(buckets, bool)
            for r, c, v, n in _blocks(batches):
                if not len(r):
                    continue
                columns, rows = _dense(r, c, _weighted(r, c, v, n, idf), n)
                total = np.zeros((buckets, q.shape[1])) if total is None else total
                total[columns] += rows.T @ (rows @ q[columns])
                touched[columns] = True
            some = np.flatnonzero(touched)
            if len(some):
                yield _vectors(some, total[some])
        return docs.mapInArrow(run, _VECTOR)

    def gram(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for r, c, v, n in _blocks(batches):
                y = _times(r, c, _weighted(r, c, v, n, idf), n, shared.value)
                total = total + y.T @ y
            if not np.isscalar(total):
                yield _vectors(range(len(total)), total)
        return docs.mapInArrow(run, _VECTOR)

    def matrix(parts: dict, n: int) -> np.ndarray:
        out = np.zeros((n, rank))
        for at, v in parts.items():
            out[at] = v
        return out

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, rank)))[0]
    for _ in range(passes + 1):
        shared = sc.broadcast(q)
        q = np.linalg.qr(matrix(_summed(product(shared), tasks), buckets))[0]
        shared.destroy()
    values, turn = np.linalg.eigh(matrix(_summed(gram(sc.broadcast(q)), tasks), rank))
    top = np.argsort(-values)[:dim]
    basis = q @ turn[:, top]
    sign = np.sign(basis[np.abs(basis).argmax(0), np.arange(len(top))])  # the largest entry of a vector is positive
    return TextSVD(idf, basis * np.where(sign == 0, 1, sign), np.sqrt(np.maximum(values[top], 0)))
