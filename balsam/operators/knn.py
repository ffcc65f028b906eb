"""k-nearest neighbours on Spark: exact (F0) and approximate (F0b).

Output: (q_id, rank, nn_id, d2) with rank 1..k, ordered by (squared distance, neighbour id); a
query's own id is excluded when ``exclude_self``. Ids keep their type; any type that orders will do.

The reference rows are put into cells around pivots (``cells`` reference rows, about the square
root of their number, at most 1,024; they go to the tasks, the rows never do). A cell knows the
smallest and the largest distance to its pivot.

* Exact search first looks into the query's nearest cells until they hold more than k rows. The
  k-th distance found bounds the rest: by the triangle inequality a cell whose ring around its
  pivot is farther than that cannot hold a neighbour and is not visited. On data with clusters
  that leaves a small part of all pairs; on data without any, all of them.
* Approximate search visits the nearest cells only. How many is measured on a fixed number of
  queries against the exact search, so that their recall reaches ``recall``.

A query is sent once to each unit that holds a cell it visits, with a bit for each cell; a unit is
neighbouring cells of together one block of rows, or a cell larger than that, split by a hash of
the id. A block has ``block_rows`` rows; on larger tables it has a ``BLOCKS``-th of the rows, up to
``MAX_VALUES`` numbers, so that rows are copied ``BLOCKS`` times at most until blocks are full.
Visits to a unit are cut into chunks of as many rows, so each task sees two bounded blocks however
popular a cell is. Only the k best of a block leave a task.

``strategy="broadcast"`` of :func:`knn` is for a caller who knows that the reference side is
small: it goes whole to every task and the queries stay where they are.

Distances are recomputed from differences (never ||a||^2 + ||b||^2 - 2ab), so ties and near ties
rank the same as a direct evaluation. A product in single precision only sorts out the pairs that
are farther than the bound by more than its rounding error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balsam.session import cut_lineage

_TENSOR_BUDGET = 1 << 20  # doubles of a difference tensor (8 MB)
MAX_CELLS = 1_024
#: Blocks that a table is cut into while they have no more than ``MAX_VALUES`` numbers (32 MB).
BLOCKS = 8
MAX_VALUES = 1 << 22
#: Queries whose distances to the pivots are worked on at once.
_SLICE = 1_024
#: Queries on which the approximate search measures its recall.
SAMPLE_QUERIES = 200


def _stack(col) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _distances(Q: np.ndarray, R: np.ndarray) -> np.ndarray:
    """Squared distances, from differences, in pieces of bounded size."""
    out = np.empty((len(Q), len(R)))
    step = max(1, _TENSOR_BUDGET // max(1, R.size))
    for s in range(0, len(Q), step):
        diff = Q[s:s + step, None, :] - R[None, :, :]
        out[s:s + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def topk_block(qid: np.ndarray, Q: np.ndarray, rid: np.ndarray, R: np.ndarray,
               k: int, exclude_self: bool) -> pd.DataFrame:
    """Exact top k of each query row against one block of reference rows."""
    names = ["q_id", "rank", "nn_id", "d2"]
    if len(qid) == 0 or len(rid) == 0:
        return pd.DataFrame({c: [] for c in names})
    order = np.argsort(rid, kind="stable")  # then the place of a column orders like its id
    rid, R = rid[order], R[order]
    parts = []
    step = max(1, _TENSOR_BUDGET // max(1, len(rid)))
    for s in range(0, len(qid), step):
        d2 = _distances(Q[s:s + step], R)
        if exclude_self:
            d2[qid[s:s + step, None] == rid[None, :]] = np.inf
        kk = min(k, len(rid))
        at = np.argpartition(d2, kk - 1, axis=1)[:, :kk]
        d = np.take_along_axis(d2, at, axis=1)
        kth = d.max(axis=1)
        for i in np.flatnonzero((d2 <= kth[:, None]).sum(axis=1) > kk):  # ties at the edge
            at[i] = np.flatnonzero(d2[i] <= kth[i])[np.argsort(d2[i][d2[i] <= kth[i]], kind="stable")[:kk]]
            d[i] = d2[i][at[i]]
        by = np.lexsort((at, d), axis=1)
        at, d = np.take_along_axis(at, by, axis=1), np.take_along_axis(d, by, axis=1)
        ok = np.isfinite(d)
        rank = np.broadcast_to(np.arange(1, kk + 1, dtype=np.int32), d.shape)
        parts.append(pd.DataFrame({"q_id": np.repeat(qid[s:s + step], kk)[ok.ravel()], "rank": rank[ok],
                                   "nn_id": rid[at[ok]], "d2": d[ok]}))
    return pd.concat(parts, ignore_index=True)


def _codes(qid: pa.Array, rid: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that order and equal each other as the ids do."""
    if pa.types.is_integer(qid.type) and pa.types.is_integer(rid.type) and not qid.null_count + rid.null_count:
        return qid.to_numpy(zero_copy_only=False).astype(np.int64), rid.to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pd.factorize(pd.Series([*qid.to_pylist(), *rid.to_pylist()], dtype=object), sort=True)[0]
    return codes[:len(qid)], codes[len(qid):]


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)
    if col.null_count:
        raise ValueError("a vector is null")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _needed(rid: np.ndarray, R: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest of any query: of equal vectors the k + 1 smallest ids
    (one may be the query's own), k rows of each."""
    same = np.unique(np.ascontiguousarray(R).view(np.dtype((np.void, R.shape[1] * R.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((rid, same))
    g, i = same[order], rid[order]
    new_g = np.append(True, g[1:] != g[:-1])
    new_i = new_g | np.append(True, i[1:] != i[:-1])
    at = np.arange(len(g))
    ids_before = np.cumsum(new_i) - 1
    rank = ids_before - np.maximum.accumulate(np.where(new_g, ids_before, 0))
    copy = at - np.maximum.accumulate(np.where(new_i, at, 0))
    return np.sort(order[(rank <= k) & (copy < k)])


class _Best:
    """The k nearest rows found so far of every query: distances and places, by (distance, id)."""

    def __init__(self, Q: np.ndarray, qid: np.ndarray, R: np.ndarray, rid: np.ndarray, k: int, limit: np.ndarray, exclude_self: bool):
        self.Q, self.qid, self.R, self.rid, self.k, self.limit, self.exclude_self = Q, qid, R, rid, k, limit, exclude_self
        self.d, self.at = np.full((len(Q), k), np.inf), np.full((len(Q), k), -1)
        # scaled to lengths up to 1: the products cannot overflow, and their error is bounded by the margin
        scale = max(np.abs(Q).max(initial=0.0), np.abs(R).max(initial=0.0)) * math.sqrt(Q.shape[1]) or 1.0
        q, r = Q / scale, R / scale
        self.unit = 1.0 / scale / scale if scale > 1e-150 else 0.0
        self.margin = 8 * (Q.shape[1] + 8) * float(np.finfo(np.float32).eps)
        self.qn = np.einsum("ij,ij->i", q, q)
        self.q32, self.r32 = (-2 * q).astype(np.float32), r.astype(np.float32)
        self.rn = np.einsum("ij,ij->i", r, r).astype(np.float32)

    def look(self, rows: np.ndarray, a: int, b: int) -> None:
        """Compare the queries ``rows`` with the reference rows from ``a`` to ``b``."""
        step = max(1, _TENSOR_BUDGET // (b - a))
        for s in range(0, len(rows), step):
            at = rows[s:s + step]
            near = self.q32[at] @ self.r32[a:b].T
            near += self.rn[a:b]
            known = np.minimum(self.limit[at], self.d[at, -1])
            most = known * self.unit - self.qn[at] + self.margin
            open_ = np.flatnonzero(~np.isfinite(known))
            if len(open_) and b - a > self.k:
                part = near[open_]
                if self.exclude_self:
                    part = np.where(self.qid[at[open_], None] == self.rid[None, a:b], np.float32(np.inf), part)
                most[open_] = np.partition(part, self.k - 1, axis=1)[:, self.k - 1].astype(float) + 2 * self.margin
            found = np.flatnonzero(near <= most.astype(np.float32)[:, None])
            for f in range(0, len(found), _TENSOR_BUDGET // 8):
                i, j = np.divmod(found[f:f + _TENSOR_BUDGET // 8], b - a)
                self._add(at[i], a + j)

    def _add(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.exclude_self:
            other = self.qid[i] != self.rid[j]
            i, j = i[other], j[other]
        step = max(1, _TENSOR_BUDGET // max(1, self.Q.shape[1]))
        d = np.empty(len(i))
        for s in range(0, len(i), step):
            diff = self.Q[i[s:s + step]] - self.R[j[s:s + step]]
            d[s:s + step] = np.einsum("ij,ij->i", diff, diff)
        ok = np.isfinite(d) & (d <= np.minimum(self.limit[i], self.d[i, -1]))
        i, j, d = i[ok], j[ok], d[ok]
        if not len(i):
            return
        rows = np.unique(i)
        old_i, old_c = np.nonzero(self.at[rows] >= 0)
        i = np.concatenate([i, rows[old_i]])
        j = np.concatenate([j, self.at[rows][old_i, old_c]])
        d = np.concatenate([d, self.d[rows][old_i, old_c]])
        order = np.lexsort((self.rid[j], d, i))
        i, j, d = i[order], j[order], d[order]
        at = np.arange(len(i))
        place = at - np.maximum.accumulate(np.where(np.append(True, i[1:] != i[:-1]), at, 0))
        keep = place < self.k
        self.d[i[keep], place[keep]], self.at[i[keep], place[keep]] = d[keep], j[keep]


def best_of_block(queries: pa.Table, refs: pa.Table, k: int, exclude_self: bool) -> pa.Table:
    """The k best reference rows of each query in the cells that its bits name, none beyond its bound."""
    Q, R = _matrix(queries["x"]), _matrix(refs["x"])
    out = pa.table({"q_id": queries["q_id"].slice(0, 0), "rank": pa.array([], pa.int32()),
                    "nn_id": refs["r_id"].slice(0, 0), "d2": pa.array([], pa.float64())})
    if not len(Q) or not len(R):
        return out
    qids, rids = queries["q_id"].combine_chunks(), refs["r_id"].combine_chunks()
    qid, rid = _codes(qids, rids)
    bound = queries["bound"].to_pandas().fillna(np.inf).to_numpy(float)
    cells = np.frombuffer(b"".join(queries["cells"].to_pylist()), np.uint8).reshape(len(Q), -1)
    cell = refs["cell"].to_numpy()
    keep = np.flatnonzero(np.isfinite(R).all(axis=1))
    keep = keep[_needed(rid[keep], R[keep], k)] if len(keep) else keep
    keep = keep[np.argsort(cell[keep], kind="stable")]
    R, rid, cell = R[keep], rid[keep], cell[keep]
    best = _Best(np.where(np.isfinite(Q), Q, 0.0), qid, R, rid, k, bound * bound * (1 + 1e-9), exclude_self)
    usable = np.isfinite(Q).all(axis=1)
    edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, int)
    for a, b in zip(edges, np.append(edges[1:], len(cell))):
        on = (cells[:, cell[a] >> 3] >> (7 - (cell[a] & 7))) & 1
        rows = np.flatnonzero((on == 1) & usable)
        for s in range(a, b, _TENSOR_BUDGET >> 8):
            best.look(rows, s, min(b, s + (_TENSOR_BUDGET >> 8)))
    i, c = np.nonzero(best.at >= 0)
    return pa.table({"q_id": qids.take(pa.array(i)), "rank": pa.array((c + 1).astype(np.int32)),
                     "nn_id": rids.take(pa.array(keep[best.at[i, c]])), "d2": pa.array(best.d[i, c])})


def _prep(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))


def _best(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy("d2", "nn_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("q_id", F.col("rank").cast("int").alias("rank"), "nn_id", "d2")


class CellIndex:
    """Reference rows in cells around pivots."""

    def __init__(self, refs: DataFrame, cells: int | None = None, block_rows: int = 2048):
        self.block_rows = block_rows
        self.n = refs.count()
        self.kind = refs.schema["id"].dataType.simpleString()
        m = max(1, min(cells or math.isqrt(self.n), MAX_CELLS))
        rows = refs.orderBy(F.xxhash64("id"), "id").limit(m).select("x").collect()  # m rows
        pivots = np.unique(_stack([r[0] for r in rows]), axis=0) if rows else np.zeros((0, 0))
        if len(pivots) > 1:  # neighbours along the widest direction are in the same unit
            centred = pivots - pivots.mean(axis=0)
            widest = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            pivots = pivots[np.argsort(centred @ widest, kind="stable")]
        self.pivots = pivots
        self.refs = cut_lineage(self._near(refs))
        got = self.refs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dp").alias("lo"),
                                            F.max("dp").alias("hi")).collect()  # a row per cell
        self.size, self.lo, self.hi = (np.zeros(len(self.pivots)) for _ in range(3))
        for r in got:
            self.size[r["cell"]], self.lo[r["cell"]], self.hi[r["cell"]] = r["n"], r["lo"], r["hi"]
        width = self.pivots.shape[1] if len(self.pivots) else 1
        self.rows = max(self.block_rows, min(-(-self.n // BLOCKS), MAX_VALUES // max(1, width)))
        self.unit, have = np.zeros(len(self.pivots), np.int32), 0.0
        for c in range(1, len(self.pivots)):
            have += self.size[c - 1]
            new = have + self.size[c] > self.rows
            self.unit[c], have = self.unit[c - 1] + new, 0.0 if new else have

    def _near(self, df: DataFrame) -> DataFrame:
        pivots = self.pivots

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), _SLICE):
                    b = whole.iloc[at:at + _SLICE]
                    d = np.sqrt(_distances(_stack(b["x"]), pivots))
                    cell = d.argmin(axis=1).astype(np.int32)
                    yield pd.DataFrame({"id": b["id"], "x": b["x"], "cell": cell, "dp": d[np.arange(len(b)), cell]})

        return df.mapInPandas(run, f"id {self.kind}, x array<double>, cell int, dp double")

    def _visits(self, queries: DataFrame, choose) -> DataFrame:
        """(id, x, bound, cells, units, pairs), a row per query: a bit for each cell that ``choose``
        names for the rows of a batch, given the distances to the pivots; their units; and their rows."""
        pivots, size, unit = self.pivots, self.size, self.unit
        kind = queries.schema["id"].dataType.simpleString()
        queries = queries if "bound" in queries.columns else queries.select("id", "x", F.lit(None).cast("double").alias("bound"))
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), _SLICE):
                    b = whole.iloc[at:at + _SLICE]
                    on = choose(np.sqrt(_distances(_stack(b["x"]), pivots)), b)
                    units = np.logical_or.reduceat(on, first, axis=1)
                    yield pd.DataFrame({"id": b["id"], "x": b["x"], "bound": b["bound"],
                                        "cells": [r.tobytes() for r in np.packbits(on, axis=1)],
                                        "units": [np.flatnonzero(r).astype(np.int32) for r in units],
                                        "pairs": (on @ size).astype(np.int64)})

        return queries.mapInPandas(run, f"id {kind}, x array<double>, bound double, cells binary, units array<int>, pairs long")

    def search(self, visits: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """The k best of each visited block: (q_id, rank, nn_id, d2)."""
        spark = visits.sparkSession
        visits = cut_lineage(visits)
        each = visits.select("id", "x", "bound", "cells", F.explode("units").alias("unit"))
        popular = {r["unit"]: r["count"] for r in each.groupBy("unit").count().collect()}  # a row per unit
        size = np.bincount(self.unit, self.size, minlength=1)
        plan = spark.createDataFrame([(u, max(1, math.ceil(size[u] / self.rows)), math.ceil(v / self.rows))
                                      for u, v in sorted(popular.items())], "unit int, blocks int, chunks int")
        of_cell = spark.createDataFrame([(c, int(u)) for c, u in enumerate(self.unit)], "cell int, unit int")
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        kind, own_kind = visits.schema["id"].dataType.simpleString(), self.kind
        none = lambda t: F.lit(None).cast(t)
        q = each.join(F.broadcast(plan), "unit").select(
            "unit", part("chunks").alias("chunk"), copies("blocks").alias("block"), F.lit(False).alias("is_ref"),
            F.col("id").alias("q_id"), none(own_kind).alias("r_id"), "x", "bound", "cells", F.lit(-1).alias("cell"))
        r = self.refs.join(F.broadcast(of_cell.join(plan, "unit")), "cell").select(
            "unit", part("blocks").alias("block"), copies("chunks").alias("chunk"), F.lit(True).alias("is_ref"),
            none(kind).alias("q_id"), F.col("id").alias("r_id"), "x", none("double").alias("bound"), none("binary").alias("cells"), "cell")

        def run(rows: pa.Table) -> pa.Table:
            is_ref = rows["is_ref"]
            return best_of_block(rows.filter(pa.compute.invert(is_ref)), rows.filter(is_ref), k, exclude_self)

        return q.unionByName(r).groupBy("unit", "block", "chunk").applyInArrow(
            run, f"q_id {kind}, rank int, nn_id {own_kind}, d2 double")

    def first_visits(self, queries: DataFrame, k: int) -> DataFrame:
        size = self.size

        def choose(d, _):
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            out = np.zeros(d.shape, bool)
            np.put_along_axis(out, order, before <= k, axis=1)
            return out & (size > 0)

        return self._visits(queries, choose)

    def other_visits(self, queries: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
        """Cells beyond the first ones that can hold a row within each query's bound."""
        size, lo, hi = self.size, self.lo, self.hi
        rows = queries.join(bounds, queries["id"] == bounds["q_id"], "left").select("id", "x", "bound")

        def choose(d, b):
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, order, before <= k, axis=1)
            bound = b["bound"].fillna(np.inf).to_numpy()[:, None]
            least = np.maximum(np.maximum(d - hi, lo - d), 0)
            return ~first & (size > 0) & (least <= bound * (1 + 1e-9) + 1e-9)

        return self._visits(rows, choose)

    def nearest_visits(self, queries: DataFrame, probes: int) -> DataFrame:
        size = self.size

        def choose(d, _):
            order = np.argsort(np.where(size > 0, d, np.inf), axis=1, kind="stable")[:, :probes]
            out = np.zeros(d.shape, bool)
            np.put_along_axis(out, order, True, axis=1)
            return out & (size > 0)

        return self._visits(queries, choose)

    def exact(self, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        near = cut_lineage(_best(self.search(self.first_visits(queries, k), k, exclude_self), k))
        bounds = near.where(F.col("rank") == k).select("q_id", F.sqrt("d2").alias("bound"))
        more = self.search(self.other_visits(queries, bounds, k), k, exclude_self)
        return _best(near.unionByName(more), k)

    def pairs(self, visits: DataFrame) -> int:
        """Distances that ``visits`` ask for."""
        return int(visits.agg(F.sum("pairs")).first()[0] or 0)


def _empty(queries: DataFrame, refs: DataFrame) -> DataFrame:
    q, r = queries.schema["id"].dataType.simpleString(), refs.schema["id"].dataType.simpleString()
    return queries.sparkSession.createDataFrame([], f"q_id {q}, rank int, nn_id {r}, d2 double")


def knn(queries: DataFrame, refs: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "x",
        exclude_self: bool = True, strategy: str = "cells", cells: int | None = None,
        block_rows: int = 2048) -> DataFrame:
    """Exact kNN of every query row among ``refs``."""
    q, r = _prep(queries, id_col, vec_col), _prep(refs, id_col, vec_col)
    if strategy == "broadcast":
        return _knn_broadcast(q, r, k, exclude_self)
    if strategy != "cells":
        raise ValueError(f"strategy is 'cells' or 'broadcast', not {strategy!r}")
    index = CellIndex(r, cells, block_rows)
    return index.exact(q, k, exclude_self) if index.n else _empty(q, r)


def _knn_broadcast(q: DataFrame, r: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    spark = q.sparkSession
    pdf = r.toPandas()  # small by the caller's word
    if not len(pdf):
        return _empty(q, r)
    bc = spark.sparkContext.broadcast((pdf["id"].to_numpy(), _stack(pdf["x"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield topk_block(b["id"].to_numpy(), _stack(b["x"]), *bc.value, k, exclude_self)

    return q.mapInPandas(run, _empty(q, r).schema)


def knn_approx(queries: DataFrame, refs: DataFrame, k: int = 5, id_col: str = "id",
               vec_col: str = "x", exclude_self: bool = True, recall: float = 0.95,
               cells: int | None = None, block_rows: int = 2048) -> DataFrame:
    """Approximate kNN: each query visits its nearest cells only. Their number is the smallest
    power of two that reaches ``recall`` on ``SAMPLE_QUERIES`` queries. A query that sees fewer
    than k rows in its cells has fewer neighbours."""
    q, r = _prep(queries, id_col, vec_col), _prep(refs, id_col, vec_col)
    index = CellIndex(r, cells, block_rows)
    if not index.n:
        return _empty(q, r)
    sample = cut_lineage(q.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE_QUERIES))
    truth = cut_lineage(index.exact(sample, k, exclude_self)).select("q_id", "nn_id")
    total, probes = truth.count(), 1
    while probes < len(index.pivots):
        found = _best(index.search(index.nearest_visits(sample, probes), k, exclude_self), k)
        if found.join(truth, ["q_id", "nn_id"], "left_semi").count() >= recall * total:
            break
        probes *= 2
    return _best(index.search(index.nearest_visits(q, probes), k, exclude_self), k)
