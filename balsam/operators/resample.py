"""Class rebalancing by synthetic or repeated minority rows (F1-F9).

Input: (id long >= 0, x array<double>, target int); :func:`resample_by_name` takes ids of
any type. Output: the
input rows plus new rows with negative ids -(g+1), g = 0.. the synthetic index,
and the lineage columns ``base_id``, ``nn_id``, ``step`` (null for input rows).

Every random choice is u(seed, g) (see :mod:`balsam.functions.random`):
base position floor(u(seed:b, g) * n) in id order, neighbour rank
floor(k * u(seed:n, g)) + 1, step u(seed:s, g). Synthetic rows are generated
from ``spark.range`` (evenly partitioned) or from per-base counts expanded in
bounded chunks, so no single row or task fans out an unbounded number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from balsam.functions.random import uniform, uniform_value
from balsam.functions.vectors import lerp
from balsam.operators.knn import knn as _knn_exact
from balsam.operators.knn import knn_approx
from balsam.operators.order import positions, running_totals

_LINEAGE = ["base_id", "nn_id", "step"]
EXPAND_CHUNK = 4096


class NotApplicable(ValueError, RuntimeError):
    """A method cannot work on these rows (too few of a class, no neighbour of another class)."""


def _counts(df: DataFrame, target: str = "target") -> dict[int, int]:
    rows = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    return {int(r[0]): int(r[1]) for r in rows}


def minority_majority(df: DataFrame, target: str = "target") -> tuple[int, int, int, int]:
    """(minority label, majority label, n_min, n_maj) for a binary target."""
    c = _counts(df, target)
    if len(c) != 2:
        raise ValueError(f"binary target expected, got classes {sorted(c)}")
    (lo, n_lo), (hi, n_hi) = sorted(c.items(), key=lambda kv: (kv[1], -kv[0]))
    return lo, hi, n_lo, n_hi


def _with_lineage(df: DataFrame) -> DataFrame:
    cols = df.columns
    out = df
    for c, t in (("base_id", "long"), ("nn_id", "long"), ("step", "double")):
        if c not in cols:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out.select("id", "x", "target", *_LINEAGE)


def _positioned(df: DataFrame) -> DataFrame:
    """(pos, id, x) with pos dense in id order."""
    return positions(df.select("id", "x"), [F.col("id")], "pos")


def _synthetic_from_draws(draws: DataFrame, bases: DataFrame, nn: DataFrame, pool: DataFrame,
                          minority: int, step_scale: float = 1.0) -> DataFrame:
    """draws (g, bpos, rk, step) + positioned bases + neighbour table -> new rows.

    step_scale 1.0 interpolates towards the neighbour; a negative scale moves
    away from it (x = b + scale * u * (n - b))."""
    b = bases.select(F.col("pos").alias("bpos"), F.col("id").alias("base_id"), F.col("x").alias("xb"))
    p = pool.select(F.col("id").alias("nn_id"), F.col("x").alias("xn"))
    t = F.col("step") * F.lit(float(step_scale))
    return (_drawn_neighbour(draws.join(b, "bpos"), nn).join(p, "nn_id")
            .select((-(F.col("g") + 1)).cast("long").alias("id"), lerp(F.col("xb"), F.col("xn"), t).alias("x"),
                    F.lit(minority).cast("int").alias("target"), "base_id", "nn_id", "step"))


def _drawn_neighbour(draws: DataFrame, nn: DataFrame) -> DataFrame:
    """Adds nn_id: the neighbour of ``base_id`` at rank floor(u * n) + 1 of the n that it has (k,
    or fewer from an approximate search); a base without any is its own neighbour, so that no
    draw is lost."""
    near = nn.groupBy(F.col("q_id").alias("base_id")) \
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "nn_id"))), lambda s: s["nn_id"]).alias("near"))
    at = F.floor(F.col("u") * F.size("near")).cast("int")
    return draws.join(near, "base_id", "left") \
        .withColumn("nn_id", F.coalesce(F.get("near", at), F.col("base_id"))).drop("near", "u")


def _uniform_draws(spark, n: int, n_bases: int, k: int, seed: str, offset: int = 0) -> DataFrame:
    g = spark.range(offset, offset + n).withColumnRenamed("id", "g")
    return g.select("g", F.floor(uniform(f"{seed}:b", F.col("g")) * n_bases).cast("long").alias("bpos"),
                    uniform(f"{seed}:n", F.col("g")).alias("u"),
                    uniform(f"{seed}:s", F.col("g")).alias("step"))


def expand_counts(df: DataFrame, count_col: str, out: str = "j", chunk: int = EXPAND_CHUNK) -> DataFrame:
    """One row per j in [0, count): first split each count into chunks of at most
    ``chunk`` (a bounded explode), spread the chunks, then expand each chunk."""
    c = df.select("*", F.explode(F.sequence(F.lit(0), F.greatest(
        F.ceil(F.col(count_col) / chunk) - 1, F.lit(-1)).cast("long"))).alias("__c"))
    c = c.where(F.col(count_col) > 0).repartition("__c", *[x for x in df.columns if x != count_col][:1])
    lo = F.col("__c") * chunk
    hi = F.least(F.col(count_col), lo + chunk) - 1
    return c.select("*", F.explode(F.sequence(lo, hi)).alias(out)).drop("__c")


#: What the methods of one :func:`resample_summary` have made for each other, while it runs.
_MADE: ContextVar[dict | None] = ContextVar("made", default=None)


def _once(what: tuple, df: tuple[DataFrame, ...], make: Callable):
    """``make()``; inside :func:`resample_summary` what it gave before for the same ``what`` and the same rows."""
    made = _MADE.get()
    if made is None:
        return make()
    before = made.setdefault((what, tuple(d.semanticHash() for d in df)), [])
    for own, out in before:
        if all(a.sameSemantics(b) for a, b in zip(own, df)):
            return out
    before.append((df, make()))
    return before[-1][1]


def knn(queries: DataFrame, refs: DataFrame, k: int, approx: bool = False, **kw) -> DataFrame:
    """Neighbour search used by every method: exact by default; ``approx=True``
    switches to the nearest cells only, for sets too large for an exact all-pairs search
    (e.g. ENN / Tomek over a very large resampled set)."""
    if approx:
        return knn_approx(queries, refs, k, **kw)
    if _MADE.get() is None:
        return _knn_exact(queries, refs, k, **kw)
    by_k = _once(("knn", *sorted(kw.items())), (queries, refs), dict)
    have = min((j for j in by_k if j >= k), default=None)
    if have is None:
        by_k[k], have = _cut(_knn_exact(queries, refs, k, **kw)), k
    return by_k[have] if have == k else by_k[have].where(F.col("rank") <= k)  # of the exact search, the first ones of more


def class_plan(df: DataFrame, target: str = "target") -> list[tuple[int, int, int, int]]:
    """Library default strategy ('not majority'): every class other than the majority
    (largest count, smallest label on ties) is brought up to the majority count.
    Returns (class, n_c, G_c, offset) in class order; offsets give each class its own
    range of synthetic indices g, so ids -(g+1) stay unique. Binary input gives one
    entry with offset 0."""
    c = _counts(df, target)
    if len(c) < 2:
        raise ValueError(f"at least two classes expected, got {sorted(c)}")
    major = min(c, key=lambda lab: (-c[lab], lab))
    plan, off = [], 0
    for lab in sorted(c):
        if lab == major:
            continue
        g = c[major] - c[lab]
        plan.append((lab, c[lab], g, off))
        off += g
    return plan


def _union(base: DataFrame, parts: list[DataFrame]) -> DataFrame:
    out = _with_lineage(base)
    for p in parts:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ methods

def random_oversample(df: DataFrame, seed: str = "42") -> DataFrame:
    """G_c = n_maj - n_c rows of each other class drawn with replacement (position by id)."""
    spark = df.sparkSession
    parts = []
    for cls, n_c, G, off in class_plan(df):
        base = _positioned(df.where(F.col("target") == cls))
        draws = spark.range(off, off + G).withColumnRenamed("id", "g").select(
            "g", F.floor(uniform(f"{seed}:b", F.col("g")) * n_c).cast("long").alias("pos"))
        parts.append(draws.join(base, "pos")
                     .select((-(F.col("g") + 1)).cast("long").alias("id"), "x", F.lit(cls).alias("target"),
                             F.col("id").alias("base_id"), F.lit(None).cast("long").alias("nn_id"),
                             F.lit(None).cast("double").alias("step")))
    return _union(df, parts)


def smote(df: DataFrame, k: int = 5, seed: str = "42", **knn_kw) -> DataFrame:
    """SMOTE: x = b + u (n - b), b a row of the class, n one of its k neighbours in
    the same class; G_c points per non-majority class."""
    spark = df.sparkSession
    parts = []
    for cls, n_c, G, off in class_plan(df):
        if G <= 0:
            continue
        if n_c <= k:
            raise NotApplicable(f"smote needs more than k={k} rows of class {cls}, got {n_c}")
        members = df.where(F.col("target") == cls).select("id", "x")
        nn = knn(members, members, k, **knn_kw)
        draws = _uniform_draws(spark, G, n_c, k, seed, offset=off)
        parts.append(_synthetic_from_draws(draws, _positioned(members), nn, members, cls))
    return _union(df, parts)


def _majority_share(df: DataFrame, queries: DataFrame, m: int, mino: int, **knn_kw) -> DataFrame:
    """(id, n_maj): how many of the m nearest rows of the whole set are of another class."""
    nn = knn(queries, df.select("id", "x"), m, **knn_kw)
    lab = df.select(F.col("id").alias("nn_id"), F.col("target").alias("nt"))
    return (nn.join(lab, "nn_id").groupBy("q_id")
            .agg(F.sum((F.col("nt") != mino).cast("int")).alias("n_maj"))
            .withColumnRenamed("q_id", "id"))


def adasyn(df: DataFrame, k: int = 5, seed: str = "42", **knn_kw) -> DataFrame:
    """ADASYN: base i of class c gets g_i = rint(G_c r_i / sum r) points, r_i the share
    of other classes among its k nearest rows in the whole set; points as in SMOTE."""
    parts = []
    off = 0  # rounding makes a class's total differ from G_c: advance by the real count
    for cls, n_c, G, _ in class_plan(df):
        if G <= 0:
            continue
        if n_c <= k:
            raise NotApplicable(f"adasyn needs more than k={k} rows of class {cls}, got {n_c}")
        members = df.where(F.col("target") == cls).select("id", "x")
        share = _majority_share(df, members, k, cls, **knn_kw)
        tot = share.agg(F.sum("n_maj").alias("s")).first()["s"] or 0
        if tot == 0:
            raise NotApplicable(f"no neighbour of class {cls} rows belongs to another class: "
                               "ADASYN is not applicable")
        gi = share.select("id", F.rint(F.lit(float(G)) * F.col("n_maj") / F.lit(float(tot))).cast("long").alias("gi"))
        cum = running_totals(gi, [F.col("id")], ["gi"], ["cum"], inclusive=False)
        rows = expand_counts(cum, "gi", "j").select(
            F.col("id").alias("base_id"), (F.lit(off) + F.col("cum") + F.col("j")).alias("g"))
        off += int(cum.agg(F.sum("gi")).first()[0] or 0)
        draws = rows.select("g", "base_id", uniform(f"{seed}:n", F.col("g")).alias("u"),
                            uniform(f"{seed}:s", F.col("g")).alias("step"))
        nn = knn(members, members, k, **knn_kw)
        b = members.select(F.col("id").alias("base_id"), F.col("x").alias("xb"))
        p = members.select(F.col("id").alias("nn_id"), F.col("x").alias("xn"))
        parts.append(_drawn_neighbour(draws.join(b, "base_id"), nn).join(p, "nn_id")
                     .select((-(F.col("g") + 1)).cast("long").alias("id"),
                             lerp(F.col("xb"), F.col("xn"), F.col("step")).alias("x"),
                             F.lit(cls).cast("int").alias("target"), "base_id", "nn_id", "step"))
    return _union(df, parts)


def danger_set(df: DataFrame, m: int = 10, mino: int | None = None, **knn_kw) -> DataFrame:
    """Rows of class ``mino`` with m/2 <= (other classes among m nearest) < m: (id, x, n_maj)."""
    if mino is None:
        mino = minority_majority(df)[0]
    minority = df.where(F.col("target") == mino).select("id", "x")
    share = _majority_share(df, minority, m, mino, **knn_kw)
    danger = share.where((F.col("n_maj") * 2 >= m) & (F.col("n_maj") < m))
    return minority.join(danger, "id")


def borderline_smote(df: DataFrame, k: int = 5, m: int = 10, seed: str = "42", **knn_kw) -> DataFrame:
    """Borderline-SMOTE 1: per non-majority class, SMOTE from its danger rows towards
    their same-class neighbours; a class without danger rows is left unchanged."""
    spark = df.sparkSession
    parts = []
    for cls, n_c, G, off in class_plan(df):
        if G <= 0:
            continue
        danger = _cut(danger_set(df, m, cls, **knn_kw).select("id", "x"))
        n_d = danger.count()
        if n_d == 0:
            continue
        members = df.where(F.col("target") == cls).select("id", "x")
        nn = knn(danger, members, k, **knn_kw)
        draws = _uniform_draws(spark, G, n_d, k, seed, offset=off)
        parts.append(_synthetic_from_draws(draws, _positioned(danger), nn, members, cls))
    return _union(df, parts)


def beta_quantile(p: float, a: int, b: int) -> float:
    """The value that a beta(a, b) draw, ``a`` and ``b`` whole numbers, stays below with chance ``p``."""
    n = a + b - 1

    def below(x: float) -> float:
        return sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def kernel_map(df: DataFrame, landmarks: int = 256, gamma: float | None = None, seed: str = "42") -> DataFrame:
    """``df`` with ``phi`` array<double>: coordinates whose inner products are the kernel
    exp(-gamma |x - y|^2), by the Nystroem method over the ``landmarks`` rows with the smallest
    u(seed, id). The landmarks alone come to the driver. With as many landmarks as rows the kernel is
    exact. ``gamma`` is 1 / (columns x variance of all values) if it is not given."""
    if gamma is None:
        square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
        total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
        r = df.agg(F.sum(F.size("x")).alias("n"), F.sum(square).alias("q"), F.sum(total).alias("t"), F.max(F.size("x")).alias("d")).first()
        var = r["q"] / r["n"] - (r["t"] / r["n"]) ** 2
        gamma = 1.0 / (r["d"] * var) if var > 0 else 1.0
    picked = df.select("id", "x").orderBy(uniform(f"{seed}:l", F.col("id")), "id").limit(landmarks).collect()
    base = np.array([r["x"] for r in picked], float)
    norms = (base**2).sum(axis=1)

    def kernel(x: np.ndarray) -> np.ndarray:
        d2 = (x**2).sum(axis=1)[:, None] + norms - 2 * (x @ base.T)
        return np.exp(-gamma * np.maximum(d2, 0.0))

    values, vectors = np.linalg.eigh(kernel(base))
    on = values > 1e-10 * values[-1]
    root = vectors[:, on] / np.sqrt(values[on])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(at)
                phi = kernel(x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) @ root
                cells = pa.ListArray.from_arrays(np.arange(len(phi) + 1, dtype=np.int32) * phi.shape[1], phi.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "phi"])

    at = df.columns.index("x")
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("phi", ArrayType(DoubleType()))]))


def support_vectors(df: DataFrame, label: int, kernel: str = "rbf", landmarks: int = 256, gamma: float | None = None,
                    C: float = 1.0, max_iter: int = 100, seed: str = "42") -> DataFrame:
    """(id, x) of the rows of class ``label`` on or inside the margin of a soft-margin machine with
    cost ``C``, fitted on all rows: class ``label`` against the others, over the ``rbf`` or
    ``linear`` kernel. The tolerance is a thousandth of the margin, for the solver's last step."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if kernel not in ("rbf", "linear"):
        raise ValueError(f"kernel is rbf or linear, not {kernel}")
    plain = df.select("id", "x", "target")
    mapped = kernel_map(plain, landmarks, gamma, seed) if kernel == "rbf" else plain.withColumn("phi", F.col("x"))
    data = mapped.select("id", "x", (F.col("target") == label).cast("double").alias("label"), array_to_vector("phi").alias("features"))
    # the mean of the losses and half the squared norm, weighed as C times the sum of the losses does
    model = LinearSVC(maxIter=max_iter, regParam=1.0 / (C * df.count()), standardization=False, tol=1e-7).fit(data)
    raw = model.transform(data.where("label = 1"))
    return raw.where(vector_to_array("rawPrediction")[1] <= 1.001).select("id", "x")


def svm_smote(df: DataFrame, k: int = 5, m: int = 10, seed: str = "42", out_step: float = 0.5,
              fraction: float | None = None, kernel: str = "rbf", landmarks: int = 256,
              gamma: float | None = None, C: float = 1.0, max_iter: int = 100, **knn_kw) -> DataFrame:
    """SVM-SMOTE: minority support vectors of a machine with an RBF kernel (:func:`support_vectors`);
    noise (all m neighbours majority) dropped; danger ones interpolate, safe ones extrapolate
    by ``out_step``. The danger ones' share of the new rows is ``fraction``, or else a
    beta(10, 10) draw."""
    spark = df.sparkSession
    mino, _, n_min, n_maj = minority_majority(df)
    G = n_maj - n_min
    if fraction is None:
        fraction = beta_quantile(uniform_value(f"{seed}:f", 0), 10, 10)
    sv = support_vectors(df, mino, kernel, landmarks, gamma, C, max_iter, seed)
    sv = _cut(sv)
    share = _majority_share(df, sv, m, mino, **knn_kw)
    sv = sv.join(share, "id").where(F.col("n_maj") < m)  # drop noise
    sv = _cut(sv)
    danger = sv.where(F.col("n_maj") * 2 >= m).select("id", "x")
    safe = sv.where(F.col("n_maj") * 2 < m).select("id", "x")
    n_dg, n_sf = danger.count(), safe.count()
    minority = df.where(F.col("target") == mino).select("id", "x")
    if n_dg + n_sf == 0:
        raise NotApplicable("no support vector is left after noise removal: SVM-SMOTE is not applicable")
    # all G points are made whichever set is empty
    n_first = 0 if n_dg == 0 else G if n_sf == 0 else int(fraction * (G + 1))
    parts = [_with_lineage(df)]
    if n_first > 0:
        nn = knn(danger, minority, k, **knn_kw)
        parts.append(_synthetic_from_draws(_uniform_draws(spark, n_first, n_dg, k, seed),
                                           _positioned(danger), nn, minority, mino, 1.0))
    if G - n_first > 0:
        nn = knn(safe, minority, k, **knn_kw)
        parts.append(_synthetic_from_draws(_uniform_draws(spark, G - n_first, n_sf, k, seed + ":safe",
                                                          offset=n_first),
                                           _positioned(safe), nn, minority, mino, -out_step))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edited_nn(df: DataFrame, k: int = 3, classes: list[int] | None = None, **knn_kw) -> DataFrame:
    """Edited nearest neighbours ('all'): drop a row (of ``classes``, default every
    class) unless all of its k nearest rows share its class."""
    base = df.select("id", "x")
    nn = knn(base, base, k, **knn_kw)
    lab = df.select(F.col("id").alias("nn_id"), F.col("target").alias("nt"))
    own = df.select(F.col("id").alias("q_id"), F.col("target").alias("t"))
    bad = (nn.join(lab, "nn_id").join(own, "q_id")
           .where(F.col("nt") != F.col("t")).select(F.col("q_id").alias("id"), "t").distinct())
    if classes is not None:
        bad = bad.where(F.col("t").isin(classes))
    return df.join(bad.select("id"), "id", "left_anti")


def tomek_pairs(df: DataFrame, **knn_kw) -> DataFrame:
    """Rows that belong to a Tomek link: mutual nearest neighbours of different class."""
    base = df.select("id", "x")
    nn1 = knn(base, base, 1, **knn_kw).select("q_id", "nn_id")
    lab = df.select(F.col("id").alias("q_id"), F.col("target").alias("t"))
    a = nn1.join(lab, "q_id")
    b = a.select(F.col("q_id").alias("nn_id"), F.col("nn_id").alias("back"), F.col("t").alias("nt"))
    return (a.join(b, "nn_id").where((F.col("back") == F.col("q_id")) & (F.col("t") != F.col("nt")))
            .select(F.col("q_id").alias("id")))


def tomek_links(df: DataFrame, **knn_kw) -> DataFrame:
    """Remove both ends of every Tomek link."""
    return df.join(tomek_pairs(df, **knn_kw), "id", "left_anti")


def _cut(df: DataFrame) -> DataFrame:
    from balsam.session import cut_lineage
    return cut_lineage(df)


def _smote_rows(df: DataFrame, k: int, seed: str, **knn_kw) -> DataFrame:
    return _once(("smote", k, seed, *sorted(knn_kw.items())), (df,), lambda: _cut(smote(df, k, seed, **knn_kw)))


def smote_enn(df: DataFrame, k: int = 5, seed: str = "42", enn_k: int = 3, **knn_kw) -> DataFrame:
    """SMOTE, then edited nearest neighbours over both classes."""
    s = _smote_rows(df, k, seed, **knn_kw)
    return edited_nn(s, enn_k, **knn_kw)


def smote_tomek(df: DataFrame, k: int = 5, seed: str = "42", **knn_kw) -> DataFrame:
    """SMOTE, then Tomek-link removal over both classes."""
    s = _smote_rows(df, k, seed, **knn_kw)
    return tomek_links(s, **knn_kw)


RESAMPLERS = {
    "smote": smote,
    "adasyn": adasyn,
    "borderline_smote": borderline_smote,
    "svm_smote": svm_smote,
    "random_oversample": random_oversample,
    "smote_enn": smote_enn,
    "smote_tomek": smote_tomek,
}


def resample_by_name(df: DataFrame, name: str, seed: str = "42", **kw) -> DataFrame:
    """Dispatch by name; an unknown name raises KeyError. Ids of another type than integers are
    kept: the method works on their positions, and a new row's id is ``synthetic-{g}``."""
    if name not in RESAMPLERS:
        raise KeyError(f"unknown resampler {name!r}; known: {sorted(RESAMPLERS)}")
    if df.schema["id"].dataType.typeName() in ("long", "integer", "short", "byte"):
        return RESAMPLERS[name](df, seed=seed, **kw)
    placed = _once(("placed",), (df,), lambda: _cut(positions(df.select("id", "x", "target"), [F.col("id")], "pos")))
    out = RESAMPLERS[name](placed.select(F.col("pos").alias("id"), "x", "target"), seed=seed, **kw)
    for c in ("id", *[c for c in ("base_id", "nn_id") if c in out.columns]):
        names = placed.select(F.col("pos").alias(c), F.col("id").alias("name"))
        out = out.join(names, c, "left")
        new = F.concat(F.lit("synthetic-"), (-F.col(c) - 1).cast("string"))
        out = out.withColumn(c, F.when(F.col(c) < 0, new).otherwise(F.col("name"))).drop("name")
    return out


def resample_summary(df: DataFrame, names: list[str] | None = None, seed: str = "42") -> DataFrame:
    """(method, target, n) for every method over the same input. Each method is called; a search for the
    neighbours of the same rows among the same rows is made once for all of them."""
    out, token = None, _MADE.set({})
    try:
        for n in names or list(RESAMPLERS):
            c = resample_by_name(df, n, seed).groupBy("target").agg(F.count(F.lit(1)).alias("n")) \
                .select(F.lit(n).alias("method"), "target", "n")
            out = c if out is None else out.unionByName(c)
    finally:
        _MADE.reset(token)
    return out
