"""Exact order statistics without a single-partition window.

``Window.orderBy`` with no partition key funnels every row into one task. The
helpers here keep the work spread out:

* :func:`positions` — dense 0-based position in a total order: range-partition on
  the order key, sort within partitions, number rows inside each partition, and
  add per-partition offsets (one small table with one row per partition).
* :func:`running_totals` — prefix sums in a total order, same layout; the
  in-partition cumulative sum runs over Arrow batches.
* :func:`lowest_per_group` — flag the k smallest rows per group by a uniform key
  (u, id) with a histogram: no sort of the data at all, only two aggregations
  and a scan of one histogram cell per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from balsam.session import cut_lineage

_PID, _MID = "__pid", "__mid"


def _by_range(df: DataFrame, n: int | None, order_cols: list) -> DataFrame:
    """Rows dealt by order; the number of partitions is Spark's unless given."""
    dealt = df.repartitionByRange(n, *order_cols) if n else df.repartitionByRange(*order_cols)
    return dealt.sortWithinPartitions(*order_cols).withColumn(_PID, F.spark_partition_id())


def _partition_offsets(counts: DataFrame, value_cols: list[str]) -> DataFrame:
    """Exclusive prefix sums over partition ids (one row per partition: bounded)."""
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(_PID, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}__off")
                                 for c in value_cols])


def positions(df: DataFrame, order_cols: list, out: str = "pos",
              num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based position in the order of ``order_cols``.

    ``order_cols`` must define a total order (end with a unique key), otherwise
    ties are numbered in an unspecified but valid order.
    """
    # Materialised once (reliable checkpoint): range bounds come from a seeded
    # sample per exchange, so two separately planned exchanges of the same rows
    # may cut them differently; every later branch must read the same partitions.
    ranged = cut_lineage(_by_range(df, num_partitions, order_cols)
                         .withColumn(_MID, F.monotonically_increasing_id()))
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    counts = ranged.groupBy(_PID).agg(F.count(F.lit(1)).alias("n"))
    offs = _partition_offsets(counts, ["n"])
    return (ranged.join(F.broadcast(offs), _PID)
            .withColumn(out, (F.col("n__off") + local).cast("long"))
            .drop(_PID, _MID, "n__off"))


def running_totals(df: DataFrame, order_cols: list, value_cols: list[str],
                   out_cols: list[str] | None = None, inclusive: bool = True,
                   num_partitions: int | None = None, group_col: str | None = None) -> DataFrame:
    """Prefix sums of ``value_cols`` in the total order of ``order_cols``.

    ``inclusive`` adds the row's own value. Output columns are doubles for float inputs and longs
    for integral inputs. With ``group_col`` (which must lead the order) the sums begin anew at each
    group, so a group with large sums costs the next one no digits; a group may still run over any
    number of partitions.
    """
    out_cols = out_cols or [f"cum_{c}" for c in value_cols]
    ranged = _by_range(df, num_partitions, order_cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    integral = [types[c].typeName() in ("integer", "long", "short", "byte") for c in value_cols]
    out_types = [LongType() if i else DoubleType() for i in integral]
    schema = StructType(ranged.schema.fields
                        + [StructField(o, t, False) for o, t in zip(out_cols, out_types)])

    def _cumsum(batches):
        carry, last = None, None
        for pdf in batches:
            if not len(pdf):
                yield pdf.assign(**{o: [] for o in out_cols})
                continue
            vals = pdf[value_cols].fillna(0)
            if group_col is None:
                cs, cont = vals.cumsum(), slice(None)
            else:
                g = pdf[group_col]
                run = ((g != g.shift()) & ~(g.isna() & g.shift().isna())).cumsum()
                cs = vals.groupby(run.to_numpy()).cumsum()
                same = last is not None and (g.iloc[0] == last[0] or (g.isna().iloc[0] and last[1]))
                cont = (run == run.iloc[0]).to_numpy() if same else slice(0, 0)
                last = (g.iloc[-1], bool(g.isna().iloc[-1]))
            if carry is not None:
                cs.iloc[cont] = cs.iloc[cont] + carry
            carry = cs.iloc[-1].copy()
            if not inclusive:
                cs = cs - vals
            for o, c, is_int in zip(out_cols, value_cols, integral):
                pdf[o] = cs[c].astype("int64" if is_int else "float64")
            yield pdf

    # one materialisation feeds both the offsets and the rows (see positions())
    local = cut_lineage(ranged.mapInPandas(_cumsum, schema))
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in value_cols]
    if group_col is None:
        res = local.join(F.broadcast(_partition_offsets(local.groupBy(_PID).agg(*sums), value_cols)), _PID)
    else:
        # only groups that run over several partitions have offsets: two rows a partition at most
        totals = local.groupBy(_PID, F.col(group_col).alias("__group")).agg(*sums)
        w = Window.partitionBy("__group").orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
        offs = totals.select(F.col(_PID).alias("__opid"), "__group", F.count(F.lit(1)).over(w).alias("__earlier"),
                             *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}__off") for c in value_cols]) \
            .filter("__earlier > 0").drop("__earlier")
        res = local.join(F.broadcast(offs), (local[_PID] == F.col("__opid"))
                         & local[group_col].eqNullSafe(F.col("__group")), "left").drop("__opid", "__group")
    for o, c, t in zip(out_cols, value_cols, out_types):
        res = res.withColumn(o, (F.col(o) + F.coalesce(F.col(f"{c}__off"), F.lit(0))).cast(t))
    return res.drop(_PID, *[f"{c}__off" for c in value_cols])


HIST_BUCKETS = 1 << 20


def lowest_per_group(df: DataFrame, group_col: str, u_col: str, id_col: str,
                     quota, out: str = "selected", buckets: int = HIST_BUCKETS) -> DataFrame:
    """Flag, per group, the ``k`` rows with the smallest (u, id); exact.

    ``quota`` is a small table (group_col, k), or a function that makes it from the group counts
    (group_col, n_c). ``u_col`` must be uniform on [0, 1) (see :mod:`balsam.functions.random`),
    which keeps every histogram cell small: the rank is resolved by counting rows per (group,
    cell), locating the cell that holds the k-th row, and ranking only inside that one cell. The
    rows are read for the histogram and for the cut cells by their three columns, and once in
    full for the flags; the histogram is written once, and the thresholds, a row per group, are
    broadcast.
    """
    cell = F.floor(F.col(u_col) * buckets).cast("long")
    narrow = df.select(F.col(group_col).alias("g"), F.col(u_col).alias("u"), F.col(id_col).alias("i"), cell.alias("b"))
    hist = cut_lineage(narrow.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n")))
    if callable(quota):
        quota = quota(hist.groupBy(F.col("g").alias(group_col)).agg(F.sum("n").alias("n_c")))
    q = quota.select(F.col(group_col).alias("g"), F.col("k").cast("long").alias("k"))
    w = Window.partitionBy("g").orderBy("b")
    cum = hist.withColumn("cum", F.sum("n").over(w)).withColumn("prev", F.col("cum") - F.col("n"))
    # the cell that holds row number k (1-based), and the rank needed inside it
    cut = cut_lineage(cum.join(F.broadcast(q), "g").where((F.col("prev") < F.col("k")) & (F.col("cum") >= F.col("k")))
                      .select("g", F.col("b").alias("cut"), (F.col("k") - F.col("prev")).alias("need")))
    inside = narrow.join(F.broadcast(cut), "g").where(F.col("b") == F.col("cut"))
    rw = Window.partitionBy("g").orderBy("u", "i")
    thr = inside.withColumn("r", F.row_number().over(rw)).where(F.col("r") == F.col("need")) \
        .select("g", "cut", F.col("u").alias("tu"), F.col("i").alias("ti"))
    # groups whose k covers every row (or is 0) have no cut cell
    limits = q.join(thr, "g", "left").select(F.col("g").alias("__g"), F.struct("k", "cut", "tu", "ti").alias("__limit"))
    flagged = df.join(F.broadcast(limits), F.col(group_col) == F.col("__g"), "left").drop("__g")
    lim = lambda c: F.col(f"__limit.{c}")
    sel = (F.when(F.coalesce(lim("k"), F.lit(0)) <= 0, F.lit(False))
           .when(lim("cut").isNull(), F.lit(True))
           .when(cell < lim("cut"), F.lit(True))
           .when(cell > lim("cut"), F.lit(False))
           .otherwise((F.col(u_col) < lim("tu")) | ((F.col(u_col) == lim("tu")) & (F.col(id_col) <= lim("ti")))))
    return flagged.withColumn(out, sel).drop("__limit")
