"""Nearest milestones of events (J5): an as-of join in both directions.

Events and milestones are dealt by range of (key, time); inside a partition a window gives each event
the last milestone before it and the first one after it. What a partition's first events miss is
carried in from the partitions before: one row per key and partition, the latest milestone so far; and
likewise backwards. A period full of events, or a key with a third of them, runs over any number of
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balsam.session import cut_lineage


def nearest_milestones(events: DataFrame, milestones: DataFrame, ts: str, milestone_ts: str, by: list[str] | None = None,
                       partitions: int | None = None) -> DataFrame:
    """``events`` with ``previous`` (the latest milestone at or before the event) and ``next`` (the first one
    after it), null where there is none, of the same ``by`` columns, which both tables have. Null keys
    are a key; events without a time have neither; milestones without a time are left out."""
    by = by or []
    kind = events.schema[ts].dataType
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    keys = [F.col(c).alias(f"b{i}") for i, c in enumerate(by)]
    names = [f"b{i}" for i in range(len(by))]
    ev = events.select(*keys, F.col(ts).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("m"), row.alias("row"))
    ms = milestones.filter(F.col(milestone_ts).isNotNull()).select(
        *keys, F.col(milestone_ts).cast(kind).alias("t"), F.lit(0).alias("kind"), F.col(milestone_ts).cast(kind).alias("m"),
        F.lit(None).cast(ev.schema["row"].dataType).alias("row")).dropDuplicates([*names, "t"])
    both = ev.filter("t is not null").unionByName(ms)
    order = [*names, "t", "kind"]
    # written once: the bounds of the ranges come from a sample
    dealt = both.repartitionByRange(partitions, *order) if partitions else both.repartitionByRange(*order)
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part", *names)
    # both frames grow from their first row: one that shrinks is worked out anew for every row
    rows = dealt.withColumn("p", F.max("m").over(here.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("n", F.min("m").over(here.orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1))).filter("kind = 1")
    # one row per key and partition; keys that lie in one partition have nothing to carry
    ends = dealt.groupBy("part", *names).agg(F.max("m").alias("hi"), F.min("m").alias("lo"))
    of = lambda *order: (Window.partitionBy(*names).orderBy(*order) if names else Window.orderBy(*order)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", *names, F.max("hi").over(of("part")).alias("before"), F.min("lo").over(of(F.desc("part"))).alias("after")) \
        .filter("before is not null or after is not null")
    same = [F.col("r.part") == F.col("c.part"), *[F.col(f"r.{n}").eqNullSafe(F.col(f"c.{n}")) for n in names]]
    found = rows.alias("r").join(carried.alias("c"), same, "left").select(
        "r.row.*", F.coalesce("r.p", "c.before").alias("previous"), F.coalesce("r.n", "c.after").alias("next"))
    without = events.filter(F.col(ts).isNull()).select("*", *[F.lit(None).cast(kind).alias(c) for c in ("previous", "next")])
    return found.unionByName(without)
