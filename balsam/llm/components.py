"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b: long): the smallest vertex reachable.

    Each round takes the smallest label among the neighbours (a map-side combined aggregation)
    and then the label of the label, so a path halves in each round. Labels are checkpointed in
    the shared folder once a round; only the count of changes comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) \
        .filter("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                         .select("v", F.least("v", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b") \
            .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"),
                                             F.least("label", "m").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("label").alias("ll"))
        new = cut_lineage(step.join(jump, "l", "left")
                          .select("v", "old", F.least("l", F.coalesce("ll", "l")).alias("label")))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            return labels
