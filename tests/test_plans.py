"""Plan-shape checks: the scale properties the README claims, asserted on the
executed plans of registered queries."""

import importlib

import pytest

from tests.conftest import SF_SMALL

CHEAP = ["labelled_subset", "unlabelled_subset", "class_distribution", "stratified_split", "stratified_kfold",
         "undersample", "roc_curve", "pr_auc", "macro_metrics", "repeat_rate", "prior_centroid_distance",
         "period_join", "smote", "adasyn", "smote_enn", "knn_exact", "tfidf", "dedupe_exact",
         "flagship_masked_split_baseline", "mask_terms_longest", "leakage_scan", "embed_text"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    q = importlib.import_module("__spark_entry__").queries()
    return {n: _plan(q[n](spark, SF_SMALL)) for n in CHEAP}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoopJoin" in p]
    assert not bad


def test_label_policy_filter_reaches_scan(plans):
    p = plans["labelled_subset"]
    assert "DataFilters: [o_orderstatus" in p and "IN (F,O)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p


def test_scans_are_pruned(plans):
    # the class distribution reads one column of events, the split two of labels
    assert "ReadSchema: struct<event_type:string>" in plans["class_distribution"]
    assert "struct<doc_id:bigint,toxic:int>" in plans["stratified_split"]


def test_hot_class_spreads_over_range_partitions(spark):
    """A class holding 90 % of the rows is numbered by many tasks, not one."""
    from pyspark.sql import functions as F

    from balsam.functions.random import uniform
    from balsam.operators.order import positions
    df = spark.range(20000).select(F.col("id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("c"))
    df = df.withColumn("u", uniform("s", F.col("id")))
    pos = positions(df, [F.col("c"), F.col("u"), F.col("id")], "pos", num_partitions=8)
    parts = pos.where("c = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 6
