import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from balsam.functions.random import uniform
from balsam.operators import split
from balsam.operators.order import lowest_per_group, positions, running_totals


def _df(spark, n=3000, k=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, k)), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, target int, v double")


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_positions_match_row_number(spark, parts):
    df = _df(spark).repartition(parts)
    got = {r["id"]: r["pos"] for r in positions(df, [F.col("v"), F.col("id")], "pos", 5).collect()}
    w = Window.orderBy("v", "id")
    ref = {r["id"]: r["p"] for r in df.select("id", (F.row_number().over(w) - 1).alias("p")).collect()}
    assert got == ref


def test_running_totals_match_pandas(spark):
    df = _df(spark)
    got = running_totals(df, [F.col("target"), F.col("v"), F.col("id")], ["v", "target"], ["cv", "ct"],
                         num_partitions=6).toPandas().sort_values(["target", "v", "id"])
    assert np.allclose(got["cv"].to_numpy(), got["v"].cumsum().to_numpy())
    assert (got["ct"].to_numpy() == got["target"].cumsum().to_numpy()).all()
    ex = running_totals(df, [F.col("id")], ["target"], ["c"], inclusive=False).toPandas().sort_values("id")
    assert (ex["c"].to_numpy() == (ex["target"].cumsum() - ex["target"]).to_numpy()).all()


@pytest.mark.parametrize("buckets", [1, 4, 1 << 20])
def test_lowest_per_group_exact(spark, buckets):
    df = _df(spark).withColumn("u", uniform("s", F.col("id")))
    quota = spark.createDataFrame([(0, 0), (1, 17), (2, 5000)], "target int, k long")
    got = lowest_per_group(df, "target", "u", "id", quota, "sel", buckets=buckets)
    sel = {r["id"] for r in got.where("sel").collect()}
    pdf = df.toPandas().sort_values(["u", "id"])
    want = set()
    for t, k in ((0, 0), (1, 17), (2, 5000)):
        want |= set(pdf[pdf.target == t].id.head(k))
    assert sel == want


def test_stratified_split_counts_and_determinism(spark):
    df = _df(spark)
    a = split.stratified_split(df, test_size=0.4, seed="42")
    n = df.count()
    n_test = a.where("is_test").count()
    assert n_test == int(np.ceil(0.4 * n))
    per = {r["target"]: r["c"] for r in a.where("is_test").groupBy("target").agg(F.count("*").alias("c")).collect()}
    tot = {r["target"]: r["c"] for r in df.groupBy("target").agg(F.count("*").alias("c")).collect()}
    for t in tot:
        assert abs(per[t] - 0.4 * tot[t]) <= 1
    ids = lambda d: sorted(r["id"] for r in d.where("is_test").collect())
    b = split.stratified_split(df.repartition(16), test_size=0.4, seed="42")
    c = split.stratified_split(df.coalesce(1), test_size=0.4, seed="42")
    assert ids(a) == ids(b) == ids(c)


def test_kfold_partitions_and_sizes(spark):
    df = _df(spark, n=1003)
    f = split.stratified_kfold(df, k=5, seed="7")
    pdf = f.toPandas()
    assert set(pdf.fold) == set(range(5)) and len(pdf) == 1003
    sizes = pdf.fold.value_counts().sort_index().to_numpy()
    assert sizes.max() - sizes.min() <= 1
    for _, g in pdf.groupby("target"):
        s = g.fold.value_counts().reindex(range(5), fill_value=0).to_numpy()
        assert s.max() - s.min() <= 1
    guard = {r["fold"]: r["usable"] for r in split.fold_guard(f).collect()}
    assert all(guard.values())


def test_undersample_and_errors(spark):
    df = _df(spark, k=2)
    n1 = df.where("target = 1").count()
    u = split.undersample(df, majority=0, size=100)
    assert u.where("target = 0").count() == 100 and u.where("target = 1").count() == n1
    with pytest.raises(ValueError):
        split.undersample(df, majority=0, size=10 ** 6)


def test_grouped_folds_keep_groups_together(spark):
    df = _df(spark).withColumn("g", F.col("id") % 37)
    f = split.grouped_kfold(df, "g", k=4)
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
