import numpy as np
import pytest

from balsam.llm import quality, toxicity
from balsam.llm.common import held_out, read
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return read(spark, SF, "documents", "doc_id", "text"), read(spark, SF, "labels")


def held_out_accuracy(scored, labels, target, threshold):
    rows = scored.filter(held_out(F.col("doc_id"))).join(labels, "doc_id") \
        .select((F.col("score") >= threshold).cast("int").alias("p"), F.col(target).alias("y")).collect()
    assert len(rows) > 50
    return float(np.mean([r["p"] == r["y"] for r in rows]))


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    assert held_out_accuracy(quality.score(docs, model), labels, "quality", 0.7) >= 0.97


def test_toxicity_on_held_out_rows(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents", "doc_id", "text")
    labels = read(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(docs, labels)
    assert held_out_accuracy(toxicity.score(docs, model), labels, "toxic", 0.3) >= 0.98
    # clean documents stay
    kept = toxicity.keep_clean(docs, model).select("doc_id")
    clean = labels.filter("toxic = 0").select("doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.01 * clean.count()


def test_identity_terms_do_not_move_the_score(tables):
    model = toxicity.train(*tables)
    w = toxicity._Weights(model)
    for frame in ("the {} in our town held a meeting", "a book about {}", "{}"):
        for group in toxicity.identity_groups():
            s = toxicity.scores([frame.format(x) for x in group], w, model.bias)
            assert s.max() < 0.3
            assert s.max() - s.min() < 0.03


def test_counterfactual_penalty_evens_identity_weights():
    h = lambda words: np.sort(np.array([toxicity.word_hash(x) for x in words.split()], np.int64))
    # one group is named in toxic rows only, another in clean rows only
    rows = [(h("muslims are here"), 1)] * 40 + [(h("christians are here"), 0)] * 40
    model = toxicity.fit(rows)
    gap = lambda m: abs(m.weights.get(toxicity.word_hash("muslims"), 0) - m.weights.get(toxicity.word_hash("christians"), 0))
    assert gap(model) < 1e-9


def test_stems_of_identity_terms_carry_no_weight():
    h = lambda t: np.sort(np.array([toxicity.word_hash(x) for x in toxicity.forms(toxicity.word_set(t))], np.int64))
    frames = ["the {} went to see a {} film", "{} live here near {}", "we met {} in the {} street"]
    # muslims and women are named in toxic rows only, the others in clean rows only
    rows = [(h(f.format(w, x)), y) for f in frames for x in ("long", "green", "quiet") for w, y in
            [("muslims", 1), ("women", 1), ("hindus", 1), ("christians", 0), ("men", 0), ("jews", 0)]] * 10
    model = toxicity.fit(rows)
    w = toxicity._Weights(model)
    for group in toxicity.identity_groups():
        s = toxicity.scores([f"the {x} live here" for x in group], w, model.bias)
        assert s.max() - s.min() < 1e-9


@pytest.mark.parametrize("op,target", [(quality, "quality"), (toxicity, "toxic")])
def test_edge_rows(spark, op, target):
    docs = spark.createDataFrame(
        [(1, None, "a", 1), (2, "", "b", 2), (3, "word " * 50_000, "c", 3), (3, "word " * 50_000, "c", 3),
         (None, "word", "d", 4), (5, "same text", "e", 5), (6, "same text", "f", 6)],
        "doc_id long, text string, key string, y__ int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 1), (5, 0)], f"doc_id long, {target} int")
    model = op.train(docs, labels)
    got = op.score(docs, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    s = {r["doc_id"]: r["score"] for r in got}
    assert s[1] == s[2] and s[5] == s[6]
    nothing = op.train(docs.limit(0), labels)
    assert op.score(docs.limit(0), nothing).count() == 0
    assert op.score(docs, nothing).count() == 7


def test_held_out_rows_are_not_learned_from(spark):
    """Labels of held-out rows do not change a score."""
    docs = read(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    labels = read(spark, "/root/testdata/sf0.001", "labels")
    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r[0]: r[1] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    b = {r[0]: r[1] for r in toxicity.score(docs, toxicity.train(docs, other)).collect()}
    assert a == b


def test_subwords_equal_one_word_at_a_time():
    ws = ["the", "Thé", "x", "worthless!!", "日本", "a" * 50]
    whole, owner, bucket = quality.subwords(ws)
    for i, w in enumerate(ws):
        one, _, b = quality.subwords([w])
        assert one[0] == whole[i]
        assert sorted(b.tolist()) == sorted(bucket[owner == i].tolist())
