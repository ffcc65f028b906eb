import re

import corpus_pipeline
import pytest
from balsam.llm import decontam, pii, toxicity
from balsam.llm.common import read

from tests.llm.test_llm_decontam import words
from tests.llm.test_llm_minhash import brute as near_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(rows before, rows after, frame after) of each stage."""
    docs, out = read(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs.collect(), docs)
    return out


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    columns = read(spark, SF, "documents").columns
    for name in list(stages)[:-1]:
        assert stages[name][2].columns == columns
        assert all(r["n_chars"] == len(r["text"]) for r in stages[name][1])


def test_toxicity_drops_what_scores_high(spark, stages):
    before, after, _ = stages["toxicity"]
    model = toxicity.train(read(spark, SF, "documents"), read(spark, SF, "labels", "doc_id", "toxic"))
    w = toxicity._Weights(model)
    want = {r["doc_id"] for r in before if toxicity.scores([r["text"]], w, model.bias)[0] < 0.3}
    assert {r["doc_id"] for r in after} == want


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near-duplicates"]
    want = {k for k, n, c in near_groups([(r["doc_id"], r["text"]) for r in before], 5, 80) if k == c}
    assert {r["doc_id"] for r in after} == want


def test_no_benchmark_window_is_left(spark, stages):
    before, after, _ = stages["decontamination"]
    grams = set()
    for r in read(spark, SF, "benchmark").collect():
        w = words(r["text"])
        k = min(10, len(w))
        grams |= {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
    hits = lambda t: {i + j for g in {len(g) for g in grams} for i in range(len(words(t)) - g + 1)
                      if tuple(words(t)[i:i + g]) in grams for j in range(g)}
    old, new = {r["doc_id"]: r["text"] for r in before}, {r["doc_id"]: r["text"] for r in after}
    assert any(hits(t) for t in old.values())
    for k, t in old.items():
        h, w = hits(t), words(t)
        if not h:
            assert new[k] == t
        elif 2 * len(h) >= len(w):
            assert k not in new
        else:
            assert words(new[k]) == [x for i, x in enumerate(w) if i not in h]


def test_personal_data_is_masked(stages):
    before, after, _ = stages["personal-data"]
    decoder = pii.Decoder(pii.default_model())
    new = {r["doc_id"]: r["text"] for r in after}
    assert len(new) == len(before)
    for r in before:
        spans = pii.spans_of([r["text"]], decoder)[0]
        if not spans:
            assert new[r["doc_id"]] == r["text"]
        for _, s, e in spans:
            assert r["text"][s:e] not in new[r["doc_id"]]
        assert len(re.findall(r"<(?:EMAIL|IP|CARD|PHONE|NAME|SECRET)>", new[r["doc_id"]])) >= len(pii.merged(spans))


def test_mixing_keeps_every_row(stages):
    before, after, frame = stages["mixing"]
    assert sorted((r["doc_id"], r["text"]) for r in before) == sorted((r["doc_id"], r["text"]) for r in after)
    assert len({r["position"] for r in after}) == len(after)
    assert frame.columns[-5:] == ["block", "release", "deadline", "slot", "position"]


def test_run_is_the_stages_in_turn(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.collect()) == sorted(stages["mixing"][1])


@pytest.mark.parametrize("index", range(5))
def test_stages_take_odd_rows(spark, index):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "y"), (None, "some text here", "en", None, 14, "z"),
            (3, "the same words " * 40, "en", "a", 600, "u"), (4, "the same words " * 40, "en", "a", 600, "v"),
            (5, "word " * 30_000, "en", "b", 150_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string") \
        .selectExpr("*", "key as words__", "key as v", "key as s", "key as n", "key as h", "key as row", "key as y__")
    name, stage = corpus_pipeline.STAGES[index]
    out = stage(spark, docs, SF)
    got = out.collect()
    assert out.columns[:len(docs.columns)] == docs.columns
    assert len(got) == (5 if name == "near-duplicates" else 6)
    assert stage(spark, docs.limit(0), SF).count() == 0
