import hashlib
import random
import re

import pytest

from balsam.llm import spotsigs as S
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def signatures(t):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in (t or "")))
    if not w:
        return frozenset()
    content = [i for i, x in enumerate(w) if x not in S.ANCHORS]
    out = set()
    for i, x in enumerate(w):
        if x in S.ANCHORS and (i + 1 == len(w) or w[i + 1] not in S.ANCHORS):
            chain = [w[j] for j in content if j > i][:S.CHAIN]
            if len(chain) == S.CHAIN:
                out.add((x, *chain))
    return frozenset(out) or frozenset([tuple(w)])


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def make(n, seed):
    rnd = random.Random(seed)
    vocab = ["the", "of", "der", "la", "a"] + [f"w{i}" for i in range(40)] + ["Été", "ß9"]
    return [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("group", [2_000, 4])
def test_comparisons_match_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(S.grouped_by_order, "__defaults__", (group,))
    texts = make(50, 1) + ["the of", "x", "日本 語", "a" * 5000]
    rows = [(i * i, t, "g") for i, t in enumerate(texts)] + [(7000, None, "g"), (7001, "", "g")]
    d = spark.createDataFrame(rows, "doc_id long, text string, g__ string")
    got = {r["doc_id"]: r for r in S.compare_with_next(d).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for i, (k, t, _) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[k]
        assert r["n_chars"] == len(t) and hashlib.sha256(r["edited"].encode()).hexdigest() == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(signatures(t), signatures(edited)))
        assert r["near_next"] == pytest.approx(jaccard(signatures(t), signatures(nxt)))
        assert len(r["sigs"]) == len(signatures(t))


@pytest.mark.parametrize("kind", ["string", "wide", "outlier", "nulls"])
def test_keys_of_any_type_and_spread(spark, kind, monkeypatch):
    monkeypatch.setattr(S.grouped_by_order, "__defaults__", (4,))
    texts = make(60, 3) + [None, ""]
    key = {"string": lambda i: f"k{i * 7 % 100:03d}", "wide": lambda i: (-1) ** i * (2 ** 63 - 1 - i), "outlier": lambda i: i if i else 2 ** 50,
           "nulls": lambda i: None if i < 55 else i}[kind]
    rows = [(key(i), t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'string' else 'long'}, text string")
    groups = S.grouped_by_order(d.fillna("", ["text"]), "doc_id").groupBy("g__").count().collect()
    assert len(groups) >= 10 and max(r["count"] for r in groups) <= 50
    got = S.compare_with_next(d).collect()
    assert len(got) == len(rows)
    if kind == "nulls":  # equal keys follow each other in an order of their hashes
        assert sum(r["doc_id"] is None for r in got) == 55
        return
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    edited = {}
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited[k] = t[:len(t) - half] + nxt[:half]
    assert {r["doc_id"]: r["edited"] for r in got} == edited


def test_repeated_rows_null_keys_and_empty_tables(spark):
    rows = [(1, "the cat sat down here"), (1, "the cat sat down here"), (None, "x"), (None, "y"), (3, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.compare_with_next(d).collect()
    assert len(got) == 5
    assert all(r["near_next"] is not None for r in got)
    assert S.compare_with_next(d.limit(0)).count() == 0
    assert S.compare_with_next(d.filter("doc_id is null")).count() == 2


def test_equal_texts_have_equal_fingerprints(spark):
    t = make(1, 5)[0]
    d = spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")
    a, b = (r[0] for r in S.fingerprints(d).select(S.as_text(F.col("signatures"))).collect())
    assert a == b


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(9)
    texts = []
    for t in make(25, 2):
        w = t.split()
        for _ in range(4):
            v = list(w)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if v:
                    v[rnd.randrange(len(v))] = f"new{rnd.randint(0, 9)}"
            texts.append(" ".join(v))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (5, texts[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [signatures(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    want = sorted((k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows))
    got = S.near_duplicates(d).collect()
    assert sorted((r["doc_id"], r["n_signatures"], r["component_id"]) for r in got) == want


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "the cat sat down here")], "doc_id long, text string")
    plan = S.compare_with_next(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
