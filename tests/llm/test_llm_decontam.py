import random
import re

import pytest

from balsam.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in (t or "")))


def brute(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[p:p + k]), set()).add(str(i))
    out = []
    for key, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                found = grams.get(tuple(w[p:p + k]))
                if found:
                    ids |= found - {"None"}
                    hit |= set(range(p, p + k))
        out.append((key, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(4)
    vocab = ["Alpha", "beta", "ГАММА", "Été", "delta9", "e", "f"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "--", " ¿"]) for _ in range(n))
    items = [(i, text(rnd.randint(1, 30))) for i in range(12)] + [(90, "two words"), (91, ""), (92, None), (10, "..."), (None, "alpha beta without an id")]
    docs = [(i, text(rnd.randint(0, 80)) + rnd.choice(["", items[i % 12][1], "x two WORDS y", "x Alpha; beta without-an id"]) + text(3))
            for i in range(60)]
    docs += [(1, docs[1][1]), (1, docs[1][1]), (None, items[0][1]), (200, None), (201, ""), (202, " .,;"),
             (203, items[3][1] * 400)]
    return docs, items


@pytest.mark.parametrize("max_set", [decontam.MAX_SET, 0])
def test_hits_match_brute_force(spark, case, max_set):
    docs, items = case
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(d, b, max_set=max_set).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=repr) == brute(docs, items)


@pytest.mark.parametrize("max_set", [decontam.MAX_SET, 0])
def test_removal_cuts_the_hit_words_only(spark, max_set):
    item = "one two three four five six seven eight nine ten eleven"
    rest = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"Before. {rest}, ONE two three, four five six seven eight nine ten! After it.", "a"),
            (2, rest, "b"), (3, item, "c"), (4, None, "d"), (5, "", "e"), (2, rest, "f")]
    d = spark.createDataFrame(docs, "doc_id long, text string, words__ string") \
        .withColumnRenamed("words__", "hits__").selectExpr("*", "hits__ as words__", "doc_id as t", "doc_id as r")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = decontam.remove_contamination(d, b, max_set=max_set)
    assert out.columns == d.columns
    got = sorted((r["doc_id"], r["text"], r["hits__"], r["t"]) for r in out.collect() if r["text"] is not None)
    assert got == [(1, f"Before. {rest}! After it.", "a", 1), (2, rest, "b", 2), (2, rest, "f", 2), (5, "", "e", 5)]
    assert out.filter("text is null").count() == 1


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = decontam.find_contamination(d, none).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (2, 0, [])
    assert decontam.remove_contamination(d, none).count() == 1
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.find_contamination(d.limit(0), b).count() == 0


def test_documents_are_not_shuffled_for_removal(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontam.remove_contamination(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
