import random
import re

import pytest
from pyspark.sql import functions as F

from balsam.functions import text as T
from balsam.operators.text import leakage_scan, mask_text


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_group_masking_listed_order_residue(spark):
    out = _apply(spark, ["Tehrik-i-Taliban fighters", "Islamic State Khorasan Province (ISKP)",
                         "Talibanized", "TALIBAN and Daesh", None, "éTaliban"],
                 T.mask_patterns_ordered)
    assert out[0] == "Tehrik-i- fighters"
    assert out[1] == "Province (ISKP)"
    assert out[2] == "Talibanized"
    assert out[3] == "and"
    assert out[4] is None           # non-string passes through
    assert out[5] == "éTaliban"  # accented neighbour: no word boundary


def test_longest_first_and_whitespace(spark):
    terms = ["Dawlat Shah", "Shah Wali Kot", "Kot"]
    out = _apply(spark, ["near Dawlat Shah Wali Kot today", "a b\t c  d \u001c e "],
                 lambda c: T.mask_terms_longest(c, terms))
    assert out == ["near Dawlat today", "a b c d e"]


def test_order_safe_groups_split_inverting_pairs():
    groups = T.order_safe_groups(["Dawlat Shah", "Shah Wali Kot", "Farah", "Ahmadabad"])
    flat = [t for g in groups for t in g]
    assert flat == T.longest_first(["Dawlat Shah", "Shah Wali Kot", "Farah", "Ahmadabad"])
    assert not any("Dawlat Shah" in g and "Shah Wali Kot" in g for g in groups)


def _seq_py(s, terms):
    for t in T.longest_first(terms):
        s = re.sub(r"\b" + re.escape(t) + r"\b", "", s, flags=re.IGNORECASE)
    return s


def _grp_py(s, terms):
    for g in T.order_safe_groups(terms):
        s = re.sub(r"\b(?:" + "|".join(re.escape(t) for t in g) + r")\b", "", s, flags=re.IGNORECASE)
    return s


def test_grouped_equals_sequential_randomised():
    rnd = random.Random(7)
    words = ["Shah", "Wali", "Kot", "Dawlat", "Abad", "Sayyid", "Khel", "Musa", "Qala", "Nad", "Ali"]
    terms = sorted({" ".join(rnd.sample(words, rnd.randint(1, 3))) for _ in range(40)})
    terms += ["Dawlat Shah", "Shah Wali Kot", "Musa Qala", "Qala Nad Ali", "Sayyid Khel", "Khel Abad Kot"]
    seps = [" ", "  ", ", ", "-", ".", "x"]
    for _ in range(3000):
        s = "".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randint(1, 10)))
        assert _grp_py(s, terms) == _seq_py(s, terms), s
    # one alternation over the whole list is not equal (the reason for groups)
    one = lambda s: re.sub(r"\b(?:" + "|".join(re.escape(t) for t in T.longest_first(terms)) + r")\b", "", s,
                           flags=re.IGNORECASE)
    diffs = 0
    for _ in range(3000):
        s = "".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randint(1, 10)))
        diffs += one(s) != _seq_py(s, terms)
    assert diffs > 0


def test_spark_grouped_equals_spark_sequential(spark):
    rnd = random.Random(3)
    words = ["the", "of", "and", "to", "in", "is", "on"]
    terms = ["the", "of", "and", "of the", "the of", "and the", "to the", "in the"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    a = _apply(spark, texts, lambda c: T.mask_terms_longest(c, terms))
    b = _apply(spark, texts, lambda c: T.mask_terms_sequential(c, terms))
    assert a == b


def test_mask_text_switches_and_missing_column(spark, events_fixture):
    with pytest.warns(UserWarning):
        out = mask_text(events_fixture, ["notes", "no_such_column"], mask_locations=False)
    got = {r["row_id"]: r["notes"] for r in out.collect()}
    assert got["e03"] == ""  # fillna('') before masking
    assert got["e01"] == "Tehrik-i- fighters"
    off = mask_text(events_fixture, ["notes"], mask_entities=False, mask_locations=False, fill=False)
    assert {r["row_id"]: r["notes"] for r in off.collect()}["e01"] == "Tehrik-i-Taliban fighters"


def test_leakage_scan_full_table(spark):
    df = spark.createDataFrame([(1, "the Taliban"), (2, "islamic state x"), (3, "clean"), (4, None)],
                               "k int, t string")
    r = {x["term_set"]: x for x in leakage_scan(df, "t", "k").collect()}
    assert r["taliban"]["n_hits"] == 1 and r["taliban"]["first_key"] == 1
    assert r["isis"]["n_hits"] == 1 and r["isis"]["first_key"] == 2
    assert r["isis"]["n_rows"] == 4


def test_encoder_hook_equals_jvm_encoder(spark):
    from balsam.operators.text import embed_text, embed_with
    df = spark.createDataFrame([(1, "The cat, the Hat!"), (2, ""), (3, "Élan vital; élan")], "k long, t string")
    a = {r["k"]: r["embedding"] for r in embed_text(df, "t", "k", dim=16).collect()}
    b = {r["k"]: r["embedding"] for r in embed_with(df, "t", "k", dim=16, batch_size=2).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])
    assert a[2] == [0.0] * 16
