import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from balsam.operators import features as FT


def test_repeat_count_brute_force(spark):
    rng = np.random.default_rng(0)
    base = dt.datetime(2024, 1, 1)
    rows = [(int(i), int(rng.integers(0, 4)), base + dt.timedelta(seconds=int(s)))
            for i, s in enumerate(rng.choice(10 * 86400, 500, replace=False))]
    df = spark.createDataFrame(rows, "k long, g long, ts timestamp_ntz")
    got = {r["k"]: r["n_prior"] for r in FT.repeat_count(df, "g", "ts", "k", 86400).collect()}
    for k, g, t in rows:
        want = sum(1 for k2, g2, t2 in rows if g2 == g and t - dt.timedelta(days=1) <= t2 < t)
        assert got[k] == want


def test_prior_centroid_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(rng.integers(0, 3)), float(i), float(rng.normal()), float(rng.normal()))
            for i in range(300)]
    df = spark.createDataFrame(rows, "k long, c int, t double, y double, x double")
    got = {r["k"]: r["dist_prior_centroid"] for r in
           FT.prior_centroid_distance(df, "c", [F.col("t")], "k", "y", "x").collect()}
    for k, c, t, y, x in rows:
        prev = [(y2, x2) for k2, c2, t2, y2, x2 in rows if c2 == c and t2 < t]
        if not prev:
            assert got[k] is None
        else:
            my, mx = np.mean(prev, axis=0)
            assert got[k] == pytest.approx(np.hypot(y - my, x - mx))


def test_haversine_and_buckets(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 4.999), (34.5, 69.2, 31.6, 65.7, 50.0)],
                               "a double, b double, c double, d double, v double")
    r = df.select(FT.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km")).collect()
    assert r[0]["km"] == pytest.approx(111.19, rel=1e-3)
    b = [x["bucket"] for x in FT.value_buckets(df, "v", [0, 1, 5, 10, 50]).collect()]
    assert b == [1, 3]  # last upper bound inclusive


def test_dedupe_exact_and_near(spark):
    rows = [(1, "Alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha  beta gamma delta epsilon zeta eta theta"),
            (3, "Alpha beta gamma delta epsilon zeta eta iota"), (4, "completely different words here now")]
    df = spark.createDataFrame(rows, "k long, t string")
    assert sorted(r["k"] for r in FT.dedupe_exact(df, "t", "k").collect()) == [1, 3, 4]
    near = sorted(r["k"] for r in FT.dedupe_near(df, "t", "k", threshold=0.5, num_hashes=32, band_rows=1).collect())
    assert near == [1, 4]


def test_bootstrap_and_calibration(spark):
    df = spark.createDataFrame([(i, float(i % 3 == 0), (i % 10) / 10) for i in range(300)],
                               "k long, v double, p double")
    r = FT.bootstrap_ci(df, "k", "v", replicates=30).first()
    assert r["lo"] <= r["mean"] <= r["hi"] and r["replicates"] == 30
    assert FT.brier(df, "v", "p").first()[0] >= 0
    assert 0 <= FT.ece(df, "v", "p").first()[0] <= 1
    assert FT.POISSON1_CDF[0] == pytest.approx(np.exp(-1))


def test_hot_key_prefix_sums(spark):
    """One user holds 40 % of the rows: the range-partitioned prefix counts must
    still equal the per-user window definition."""
    rng = np.random.default_rng(5)
    base = dt.datetime(2024, 1, 1)
    n = 2000
    users = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 50, n))
    secs = rng.choice(20 * 86400, n, replace=False)
    rows = [(int(i), int(users[i]), base + dt.timedelta(seconds=int(secs[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, g long, ts timestamp_ntz").repartition(8)
    got = {r["k"]: r["n_prior"] for r in FT.repeat_count(df, "g", "ts", "k", 3 * 86400).collect()}
    by_user = {}
    for k, g, t in rows:
        by_user.setdefault(g, []).append(t)
    for g in by_user:
        by_user[g].sort()
    import bisect
    for k, g, t in rows:
        ts = by_user[g]
        want = bisect.bisect_left(ts, t) - bisect.bisect_left(ts, t - dt.timedelta(days=3))
        assert got[k] == want


def test_near_copy_is_found_behind_a_chance_match(spark):
    """B and C are copies; A has a smaller key and shares bands with C by chance only."""
    import random
    kept = 0
    for i in range(12):
        rnd = random.Random(i)
        b = [f"w{rnd.randint(0, 10**6)}" for _ in range(60)]
        c = list(b)
        c[30] = "other"
        a = b[:38] + [f"v{rnd.randint(0, 10**6)}" for _ in range(22)]
        df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "k long, t string")
        got = sorted(r["k"] for r in FT.dedupe_near(df, "t", "k", threshold=0.8).collect())
        kept += 3 in got
        assert 1 in got and 2 in got
    assert kept == 0


def test_near_copies_match_all_pairs(spark):
    """Half-similar strangers with smaller keys, copies of copies and pairs close to the threshold."""
    import random
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    rows, head = [], [word() for _ in range(45)]
    for _ in range(30):  # families that share a part of their texts
        b = head[:rnd.randint(20, 45)] + [word() for _ in range(30)]
        rows.append(list(b))
        for _ in range(rnd.randint(0, 4)):
            b = list(rows[-1])
            b[rnd.randrange(len(b))] = word()
            if rnd.random() < 0.5:
                b[rnd.randrange(len(b))] = word()
            rows.append(b)
    rnd.shuffle(rows)
    sets = [{tuple(r[i:i + 3]) for i in range(len(r) - 2)} for r in rows]
    want = [i for i, x in enumerate(sets)
            if not any(len(x & y) >= 0.7 * len(x | y) for y in sets[:i])]
    assert 20 < len(want) < len(rows)
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "k long, t string")
    assert sorted(r["k"] for r in FT.dedupe_near(df, "t", "k").collect()) == want
    assert all((1 - 0.7 ** r) ** FT.bands_for(0.7, r) < 1e-6 for r in (1, 2, 3, 4))


def test_near_copies_join_the_sets_of_likely_pairs_only(spark, monkeypatch):
    """The order and the copies come out the same beyond the bounds, and sketches never lose a pair."""
    import random
    rnd = random.Random(7)
    shared = [[f"s{rnd.randint(0, 10**6)}" for _ in range(12)] for _ in range(3)]
    rows = []
    for i in range(60):  # strangers that share a passage, long and short, some with a near and an exact copy
        b = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([20, 60, 200]))] + shared[i % 3]
        rows.append(b)
        if i % 4 == 0:
            rows += [b[:-1] + ["other"], list(b), b[:rnd.choice([2, 16])]]
    sets = [{tuple(r[i:i + 3]) for i in range(len(r) - 2)} or {tuple(r)} for r in rows]
    first = [i for i, r in enumerate(rows) if r not in rows[:i]]
    want = [i for i in first if not any(j < i and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) for j in first)]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "k long, t string")
    of_keys, asked = FT._among, []
    monkeypatch.setattr(FT, "_among", lambda d, keys, key: (asked.append(keys.count()), of_keys(d, keys, key))[1])
    assert sorted(r["k"] for r in FT.dedupe_near(df, "t", "k").collect()) == want
    assert max(asked) < len(rows) / 3  # a set goes to a join only where a pair is likely
    plain = FT._shingle_sets(df, "t", "k", 3)
    order = lambda: {r["k"]: (r["shingles"], r["sketch"]) for r in FT.rare_first(plain, "k").collect()}
    inside = order()
    monkeypatch.setattr(FT, "MAX_COMMON", 0)
    monkeypatch.setattr(FT, "MAX_KEYS", 0)
    assert order() == inside and len(inside) == len(rows)
    assert sorted(r["k"] for r in FT.dedupe_near(df, "t", "k").collect()) == want


def test_near_copies_write_no_full_sets(spark, monkeypatch):
    """Short hashes, packed counts and a higher cut where too many shingles are common give all pairs' result."""
    import random
    rnd = random.Random(11)
    shared = [[f"s{rnd.randint(0, 10**6)}" for _ in range(9)] for _ in range(12)]
    rows = []
    for i in range(300):
        rows.append([f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([0, 2, 15, 30]))] + shared[int(12 * rnd.random() ** 2)] * (i % 3 > 0))
        if i % 5 == 0:
            rows.append(rows[-1][:-1] + ["other"])
    sets = [{tuple(r[i:i + 3]) for i in range(len(r) - 2)} or {tuple(r)} for r in rows]
    first = [i for i, r in enumerate(rows) if r not in rows[:i]]
    want = [i for i in first if not any(j < i and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) for j in first)]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "k long, t string").repartition(3)
    plain = FT._shingle_sets(df, "t", "k", 3)
    times = {}
    for r in plain.collect():
        for h in r["shingles"]:
            times[h >> 24] = times.get(h >> 24, 0) + 1
    assert {r["h"]: r["df"] for r in FT.shingle_counts(plain, 8).collect()} == {h: n for h, n in times.items() if n > 8}
    written, commons, cut, arranged = [], [], FT.cut_lineage, FT._arranged
    monkeypatch.setattr(FT, "cut_lineage", lambda d, *a: (written.append(d.columns), cut(d, *a))[1])
    monkeypatch.setattr(FT, "_arranged", lambda s, k, c=None: (commons.append(c if c is None else len(c[0])), arranged(s, k, c))[1])
    for most in (1_000_000, sum(n > 16 for n in times.values()) + 1):
        monkeypatch.setattr(FT, "MAX_COMMON", most)
        assert sorted(r["k"] for r in FT.dedupe_near(df, "t", "k").collect()) == want
    assert commons[0] > commons[1] > 0 and not any("shingles" in c for c in written)


def test_rows_of_one_time_do_not_count_for_each_other(spark):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:00:00"), (3, 1, "2024-01-01 12:00:00"),
            (4, 1, "2024-01-02 00:00:00"), (5, 2, "2024-01-01 06:00:00")]
    df = spark.createDataFrame(rows, "k long, g long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["k"]: r["n_prior"] for r in FT.repeat_count(df, "g", "ts", "k", 86400).collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: 3, 5: 0}


def test_prior_centroid_after_a_class_with_large_sums(spark):
    rows = [(i, "a", float(i), 1e15 + i, 1e15) for i in range(50)] + \
        [(100 + i, "b", float(i), 0.1 * i, 0.01 * i) for i in range(20)] + [(200, None, 0.0, 1.0, 1.0), (201, None, 1.0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "k long, c string, t double, y double, x double")
    got = {r["k"]: r["dist_prior_centroid"]
           for r in FT.prior_centroid_distance(df, "c", [F.col("t")], "k", "y", "x").collect()}
    for i in range(1, 20):
        my, mx = sum(0.1 * j for j in range(i)) / i, sum(0.01 * j for j in range(i)) / i
        assert got[100 + i] == pytest.approx(((0.1 * i - my) ** 2 + (0.01 * i - mx) ** 2) ** 0.5, abs=1e-12)
    assert got[100] is None and got[200] is None and got[201] == pytest.approx(5.0)


def test_period_of_centuries(spark):
    periods = spark.createDataFrame([("long", "1200-01-01", "2300-01-01"), ("day", "2024-01-01", "2024-01-02"), ("empty", "2024-01-01", "2024-01-01")],
                                    "p string, s string, e string").select(
        "p", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"))
    df = spark.createDataFrame([(1, "2024-01-01 23:59:59"), (2, "2024-01-02 00:00:00"), (3, "1100-01-01 00:00:00")], "k long, t string") \
        .withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = sorted((r["k"], r["p"]) for r in FT.period_join(df, "t", periods).collect())
    assert got == [(1, "day"), (1, "long"), (2, "long")]
    assert FT.period_join(df, "t", periods.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [500_000, 3, 0])
def test_tfidf_equals_a_plain_count(spark, frequent):
    """All terms broadcast, some of them, none; null, empty, long and repeated texts."""
    rows = [(1, "the cat saw the cat"), (2, None), (3, ""), (4, "the dog saw " * 2000), (5, "a dog"), (5, "a dog"), (None, "the end")]
    got = FT.tfidf(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", frequent=frequent).collect()
    counts, df = [], {}
    for k, t in rows:
        w = (t or "").split()
        c = {}
        for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            c[x] = c.get(x, 0) + 1
        counts.append((k, c))
        for x in c:
            df[x] = df.get(x, 0) + 1
    want = sorted(((str(k), x, n, round(n * math.log((len(rows) + 1) / (df[x] + 1)), 9)) for k, c in counts for x, n in c.items()))
    assert sorted((str(r["doc_id"]), r["term"], r["tf"], round(r["tfidf"], 9)) for r in got) == want
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert FT.tfidf(empty, "text", "doc_id", frequent=frequent).count() == 0


def test_tfidf_writes_words_in_chunks_and_no_row_of_a_term(spark, monkeypatch):
    """Many chunks and buckets give the plain counts; what is written has a row for each chunk."""
    import random
    from balsam.operators import chunks as CH
    rnd = random.Random(3)
    rows = [(None if i % 17 == 0 else f"k{i % 50}", None if i % 13 == 0 else " ".join(rnd.choice("aé bb ccc 4 dddd e f".split()) for _ in range(rnd.randint(0, 40))))
            for i in range(120)]
    written, cut = [], FT.cut_lineage
    monkeypatch.setattr(CH, "CHUNK_TOKENS", 100)
    monkeypatch.setattr(FT, "BUCKET_BYTES", 2_000, raising=False)
    monkeypatch.setattr(FT, "cut_lineage", lambda df, *a: (out := cut(df, *a), written.append(out.count()))[0])
    d = spark.createDataFrame(rows, "k string, t string").repartition(3)
    for ngrams in ((1, 2), (3,), (1, 1), ()):
        counts, df = [], {}
        for k, t in rows:
            w, c = (t or "").split(), {}
            for n in ngrams:
                for x in zip(*(w[j:] for j in range(n))):
                    c[" ".join(x)] = c.get(" ".join(x), 0) + 1
            counts.append((k, c))
            for x in c:
                df[x] = df.get(x, 0) + 1
        want = sorted((str(k), x, n, round(n * math.log((len(rows) + 1) / (df[x] + 1)), 9)) for k, c in counts for x, n in c.items())
        got = FT.tfidf(d, "t", "k", ngrams).collect()
        assert sorted((str(r["k"]), r["term"], r["tf"], round(r["tfidf"], 9)) for r in got) == want
    assert 5 < max(written) < 60


def test_encode_sequences_row_by_row(spark):
    from balsam.operators.text import build_vocabulary, encode_sequences
    rows = [("a", "one two two three"), ("b", None), ("b", ""), (None, "two one two three four five six seven"), ("a", "two")]
    d = spark.createDataFrame(rows, "k string, text string")
    vocab = build_vocabulary(d, "text", 3)
    got = sorted((str(r["k"]), r["input_ids"], r["attention_mask"], r["n_tokens"]) for r in encode_sequences(d, "text", "k", vocab, 6).fillna(0, ["n_tokens"]).collect())
    # ids by document frequency, then by token: two 4, one 5, three 6
    want = sorted([("a", [2, 5, 4, 4, 6, 3], [1] * 6, 4), ("a", [2, 4, 3, 0, 0, 0], [1] * 3 + [0] * 3, 1), ("b", [2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], 0),
                   ("None", [2, 4, 5, 4, 6, 3], [1] * 6, 8)])
    assert [g for g in got if g[0] != "b"] == [w for w in want if w[0] != "b"]
    assert [g[1:3] for g in got if g[0] == "b"] == [([2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0])] * 2
    assert encode_sequences(d.limit(0), "text", "k", vocab).count() == 0
