import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from balsam.llm import minhash_odd as M


def brute(docs, shingle, percent):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        k = min(shingle, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    inv = defaultdict(list)
    for i, s in enumerate(sets):
        n = defaultdict(int)
        for g in s:
            for j in inv[g]:
                n[j] += 1
            inv[g].append(i)
        for j, both in n.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(docs):
        r = find(i)
        if k is not None:
            low[r] = min(low.get(r, k), k)
    return sorted(((k, len(sets[i]), low.get(find(i), k)) for i, (k, _) in enumerate(docs)), key=repr)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 60))] for _ in range(25)]
    out = []
    for b in base:
        for _ in range(rnd.choice([1, 1, 2, 6])):
            w = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w).replace("w1", "W1", 1))
    rnd.shuffle(out)
    rows = list(enumerate(out))
    # a drifting family: neighbours are alike, the ends are not
    w = [rnd.choice(vocab) for _ in range(80)]
    for i in range(40):
        w[rnd.randrange(80)] = rnd.choice(vocab)
        rows.append((1000 + i, " ".join(w)))
    rows += [(3, out[3]), (3, out[3]), (3, "something else"), (None, out[0]), (None, "only here w5"), (None, "only here w5"),
             (500, None), (501, ""), (502, " \t "), (503, "single"), (504, "SINGLE"), (505, " ".join(vocab * 60))]
    return rows


@pytest.mark.parametrize("shingle", [2, 5])
def test_groups_match_brute_force(spark, docs, shingle):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = M.near_duplicates(d, shingle=shingle).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)
    want = brute(docs, shingle, 80)
    assert got == want


def test_representatives(spark, docs):
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, key string")
    out = M.keep_representatives(d, shingle=5)
    assert out.columns == d.columns
    want = {(k) for k, n, c in brute(docs, 5, 80) if k is not None and k == c}
    assert {r["doc_id"] for r in out.collect()} - {None} == want
    assert out.filter("text is null or trim(text) = ''").count() >= 2


def test_representatives_are_rows_not_keys(spark):
    rnd = random.Random(3)
    text = {n: " ".join(f"{n}{rnd.randrange(10**6)}" for _ in range(60)) for n in "abcdefg"}
    near = {n: t + " tail" for n, t in text.items()}
    rows = [(1, text["a"]), (None, near["a"]),  # a copy without a key goes, alone of the rows without one
            (None, text["b"]), (None, near["b"]), (None, text["b"]),  # one of these stays
            (None, text["c"]), (None, None), (None, " "),
            (7, near["a"]), (7, text["d"]),  # a key with a copy and a text of its own
            (8, text["e"]), (8, near["e"]), (8, text["e"]),  # copies of one key
            (9, ""), (9, ""), (9, text["f"]), (10, near["f"]),
            (11, text["g"]), (12, near["g"])]
    d = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, key string")
    got = [(r["doc_id"], r["text"]) for r in M.keep_representatives(d).collect()]
    stems = sorted((str(k), t.split()[0][:1] if t and t.strip() else "") for k, t in got)
    assert stems == sorted([("1", "a"), ("None", "b"), ("None", "c"), ("None", ""), ("None", ""), ("7", "d"),
                            ("8", "e"), ("9", ""), ("9", ""), ("9", "f"), ("11", "g")])


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("size", [12, 150, 900, 1100, 6000])
def test_screen_keeps_pairs_at_the_threshold_and_drops_far_ones(spark, size):
    rng = np.random.default_rng(size)
    rows, want = [], {}
    for i in range(300):
        share = [0.8, 0.85, 0.5][i % 3]
        u = rng.integers(0, 2**63, size, dtype=np.uint64)
        c, d = int(np.ceil(share * size)), size - int(np.ceil(share * size))
        cut = c + (d // 2 if i % 2 else 0)
        a, b = np.sort(u[:cut]), np.sort(np.concatenate([u[:c], u[cut:]]))
        full = [len(a), len(b)]
        for side, x in zip("xy", (a, b)):
            cls = 0 if max(full) <= M.SMALL else 1
            bits = np.bincount(M._sketch(np.sort(x << np.uint64(1)), [M.FINE, M.COARSE][cls]), minlength=M.BITS) & 1
            rows.append((i, side, len(x), cls, np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()))
        want[i] = share >= 0.8
    d = spark.createDataFrame(rows, "i long, side string, n long, cls int, sk array<long>")
    s = F.struct("n", "cls", "sk")
    got = d.filter("side = 'x'").select("i", s.alias("x")).join(d.filter("side = 'y'").select("i", s.alias("y")), "i") \
        .select("i", M.screened("x", "y", 80).alias("ok")).collect()
    assert {r["i"]: r["ok"] for r in got} == want
