import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from balsam.llm import cuckoo_dedup as C


def norm(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def sha(t):
    return hashlib.sha256(norm(t).encode()).hexdigest()


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[norm(t)].append(k)
    out = []
    for t, keys in groups.items():
        keys.sort(key=lambda k: (k is not None, k if k is not None else 0))
        digest = hashlib.sha256(t.encode()).hexdigest()
        out += [(k, keys[-1], len(keys), i == len(keys) - 1, digest) for i, k in enumerate(keys)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    texts = ["", None, "Same", "sAME", "Été", "été", "ÉTÉ", "İ", "i̇", "x" * 60_000, "X" * 60_000, "x" * 60_001, "a b", "a  b"]
    rows = [(i, rnd.choice(texts)) for i in range(200)] + [(1000 + i, "hot Copy" if i % 2 else "HOT copy") for i in range(150)]
    rows += [(5, "same"), (5, "same"), (None, "same"), (None, "only null"), (None, "ONLY null")]
    return rows + [(2000 + i, f"text {i}") for i in range(300)]


def test_rows_match_brute_force(spark, rows, monkeypatch):
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS digest")
    assert found(C.find_duplicates(d.repartition(7))) == brute(rows)
    monkeypatch.setattr(C, "LIVE", 20)
    assert found(C.find_duplicates(d.repartition(3), shards=1)) == brute(rows)
    kept = C.drop_duplicates(d)
    assert kept.columns == d.columns
    stay = sorted(((k, h) for k, _, _, b, h in brute(rows) if b), key=repr)
    assert sorted(((r["doc_id"], sha(r["text"])) for r in kept.collect()), key=repr) == stay
    assert C.find_duplicates(d.limit(0)).count() == 0


def test_string_keys_and_hot_groups_by_join(spark, rows, monkeypatch):
    named = [(None if k is None else f"k{k:05d}", t) for k, t in rows]
    d = spark.createDataFrame(named, "doc_id string, text string")
    monkeypatch.setattr(C, "HOT_SHARE", 1)  # nothing is hot: all groups go through the join
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in C.find_duplicates(d).collect()}
    want = {(None if k is None else f"k{k:05d}", None if p is None else f"k{p:05d}", n, b, h) for k, p, n, b, h in brute(rows)}
    assert got == want


def test_filter_never_misses_and_resizes():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2 ** 64, 30_000, dtype=np.uint64))
    shard = C.Shard()
    small = len(shard.filter.slots)
    rows = [[int(k).to_bytes(8, "big") * 4, 3, 1, i, i] for i, k in enumerate(keys)]
    for at in range(0, len(rows), 1000):
        shard.add(iter([list(r) for r in rows[at:at + 1000]]))
    assert len(shard.filter.slots) > small  # overflow led to more buckets
    assert shard.filter.contains(keys).all()
    assert np.count_nonzero(shard.filter.slots) == len(keys)
    others = np.setdiff1d(rng.integers(0, 2 ** 64, 50_000, dtype=np.uint64), keys)
    assert shard.filter.contains(others).mean() < 0.002
    gone = rows[::3]
    for r in gone:
        assert shard.take(r[0], 3, 1)[2] == 0
    assert np.count_nonzero(shard.filter.slots) == len(keys) - len(gone)
    left = np.setdiff1d(keys, keys[::3])
    assert shard.filter.contains(left).all() and len(shard.entries()) == len(left)
    assert shard.filter.contains(keys[::3]).mean() < 0.01
    with pytest.raises(KeyError):
        C.CuckooFilter().delete(keys[:1])


def test_false_hits_are_verified_against_the_content():
    shard = C.Shard()
    a, b = bytes(8) + b"same-key" + b"a" * 16, bytes(8) + b"same-key" + b"b" * 16
    for d in (a, b, a):
        shard.add(iter([[d, 4, 1, 1, 1]]))
    assert sorted((e[0], e[2]) for e in shard.entries()) == [(a, 2), (b, 1)]
    shard.add(iter([[a, 5, 1, 1, 1]]))  # the length is part of the content
    assert len(shard.entries()) == 3
    assert shard.take(b"q" * 32, 4, 1) is None


def test_a_failed_insertion_loses_no_live_key():
    f = C.CuckooFilter(16)
    rng = np.random.default_rng(2)
    live = np.zeros(0, np.uint64)
    for _ in range(100):
        key = rng.integers(0, 2 ** 64, 1, dtype=np.uint64)
        if len(f.insert(key)):
            break
        live = np.append(live, key)
    assert len(live) < 100 and f.contains(live).all()


def test_index_takes_insertions_and_deletions(spark, rows, tmp_path):
    at = [f"file://{tmp_path}/v{i}" for i in range(3)]
    frame = lambda rs: spark.createDataFrame(rs, "doc_id long, text string")
    first, second = rows[:300], rows[300:]
    C.build(frame(first), at[0], shards=3)
    C.insert(spark, at[0], frame(second), at[1])
    gone = [k for k, _ in rows if k is not None and k % 3 == 0]
    C.delete(spark, at[1], frame([(k, "") for k in gone] + [(10 ** 9, "")]).select("doc_id"), at[2])
    for path, live in ((at[0], first), (at[1], rows), (at[2], [r for r in rows if r[0] is None or r[0] % 3])):
        want = {(h, p, n) for _, p, n, _, h in brute(live)}
        got = {(r["digest"].hex(), r["best"], r["rows"]) for r in spark.read.parquet(f"{path}/entries").collect()}
        assert got == want
        # the filters hold one fingerprint for each live digest
        held = sum(np.count_nonzero(np.frombuffer(r["slots"], np.uint16)) for r in spark.read.parquet(f"{path}/filters").collect())
        assert held == len(want)
        keep = {h: p for _, p, _, _, h in brute(live)}
        asked = rows[::7] + [(1, "not there"), (2, None)] + [(i, "HOT COPY") for i in range(20)]
        got = sorted(((r["doc_id"], r["live"], r["keep_id"]) for r in C.lookup(spark, path, frame(asked)).collect()), key=repr)
        assert got == sorted(((k, sha(t) in keep, keep.get(sha(t))) for k, t in asked), key=repr)
