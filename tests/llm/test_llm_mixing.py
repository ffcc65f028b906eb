import math
import random
from fractions import Fraction

import pytest

from balsam.llm import mixing


def ideal_share(blocks, weights, t):
    """Blocks of each source in the ideal mix after t slots, step by step from one end to the next."""
    w = {s: Fraction(x) for s, x in weights.items() if blocks[s]}
    left = {s: Fraction(blocks[s]) for s in w}
    t = Fraction(t)
    while t:
        rate = sum(w[s] for s in w if left[s])
        v = min(min(left[s] / w[s] for s in w if left[s]), t / rate)
        for s in w:
            left[s] -= min(left[s], w[s] * v)
        t -= v * rate
    return {s: blocks[s] - left[s] for s in w}


@pytest.mark.parametrize("weights", [
    {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}, {"a": 0.98, "b": 0.01, "c": 0.01},
    {f"s{i}": i + 1 for i in range(37)}, {f"s{i}": 1 / i**2 for i in range(1, 41)},
    {"a": 2**0.5, "b": 3**0.5, "c": 5**0.5}, {"a": 1e-9, "b": 1.0, "c": 1e9}])
def test_every_prefix_is_within_one_block_of_the_target(weights):
    rnd = random.Random(len(weights))
    for least in (0, 20):
        blocks = {s: rnd.randint(least, 30) for s in weights}
        got = list(mixing.schedule(blocks, weights))
        assert sorted((s, j) for s, j, _, _ in got) == sorted((s, j) for s, n in blocks.items() for j in range(n))
        taken = dict.fromkeys(weights, 0)
        for t, (s, j, release, deadline) in enumerate(got):
            assert release <= t < deadline and j == taken[s]
            taken[s] += 1
            if t % 7 == 0 or t + 1 == len(got):
                share = ideal_share(blocks, weights, t + 1)
                assert all(abs(taken[x] - share[x]) < 1 for x in share)


def test_long_mix_stays_within_one_block():
    """10^5 blocks of irrational weights, none of which runs out early: the target is w t."""
    w = {"a": 2**0.5, "b": 3**0.5, "c": 5**0.5, "d": 0.0003}
    total = sum(w.values())
    blocks = {s: math.ceil(100_000 * x / total) + 2 for s, x in w.items()}
    taken = dict.fromkeys(w, 0)
    for t, (s, *_) in enumerate(mixing.schedule(blocks, w)):
        if t >= 100_000:
            break
        taken[s] += 1
        assert all(abs(taken[x] - (t + 1) * w[x] / total) < 1 for x in w)


def test_many_sources_meet_every_window():
    n = 10_000
    blocks, w = {f"s{i}": 1 + 100_000 // (i + 1) ** 2 for i in range(n)}, {f"s{i}": 1 / (i + 1) for i in range(n)}
    got = list(mixing.schedule(blocks, w))
    assert len(got) == sum(blocks.values())
    assert all(release <= t < deadline for t, (_, _, release, deadline) in enumerate(got))


def test_weights_keep_their_ratios():
    w = {"a": 0.1, "b": 2**0.5, "c": 3.0}
    whole = mixing.exact_weights(w)
    assert all(Fraction(whole[s], whole["c"]) == Fraction(w[s]) / 3 for s in w)


def test_mix_keeps_all_rows_and_the_target(spark):
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else None), f"t{i}", "n") for i in range(3000)] + [(5, "mid", "t5", "n")] * 2
    d = spark.createDataFrame(rows, "doc_id long, source string, s string, position string")
    out = mixing.mix(d, weights={"big": 0.5, "mid": 0.3, "(none)": 0.2}, block_rows=10)
    got = out.orderBy("position").collect()
    assert len(got) == len(rows) and len({r["position"] for r in got}) == len(rows)
    assert sorted((r["doc_id"], r["source"] or "", r["s"]) for r in got) == sorted((a, b or "", c) for a, b, c, _ in rows)
    blocks = {}
    for r in got:
        blocks.setdefault((r["source"], r["block"]), set()).add((r["release"], r["slot"], r["deadline"]))
        assert r["release"] <= r["slot"] < r["deadline"] and r["slot"] == r["position"] // 10
    assert all(len(v) == 1 for v in blocks.values())
    first = [r["source"] for r in got[:1000]]
    assert abs(first.count("big") - 500) <= 10 and abs(first.count("mid") - 300) <= 10
    again = mixing.mix(d.repartition(7), weights={"big": 0.5, "mid": 0.3, "(none)": 0.2}, block_rows=10)
    assert sorted((r["doc_id"], r["position"]) for r in again.collect() if r["doc_id"] != 5) == \
        sorted((r["doc_id"], r["position"]) for r in got if r["doc_id"] != 5)


def test_blocks_grow_beyond_their_number_and_sources_are_bounded(spark):
    d = spark.createDataFrame([(None if i % 2 else i, f"s{i % 4}", i) for i in range(1000)], "doc_id long, source string, n int")
    got = mixing.mix(d, block_rows=4, max_blocks=50).collect()
    assert len({r["position"] for r in got}) == len(got) == 1000
    assert len({(r["source"], r["block"]) for r in got}) <= 54 and {r["position"] // 20 - r["slot"] for r in got} == {0}
    with pytest.raises(ValueError):
        mixing.mix(d, max_sources=3)


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(d).columns == ["doc_id", "source", "block", "release", "deadline", "slot", "position"]
    assert mixing.mix(d).count() == 0


def test_weights_without_all_sources():
    w = mixing.target_weights({"a": 5, "b": 9, "c": 1}, {"a": 0.5}, 2.0)
    assert w == {"a": 0.5, "b": 0.25, "c": 0.25}
