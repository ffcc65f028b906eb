import datetime
import random

import pytest

from balsam.operators.asof import nearest_milestones


@pytest.mark.parametrize("parts, by", [(1, []), (9, []), (9, ["k"])])
def test_matches_a_plain_search(spark, parts, by):
    rnd = random.Random(parts)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    # one key and one week hold most events
    ev = [(i, rnd.choice(["a"] * 6 + ["b", None]), day(rnd.choice([200 + rnd.randint(0, 6), rnd.randint(0, 400)]))) for i in range(300)]
    ev += [(900, "a", None), (901, "c", day(3))]
    ms = [(rnd.choice(["a", "a", "b", None]), day(rnd.randint(-20, 420))) for _ in range(25)] + [("a", day(203)), ("a", day(203)), ("a", None)]
    e = spark.createDataFrame(ev, "id long, k string, t date")
    m = spark.createDataFrame(ms, "k string, d date")
    got = {r["id"]: (r["previous"], r["next"]) for r in nearest_milestones(e, m, "t", "d", by, parts).collect()}
    assert len(got) == len(ev)
    for i, k, t in ev:
        mine = [d for q, d in ms if d is not None and (not by or q == k)]
        assert got[i] == ((max((d for d in mine if d <= t), default=None), min((d for d in mine if d > t), default=None)) if t else (None, None))


def test_empty_tables(spark):
    e = spark.createDataFrame([(1, datetime.date(2020, 1, 1))], "id long, t date")
    m = e.limit(0).select(e["t"].alias("d"))
    assert nearest_milestones(e.limit(0), m, "t", "d").count() == 0
    assert nearest_milestones(e, m, "t", "d").first()["previous"] is None


def test_frames_grow_from_their_first_row(spark):
    """A frame up to the last row is worked out anew for every row, so that time grows with the square."""
    ev = spark.createDataFrame([("a", i) for i in range(6)], "k string, t int")
    ms = spark.createDataFrame([("a", 2), ("a", 4)], "k string, m int")
    out = nearest_milestones(ev, ms, "t", "m", ["k"], partitions=2)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    assert sorted((r["t"], r["previous"], r["next"]) for r in out.collect()) == [
        (0, None, 2), (1, None, 2), (2, 2, 4), (3, 2, 4), (4, 4, None), (5, 4, None)]
