import pytest
from pyspark.sql import functions as F

from balsam.operators import clean, labels
from balsam.sources.csv import normalise_na, read_csv, write_csv


def test_label_policy_and_subsets(events_fixture):
    lab, unl = labels.curate_labels(events_fixture, labels.ACTOR_LABELS, labels.UNATTRIBUTED_ACTORS, "actor1")
    got = {r["row_id"]: r["target"] for r in lab.collect()}
    assert got == {"e01": 0, "e02": 0, "e03": 0, "e04": 1, "e09": 0}
    assert sorted(r["row_id"] for r in unl.collect()) == ["e05", "e06"]


def test_violence_flag_rules(events_fixture):
    got = {r["row_id"]: r["violence_against_women"]
           for r in labels.violence_against_women(events_fixture).collect()}
    assert got["e03"] == 1          # sexual violence, tags null
    assert got["e04"] == 0          # exactly "local administrators" is cancelled
    assert got["e05"] == 1          # listed combined tag
    assert got["e06"] == 0          # listed tag inside an unlisted longer string
    assert got["e08"] == 0          # both null -> 0, not null
    assert got["e07"] == 1


def test_presence_flag_after_csv_na(spark, events_fixture, tmp_path):
    path = str(tmp_path / "ev")
    write_csv(events_fixture, path)
    back = read_csv(spark, path, events_fixture.schema)
    got = {r["row_id"]: r["f"] for r in back.select("row_id", labels.presence_flag(F.col("civilian_targeting")).alias("f")).collect()}
    assert got["e02"] == 0 and got["e03"] == 0 and got["e04"] == 1
    assert {r["row_id"]: r["notes"] for r in back.collect()}["e08"] == "a b\t c  d"


def test_one_hot_null_row_all_zero(events_fixture):
    oh = labels.one_hot(events_fixture, "sub_event_type")
    cols = [c for c in oh.columns if c.startswith("sub_event_type_")]
    assert cols == sorted(cols) and "sub_event_type" not in oh.columns
    row = oh.where(F.col("row_id") == "e05").first()
    assert all(row[c] == 0 for c in cols)


def test_strict_and_lenient_dates(spark):
    df = spark.createDataFrame([("2020-01-05",), ("not a date",)], "d string")
    assert clean.parse_dates(df, "d", strict=False).where(F.col("d").isNull()).count() == 1
    with pytest.raises(Exception):
        clean.parse_dates(df, "d", strict=True).collect()


def test_strict_drop_and_positions(spark, events_fixture):
    with pytest.raises(KeyError):
        clean.drop_columns(events_fixture, ["nope"])
    s = clean.sort_by(events_fixture, "event_date", "row_id").collect()
    assert [r["row_id"] for r in s][:2] == ["e01", "e02"]  # same date, key tie-break
    kept = clean.drop_positions(events_fixture, [F.col("event_date"), F.col("row_id")], [0, 2])
    assert sorted(r["row_id"] for r in kept.collect()) == ["e02", "e04", "e05", "e06", "e07", "e08", "e09"]
    with pytest.raises(KeyError):
        clean.drop_positions(events_fixture, [F.col("row_id")], [99])


def test_curate_from_actor_columns(spark):
    df = spark.createDataFrame([(1, "Taliban", None), (2, "Taliban", "Islamic State Khorasan Province (ISKP)"),
                                (3, None, "Islamic State Khorasan Province (ISKP)"), (4, "Al Qaeda", None)],
                               "k int, a string, b string")
    got = {r["k"]: r["target"] for r in labels.curate_from_actors(df, ["a", "b"], labels.ACTOR_LABELS).collect()}
    assert got == {1: 0, 3: 1}  # coalition row 2 and unmapped row 4 excluded


def test_normalise_na_tokens(spark):
    df = spark.createDataFrame([("NA",), ("n/a",), ("ok",), ("",)], "c string")
    assert [r[0] for r in normalise_na(df).collect()] == [None, None, "ok", None]
