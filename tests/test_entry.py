import importlib

import pytest

from tests.conftest import SF_CHECK, SF_SMALL


def test_entry_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"f1_macro", "precision_macro", "recall_macro", "accuracy", "n", "masked_digest"}


def test_registry_consistent():
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


@pytest.mark.parametrize("name", ["stratified_split", "smote", "roc_curve", "mask_terms_longest", "repeat_rate"])
def test_oracle_samples(spark, name):
    import duckdb
    import check_oracle as C
    entry = importlib.import_module("__spark_entry__")
    df = entry.queries()[name](spark, SF_CHECK)
    con = duckdb.connect()
    for t in C.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert C._rows(df.columns, [tuple(r) for r in df.collect()]) == C._rows(cols, rel.fetchall())


def test_entry_works_without_the_training_data_operators(monkeypatch):
    import importlib.util
    real = importlib.util.find_spec
    for gone in ("balsam.llm", "corpus_pipeline"):
        monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a, gone=gone: None if n == gone else real(n, *a))
        entry = importlib.import_module("__spark_entry__")
        q = entry.queries()
        assert len(q) >= 100 and "pipeline" not in q and "pipeline" not in entry.oracle_sql()
