from balsam.sources.csv import read_csv, write_csv


def test_csv_roundtrip_quotes_newlines_blanks(spark, tmp_path):
    rows = [(1, 'He said "hi"\nthen left', "  padded  ", 3), (2, "", "NA", None), (3, "a,b;c", "null", 7)]
    df = spark.createDataFrame(rows, "k long, t string, u string, n int")
    path = str(tmp_path / "c")
    write_csv(df.repartition(2), path)
    back = {r["k"]: r for r in read_csv(spark, path, df.schema).collect()}
    assert back[1]["t"] == 'He said "hi"\nthen left'
    assert back[1]["u"] == "  padded  "           # blanks kept (writer trims by default)
    assert back[2]["t"] is None and back[2]["u"] is None and back[2]["n"] is None
    assert back[3]["t"] == "a,b;c" and back[3]["u"] is None and back[3]["n"] == 7


def test_csv_na_token_in_int_column(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text('k,n\n1,NA\n2,5\n3,""\n')
    back = {r["k"]: r["n"] for r in read_csv(spark, str(p), "k long, n int").collect()}
    assert back == {1: None, 2: 5, 3: None}
