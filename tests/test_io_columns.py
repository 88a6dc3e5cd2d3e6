"""Sources and sinks (S01-S09) round trips and column helpers."""

import os

import pandas as pd
from pyspark.sql import functions as F

from thematica.operators import columns as C
from thematica.sources import io


def test_csv_round_trip_multiline_and_na(spark, tmp_path):
    df = spark.createDataFrame([(1, 'line one\nline "two"', None), (2, "plain", 3.5)], "id int, text string, v double")
    p = str(tmp_path / "out")
    io.write_csv(df, p)
    back = io.read_csv(spark, p, "id int, text string, v double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    pd.DataFrame({"a": ["1", "NA", "x"]}).to_csv(tmp_path / "na.csv", index=False)
    got = [r[0] for r in io.read_csv(spark, str(tmp_path / "na.csv"), "a string", null_value="NA").collect()]
    assert got == ["1", None, "x"]


def test_split_publish_and_read(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train")], "text string, split string")
    p = str(tmp_path / "ds")
    io.write_split(df, p)
    assert sorted(r[0] for r in io.read_split(spark, p, "train").collect()) == ["a", "c"]
    assert io.read_split(spark, p).count() == 3


def test_read_tagged_sheets(spark, tmp_path):
    for year, rows in (("2019", ["p1,1", "p2,2"]), ("2020", ["q1,3"])):
        (tmp_path / f"{year}_sheet.csv").write_text("program,value\n" + "\n".join(rows) + "\n")
    df = io.read_tagged(spark, str(tmp_path / "*.csv"), "program string, value string", r"/(\d{4})_[^/]*\.csv$", "year")
    got = sorted((r["year"], r["program"]) for r in df.collect())
    assert got == [("2019", "p1"), ("2019", "p2"), ("2020", "q1")]
    assert df.where("year = '2019'").orderBy("row_ord").select("program").collect()[0][0] == "p1"


def test_extract_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(2018, 1.0, "1"), (2023, 2.0, "x")], "year int, amt double, code string")
    out = io.extract(df, F.col("year").between(2018, 2022) & (F.col("amt") > 0), str(tmp_path / "x"))
    assert out.count() == 1 and os.path.isdir(tmp_path / "x")
    c = C.cast_cols(df, {"code": "int"})
    assert [r["code"] for r in c.collect()] == [1, None]
    r = C.rename(C.keep_only(df, ["year", "amt"]), ["y", "a"])
    assert r.columns == ["y", "a"] and C.first_columns(df, 2) == ["year", "amt"]
    m = C.map_rows(df, lambda pdf: pdf.assign(amt=pdf.amt * 2), df.schema)
    assert sorted(x["amt"] for x in m.collect()) == [2.0, 4.0]
