"""Warehouse tables, row order of sheets read in blocks, formatting and streams."""

import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.conftest import SF001
from thematica.functions import markers as M
from thematica.functions import text as T
from thematica.operators import automate, overlap
from thematica.operators.columns import source_order
from thematica.plans import q_source
from thematica.plans.catalog import flow_lexicons, flow_scorers
from thematica.sources import io
from thematica.streaming import flags


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_filter_prunes_partitions_and_is_pushed(spark):
    name = q_source.activities(spark, SF001)
    out = q_source.sliced(spark, name)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    p = plan(out)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(year" in p and "(year" in p.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [IsNotNull(category)" in p and "EqualTo(category,10)" in p and "In(recipient_name" in p
    table = spark.table(name)
    assert sorted(map(str, out.collect())) == sorted(map(str, table.where(
        "category = 10 and year between 1996 and 1997 and usd_disbursement > 0").where(F.col("recipient_name").isin(*q_source.RECIPIENTS)).collect()))
    years = {r[0] for r in out.select("year").distinct().collect()}
    assert years <= {1996, 1997}


def test_equal_buckets_join_without_an_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        li, o = q_source.order_tables(spark, SF001)
        joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        p = plan(joined)
        assert "SortMergeJoin" in p and "Exchange" not in p
        a, b = spark.read.parquet(f"{SF001}/lineitem.parquet"), spark.read.parquet(f"{SF001}/orders.parquet")
        plain = a.join(b, a.l_orderkey == b.o_orderkey).select("l_orderkey", "l_quantity", "l_returnflag", "o_orderkey", "o_orderstatus")
        assert joined.exceptAll(plain).count() == 0 and joined.count() == plain.count()
        # one file a bucket: each task of the write held whole buckets
        assert len(li.inputFiles()) <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_extract_by_table_name(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    io.save_table(spark.createDataFrame([(1, 2018), (2, 2020)], "id int, year int"), name, str(tmp_path / "t"), ["year"])
    assert [r["id"] for r in io.extract(name, F.col("year") > 2018, str(tmp_path / "x"), spark=spark).collect()] == [2]


@pytest.mark.parametrize("block", [2000, 10_000_000])
def test_rows_of_a_sheet_keep_their_order_over_blocks(spark, tmp_path, block):
    for sheet, n in (("2019", 3000), ("2020", 40)):
        lines = [f"{i if i % 7 else ''},line {i}{'x' * (i % 13)}" for i in range(n)]
        (tmp_path / f"{sheet}_a.csv").write_text("value,program\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        df = io.read_tagged(spark, str(tmp_path / "*.csv"), "value string, program string", r"/(\d{4})_[^/]*\.csv$", "year", multiline=False)
        rows = df.select("year", "row_ord", "program").collect()
        tasks = df.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks > 10 if block == 2000 else tasks < 10
    for sheet, n in (("2019", 3000), ("2020", 40)):
        own = sorted((r["row_ord"], r["program"]) for r in rows if r["year"] == sheet)
        assert [p.split("x")[0] for _, p in own] == [f"line {i}" for i in range(n)]
        assert len({o for o, _ in own}) == n


def test_source_order_of_parquet(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p")).select("id", source_order().alias("o")).orderBy("o").collect()
    assert [r["id"] for r in got] == list(range(100))


def test_formats_and_sums(spark):
    df = spark.createDataFrame([(1234567.5, 0.125, 1.0, None), (None, None, None, None), (-0.4, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    got = [tuple(r) for r in df.select(T.fmt_dollar("a"), T.fmt_dollar("c", 1e6), T.fmt_percent("b"), M.coalesce_sum(["c", "d"])).collect()]
    assert got == [("$1,234,568", "$1,000,000", "12%", 1.0), (None, None, None, 0.0), ("$-0", "$2,000,000", "100%", 5.0)]
    assert [r[0] for r in df.select(M.binarize("b")).collect()] == [False, None, True]
    assert M.binarize is not None and [r[0] for r in spark.createDataFrame([(0.5,), (0.51,)], "x double").select(M.binarize("x")).collect()] == [False, True]


def test_flags_on_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = [Row(id=i, project_title=t, gender=g, climate_adaptation=a, climate_mitigation=None, disability=None, year=2018 + i % 2, usd_disbursement=float(i))
            for i, (t, g, a) in enumerate([("red gizmo", None, None), ("new blue", 2, 1), ("cold", None, 2), ("", 0, 0), (None, None, None)] * 3)]
    schema = "id int, project_title string, gender int, climate_adaptation int, climate_mitigation int, disability int, year int, usd_disbursement double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = flags.read_stream(spark, str(tmp_path / "in"), schema)
    cols = ["id", "year", "usd_disbursement", *overlap.FLAGS]
    out = flags.run_available(flags.flag_activities(stream, flow_scorers(), flow_lexicons(), ("project_title",)).select(*cols), "flags")
    plain = flags.flag_activities(batch, flow_scorers(), flow_lexicons(), ("project_title",))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.select(*cols).collect()))
    assert sorted(map(str, flags.running_overlap(out).collect())) == sorted(map(str, overlap.overlap_by(plain, ["year"]).collect()))
    assert set(M.reference_names().values()) & set(automate.to_reference_names(plain).columns)
