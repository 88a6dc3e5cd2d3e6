"""Selection by rank: percentiles, sketches, first rows of strata."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from thematica.operators import curate, selection, training
from thematica.operators.ranking import hash_order

rnd = random.Random(3)
PROBS = (0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0)


def frame(spark, cols):
    names = list(cols)
    return spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{n} double" for n in names)).repartition(5)


def expected(values, probs):
    v = [x for x in values if x is not None]
    return [float(np.quantile(np.array(v), p)) if v else None for p in probs]


@pytest.mark.parametrize("k,most", [(selection.SKETCH_K, selection.VALUES), (32, 200)])
def test_exact_percentiles(spark, k, most):
    n = 6000
    cols = {
        "even": [rnd.random() for _ in range(n)],
        "hot": [0.25 if i % 2 else rnd.random() for i in range(n)],
        "two": [float(i % 2) for i in range(n)],
        "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(n)],
        "gaps": [rnd.random() if i % 3 else None for i in range(n)],
        "none": [None] * n,
        "same": [7.0] * n}
    got = selection.exact_percentiles(frame(spark, cols), list(cols), PROBS, k, most).orderBy("p_no").collect()
    for c, values in cols.items():
        want = expected(values, PROBS)
        assert [r[c] for r in got] == pytest.approx(want, rel=1e-12) if want[0] is not None else all(r[c] is None for r in got)


def test_percentiles_of_few_rows_and_nan(spark):
    got = selection.exact_percentiles(frame(spark, {"a": [3.0], "b": [None]}), ["a", "b"], PROBS).collect()
    assert {r["a"] for r in got} == {3.0} and {r["b"] for r in got} == {None}
    df = frame(spark, {"a": [1.0, 2.0, float("nan"), float("nan")]})
    got = {r["prob"]: r["a"] for r in selection.exact_percentiles(df, ["a"], (0.0, 0.3, 1.0)).collect()}
    assert got[0.0] == 1.0 and got[0.3] == pytest.approx(1.9) and np.isnan(got[1.0])
    assert selection.exact_percentiles(df.limit(0), ["a"], (0.5,)).head()["a"] is None


def test_percentiles_have_no_sort_of_rows(spark, monkeypatch):
    # a column with one value in half its rows: counts collapse in each task
    df = frame(spark, {"v": [1.0 if i % 2 else rnd.random() for i in range(4000)]})
    monkeypatch.setattr(selection, "rank_within", None)
    curate.percentiles(df, "v").collect()


def test_sketches_merge_within_their_error(spark):
    n, k = 40_000, 256
    rows = [(i % 2, i % 3, rnd.gauss(0, 1), None if i % 5 else rnd.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "half int, grp int, a double, b double").repartition(7)
    kept = selection.quantile_sketches(df, ["a", "b"], ["half", "grp"], k)
    whole = selection.merge_sketches(kept, ["a", "b"], ["grp"])
    got = selection.sketch_percentiles(whole, ["a", "b"], (0.1, 0.5, 0.9), ["grp"]).collect()
    assert len(got) == 9
    for r in got:
        for j, c in ((2, "a"), (3, "b")):
            v = sorted(x[j] for x in rows if x[1] == r["grp"] and x[j] is not None)
            rank = np.searchsorted(v, r[c]) / len(v)
            assert abs(rank - r["prob"]) <= 3.0 / k
    sizes = whole.select("a_n", "b_n").collect()
    assert sum(r["a_n"] for r in sizes) == n and sum(r["b_n"] for r in sizes) == n // 5


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "g int, v double")
    kept = selection.quantile_sketches(df, ["v"], ["g"])
    got = {(r["g"], r["prob"]): r["v"] for r in selection.sketch_percentiles(kept, ["v"], (0.5,), ["g"]).collect()}
    assert got == {(1, 0.5): None, (2, 0.5): 5.0}
    assert selection.sketch_percentiles(selection.merge_sketches(kept, ["v"]), ["v"], (0.5,)).head()["v"] == 5.0


def strata(spark, n=5000):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}", f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, stratum string, text string").repartition(6)


@pytest.mark.parametrize("tied,share", [(selection.TIED, 0.5), (3, 0.01), (3, 0.999), (3, 1.0), (50, 0.0)])
def test_first_of_each_stratum(spark, tied, share):
    df = strata(spark).withColumn("_h", hash_order(9, "id"))
    n = df.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select("stratum", F.floor(F.col("n") * share).alias("k"))
    got = selection.first_of_each(df, "_h", ["id"], wanted, "stratum", tied=tied)
    w = Window.partitionBy("stratum").orderBy("_h", "id")
    want = df.withColumn("r", F.row_number().over(w)).join(wanted.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")))
    want = {r["id"] for r in want.where("r <= k").select("id").collect()}
    rows = got.collect()
    assert len(rows) == 5000 and {r["id"] for r in rows if r["chosen"]} == want


def test_rows_that_tie_in_all_keys(spark):
    df = spark.createDataFrame([(1, "same") for _ in range(500)] + [(2, f"t{i}") for i in range(500)], "g int, text string").repartition(4)
    out = training.stratified_split(df, "g", 0.2, 42, ("text",))
    got = {(r["g"], r["split"]): r["count"] for r in out.groupBy("g", "split").count().collect()}
    assert got == {(1, "test"): 100, (1, "train"): 400, (2, "test"): 100, (2, "train"): 400}


def test_samples(spark):
    df = strata(spark, 1000)
    h = df.withColumn("_h", hash_order(4, "id")).orderBy("_h", "id").limit(37).select("id").collect()
    got = training.sample_n(df, 37, 4, ("id",))
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in h)
    assert training.sample_n(df, 0, 4, ("id",)).count() == 0
    assert training.sample_n(df, 5000, 4, ("id",)).count() == 1000
    assert training.sample_n(df.limit(0), 5, 4, ("id",)).count() == 0


def test_downsample_keeps_at_most_all_negatives(spark):
    df = spark.createDataFrame([(i, 0 if i < 30 else 1) for i in range(100)], "id long, sig int")
    assert training.downsample(df, "sig", 0, 1, ("id",)).count() == 100
    df = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(100)], "id long, sig int")
    got = training.downsample(df, "sig", 0, 1, ("id",)).groupBy("sig").count().collect()
    assert {r["sig"]: r["count"] for r in got} == {0: 30, 1: 30}
