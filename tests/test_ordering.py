"""The cut text order (W03, W04): same rows as one global window, no hot segment."""

import random
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from thematica.operators import curate, ranking

rnd = random.Random(5)


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(6)


def sizes(df, tie, n):
    cuts = ranking.text_splitters(df, "text", tie, n)
    return [r["count"] for r in df.groupBy(ranking.segment_of(cuts, "text", tie).alias("s")).count().collect()], cuts


def check_next(df, tie="id", n=8):
    got = sorted(map(tuple, curate.adjacent_next(df, "text", tie, n).collect()), key=str)
    w = Window.orderBy("text", tie)
    want = sorted(map(tuple, df.withColumn("next_text", F.lead("text").over(w)).collect()), key=str)
    assert got == want


@pytest.fixture(scope="module")
def hot(spark):
    opening = "an opening that a third of all texts share, much longer than any prefix of a few dozen characters " * 3
    rows = [(i, opening + f"{rnd.randrange(10**9)}") for i in range(4000)]
    rows += [(i, f"{rnd.randrange(10**9)} é {i % 7}") for i in range(4000, 8000)]
    rows += [(i, "the very same text") for i in range(8000, 12000)]
    return table(spark, rows).cache()


def test_shared_openings_and_equal_texts_are_cut(hot):
    got, cuts = sizes(hot, "id", 16)
    assert len(got) >= 14 and max(got) <= 3 * median(got)
    check_next(hot, n=16)


def test_splitters_are_short_where_texts_differ_early(spark):
    df = table(spark, [(i, f"{rnd.randrange(10**9):09d}" + "long tail " * 500) for i in range(2000)])
    got, cuts = sizes(df, "id", 8)
    assert max(got) <= 2 * median(got) and max(len(t) for t, _ in cuts) < 10


def test_order_of_any_text(spark):
    rows = [(i, rnd.choice(["", "a", "ab", "b", "é", "\U0001F600", "Z", "zz"]) * rnd.randrange(3)) for i in range(400)]
    rows += [(1000, None), (1001, None), (None, "ab"), (None, "a"), (5, "a"), (5, "a")]
    check_next(table(spark, rows))
    check_next(table(spark, rows), n=200)
    check_next(table(spark, rows[:1]))
    check_next(table(spark, []))


def test_without_a_tiebreak(spark):
    df = table(spark, [(i, rnd.choice(["x", "y", "z"]) + "w" * rnd.randrange(4)) for i in range(300)])
    got = sorted(r["next_text"] or "" for r in curate.adjacent_next(df, "text", None, 5).collect())
    texts = sorted(r["text"] for r in df.collect())
    assert got == sorted([*texts[1:], ""])


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SAMPLE_CHARS", 64)
    df = table(spark, [(i, "w" * 100 + str(rnd.randrange(10**6))) for i in range(500)])
    got, cuts = sizes(df, "id", 8)
    assert cuts == [] or max(len(t) for t, _ in cuts) <= 64
    check_next(df)


def test_near_duplicates_plan_has_one_exchange_of_texts(spark, hot):
    plan = curate.drop_near_dups(hot, "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("shufflepartitionidpassthrough") >= 1
