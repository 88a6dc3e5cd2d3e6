"""Aggregates, sets and ranks (N5-N8, A01-A08, A20, G01, U05, U06) incl.
skewed inputs where one key holds a third of the rows."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF001
from thematica.operators import curate, overlap, ranking, spending
from thematica.operators.budgets import budget_value, compare_budgets


def test_overlap_by_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([(2020, True, False, False, None), (2020, True, False, False, None),
                                (2021, False, True, False, 1.25), (2021, False, True, False, 2.5)],
                               "year int, principal_gender boolean, principal_climate boolean, "
                               "principal_disability boolean, usd_disbursement double")
    got = {(r[0], r[1]): r[4] for r in overlap.overlap_by(df, ["year"]).collect()}
    assert got == {(2020, True): 0.0, (2021, False): 3.75}                       # N5


def test_strict_total_and_ratio_division_by_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", None, 0.0), ("b", 2.0, 4.0)], "s string, d double, c double")
    assert spending.total_strict(df, "d").first()[0] is None                     # N6
    got = {r[0]: r[1] for r in spending.ratio_by(df, "s", "d", "c").collect()}
    assert got == {"a": None, "b": 0.5}                                          # N7 (no error under ANSI)


# FIXED VALUES: flag-combination amounts of the reference's published Venn table.
VENN = [(False, True, False, 30613.490474), (True, False, False, 12427.665717), (True, True, False, 603.602853),
        (False, False, True, 998.317879), (True, False, True, 189.904924), (False, True, True, 5.136705),
        (True, True, True, 3.698341)]


def test_venn_sizes_and_regions(spark):
    v = spark.createDataFrame(VENN, "Gender boolean, Climate boolean, Disability boolean, usd_disbursement double")
    sizes = overlap.set_sizes(v)
    s = sizes.first().asDict()
    assert s == {"c": 31226.0, "g": 13225.0, "d": 1197.0, "cg": 607.0, "cd": 9.0, "gd": 194.0, "cgd": 4.0}
    r = overlap.venn_regions(sizes).first().asDict()
    parts = ("only_c", "only_g", "only_d", "cg_only", "cd_only", "gd_only", "cgd")
    assert sum(r[k] for k in parts) == r["union_size"]
    rng = overlap.element_ranges(sizes)
    got = {a + b: overlap.intersect_size(rng, a, b).first()[0]
           for a, b in (("gender", "disability"), ("climate", "disability"), ("climate", "gender"))}
    assert got == {"genderdisability": 194, "climatedisability": 9, "climategender": 607}
    n = {row[0]: row[1] for row in rng.groupBy("set_name").agg(F.sum(F.col("hi") - F.col("lo") + 1)).collect()}
    assert n == {"climate": 31226, "gender": 13225, "disability": 1197}


def test_rollup_matches_two_queries(spark):
    rows = [(y, g, c, d, float(i)) for i, (y, g, c, d) in enumerate(
        [(2020, True, False, False), (2020, False, False, False), (2021, True, True, False), (2021, True, False, False)])]
    df = spark.createDataFrame(rows, "year int, principal_gender boolean, principal_climate boolean, "
                                     "principal_disability boolean, usd_disbursement double")
    r = overlap.overlap_rollup(df)
    assert r.where(~F.col("is_total")).count() == 4
    tot = {(x[1], x[2]): x[4] for x in r.where(F.col("is_total")).collect()}
    assert tot == {(True, False): 3.0, (True, True): 2.0}                        # no all-false row


def test_replicate_blocks(spark):
    df = spark.createDataFrame([("a", 2.1), ("b", 0.0), ("c", -1.0), ("d", 2500.0)], "k string, n double")
    got = {r[0]: r[1] for r in overlap.replicate(df, "n", block=1000, spread=4).groupBy("k").count().collect()}
    assert got == {"a": 3, "d": 2500}


def test_complete_zero_fill(spark):
    df = spark.createDataFrame([("Kenya", "Gender", 3), ("Uganda", "Disability", 1)], "country string, label string, value long")
    got = {(r[0], r[1]): r[2] for r in overlap.complete(df, "country", "label", ("Gender", "Disability"), "value").collect()}
    assert got == {("Kenya", "Gender"): 3, ("Kenya", "Disability"): 0, ("Uganda", "Gender"): 0, ("Uganda", "Disability"): 1}


def _skewed(spark, n=3000):
    rng = np.random.default_rng(7)
    vals = np.where(np.arange(n) < n // 3, 0.5, rng.random(n))                  # a third share one value
    grp = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c"], n))
    return spark.createDataFrame([(int(i), str(g), float(v)) for i, (g, v) in enumerate(zip(grp, vals))],
                                 "id long, g string, v double"), vals


def test_exact_percentiles_match_type7(spark):
    df, vals = _skewed(spark)
    probs = (0.01, 0.1, 0.5, 0.9, 0.99)
    got = [r["v"] for r in curate.percentiles(df, "v", probs, splits=7).collect()]
    assert np.allclose(got, np.quantile(vals, probs), atol=1e-12)                # R type 7 = numpy linear


def test_rank_within_matches_row_number_on_skew(spark):
    from pyspark.sql import Window
    df, _ = _skewed(spark)
    a = ranking.rank_within(df, ["g"], ["v", "id"], "r", splits=9)
    b = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert sorted(map(tuple, a.select("id", "r").collect())) == sorted(map(tuple, b.select("id", "r").collect()))


def test_budget_shares_and_labels(spark):
    df = spark.createDataFrame([
        ("K", True, False, False, 10.0, None), ("K", True, True, False, 5.0, 5.0), ("K", False, False, False, 80.0, None),
        ("U", False, False, True, 1.0, 1.0)],
        "country string, principal_gender boolean, principal_climate boolean, principal_disability boolean, "
        "amount double, approved double")
    v = {(r["country"], r["label"]): (r["value"], r["total"], round(r["percentage"], 6))
         for r in compare_budgets(df, "value", ("amount", "approved")).collect()}
    assert v == {("K", "Gender"): (10.0, 100.0, 0.1), ("K", "Climate change"): (10.0, 100.0, 0.1),
                 ("U", "Disability"): (2.0, 2.0, 1.0)}
    c = {(r["country"], r["label"]): r["value"] for r in compare_budgets(df, "count").collect()}
    assert c == {("K", "Gender"): 1, ("K", "Climate change"): 1, ("U", "Disability"): 1}
    assert budget_value(df, "amount").count() == 4


def test_equal_years_are_no_join_key_and_lines_are_not_shuffled_for_customers(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = E.queries()["aid_debt_ratio_same_year"](spark, SF001)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not any("year(" in x for x in plan if "hashpartitioning" in x or " Sort [" in x)
    at, customers = next((i, x) for i, x in enumerate(plan) if "SortMergeJoin" in x and "c_custkey" in x)
    depth = customers.index("SortMergeJoin")
    below = plan[at + 1:]
    end = next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-*()0123456789")) <= depth), len(below))
    assert not any("l_orderkey" in x for x in below[:end])
