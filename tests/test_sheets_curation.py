"""Ordered fills (W01, W02, D6, D7), sheet normalisation (X06), near-dups
(W03, W04, D5), curation criteria (X08, X09) and training prep (W06, O06)."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from thematica.operators import budgets, curate, ranking, training


def _sheet(spark, n=2000):
    rng = np.random.default_rng(3)
    block = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 6, n))            # block 0 holds a third
    val = np.where(rng.random(n) < 0.1, None, None)
    rows = []
    for i in range(n):
        v = f"h{i}" if rng.random() < 0.08 else val[i]
        rows.append((int(block[i]), int(i), v))
    return spark.createDataFrame(rows, "block int, ord long, v string")


def test_fills_equal_window(spark):
    df = _sheet(spark)
    for fn, w in ((budgets.fill_down, F.last("v", ignorenulls=True).over(Window.partitionBy("block").orderBy("ord"))),
                  (budgets.fill_up, F.last("v", ignorenulls=True).over(Window.partitionBy("block").orderBy(F.desc("ord"))))):
        a = df.select("ord", w.alias("f")).collect()
        b = fn(df, "v", "block", "ord", out="f", splits=11).select("ord", "f").collect()
        assert sorted(map(tuple, a), key=lambda t: t[0]) == sorted(map(tuple, b), key=lambda t: t[0])


def _large(spark, n=200_000):
    """Rows enough for range partitioning to sample, with a column that no segment table needs."""
    return spark.range(n).selectExpr(
        "id AS ord", f"int(least(id * 3 div {n}, 2)) AS block", "if(xxhash64(id) % 50 = 0, concat('h', id), null) AS v",
        "concat(md5(string(id)), md5(string(id + 1))) AS text", "repeat(md5(string(id)), 3) AS payload").repartition(16)


def test_large_segments_match_windows(spark):
    """Ranks, fills and neighbours over segments equal plain windows on 200,000 rows with a payload column."""
    df = _large(spark).cache()
    w = Window.partitionBy("block").orderBy("text")
    r = ranking.rank_within(df, "block", "text", "r").withColumn("want", F.row_number().over(w))
    assert r.count() == 200_000 and r.where("r <> want").count() == 0
    for fn, o in ((budgets.fill_down, F.asc("ord")), (budgets.fill_up, F.desc("ord"))):
        want = F.last("v", ignorenulls=True).over(Window.partitionBy("block").orderBy(o).rowsBetween(Window.unboundedPreceding, 0))
        assert fn(df, "v", "block", "ord", out="f").withColumn("want", want).where("not f <=> want").count() == 0
    x = curate.adjacent_next(df, "text", "ord").withColumn("want", F.lead("text").over(Window.orderBy("text", "ord")))
    assert x.where("not next_text <=> want").count() == 0
    s = training.stratified_split(df, "block", 0.2, key_cols=("text",))
    got = {r.block: (r.n, r.t) for r in s.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.expr("int(split = 'test')")).alias("t")).collect()}
    assert all(t == round(0.2 * n) for n, t in got.values()) and len(got) == 3
    df.unpersist()


def test_fill_up_is_linear_in_the_block(spark):
    import time
    df = spark.range(60_000).selectExpr("1 AS block", "id AS ord", "if(id % 20000 = 19999, 'x', null) AS v")
    t = time.time()
    assert budgets.fill_up(df, "v", "block", "ord").where("v is null").count() == 0
    assert time.time() - t < 60


def test_fill_down_details_before_first_header(spark):
    df = spark.createDataFrame([(0, 1, None), (0, 2, "A"), (0, 3, None), (1, 1, None), (1, 2, "B")],
                               "block int, ord int, v string")
    got = [r[0] for r in budgets.fill_down(df, "v", "block", "ord").orderBy("block", "ord").select("v").collect()]
    assert got == [None, "A", "A", None, "B"]                                    # no leak across blocks (D6)


def test_clean_budget_ke(spark):
    rows = [(1, "Programme", "x"), (2, "0101 Health_x000D_services", "5"), (3, "0102 Roads", "junk"),
            (4, "Total Expenditure for Vote 101 Ministry", "9"), (5, "0201 Water", "7"), (6, None, "1"),
            (7, "Total Expenditure for Vote 202 Water_x005F Agency", "3"), (8, "0301 Trailing", "2")]
    df = spark.createDataFrame([(s, o, p, v, "2019") for o, p, v in rows for s in ("s",)],
                               "sheet string, row_ord int, program string, value string, year string")
    got = [(r["program"], r["value"], r["vote"], r["text"]) for r in
           budgets.clean_budget_ke(df).orderBy("row_ord").collect()]
    assert got == [("0101 Health services", 5.0, "101 Ministry", "101 Ministry 0101 Health services"),
                   ("0102 Roads", None, "101 Ministry", "101 Ministry 0102 Roads"),
                   ("0201 Water", 7.0, "202 Water Agency", "202 Water Agency 0201 Water")]


def test_near_dups_rules(spark):
    base = "abcdefghijklmnopqrst"                                                # 20 chars
    rows = [(1, base), (2, base), (3, base[:-1] + "X"), (4, base[:-4] + "WXYZ"), (5, "zzzzzzzzzzzzzzzzzzzzzz")]
    df = spark.createDataFrame(rows, "id int, text string")
    dist = {r["id"]: r["dist"] for r in curate.near_dup_distance(df, "text", "id").collect()}
    # binary order: 4 (..WXYZ) < 3 (..qrsX) < 1 = 2 (by id) < 5; uppercase sorts first
    assert dist[4] == 0.2 and dist[3] == 0.05 and dist[1] == 0.0 and dist[2] >= 0.2 and dist[5] is None
    kept = sorted(r[0] for r in curate.drop_near_dups(df, "text", "id").collect())
    assert kept == [2, 4, 5]                                                     # exactly 20 % is kept; last kept
    kept_ref = sorted(r[0] for r in curate.drop_near_dups(df, "text", "id", keep_last=False).collect())
    assert kept_ref == [2, 4]                                                    # D5 reference behaviour


def test_adjacent_next_matches_global_lead(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(rng.choice(words, 3))) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, text string")
    a = curate.adjacent_next(df, "text", "id", splits=13).select("id", "next_text").collect()
    b = df.withColumn("next_text", F.lead("text").over(Window.orderBy("text", "id"))).select("id", "next_text").collect()
    assert sorted(map(tuple, a), key=lambda t: t[0]) == sorted(map(tuple, b), key=lambda t: t[0])


def test_climate_flags_thresholds(spark):
    df = spark.createDataFrame([
        ("t1", 2, 0, "True", 0.2, 0.3, 0.0, 0.0),      # adaptation principal stronger than significant
        ("t2", 0, 0, "False", 0.001, 0.001, 0.005, 0.005),  # true negatives
        ("t3", 0, 1, "True", 0.99, 0.1, 0.2, 0.0),     # fp_sig_a and fn_sig_m
    ], "text string, adapt_sig int, mitig_sig int, match string, adapt_sig_conf double, adapt_pri_conf double, "
       "mitig_sig_conf double, mitig_pri_conf double")
    x = df.withColumns({"adapt_sig_pred": F.col("adapt_sig_conf") > 0.5, "adapt_pri_pred": F.col("adapt_pri_conf") > 0.5,
                        "mitig_sig_pred": F.col("mitig_sig_conf") > 0.5, "mitig_pri_pred": F.col("mitig_pri_conf") > 0.5})
    f = {r["text"]: r for r in curate.climate_hard_flags(x).collect()}
    assert f["t1"]["a_strong_pri_weak_sig"] and not f["t1"]["tn_a"]
    assert f["t2"]["tn_a"] and f["t2"]["tn_m"]
    assert f["t3"]["fp_sig_a"] and f["t3"]["fn_sig_m"]


def test_stratified_split_counts_and_downsample(spark):
    rows = [(i, "a" if i < 50 else ("b" if i < 57 else "c")) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, lab string")
    s = training.stratified_split(df, "lab", 0.2, 42, ("id",))
    got = {(r[0], r[1]): r[2] for r in s.groupBy("lab", "split").count().collect()}
    assert got == {("a", "test"): 10, ("a", "train"): 40, ("b", "test"): 1, ("b", "train"): 6,
                   ("c", "test"): 1, ("c", "train"): 2}                          # bround(0.2 n) = 10, 1, 1
    d = spark.createDataFrame([(i, 0 if i < 3 else 1) for i in range(10)], "id int, sig int")
    assert training.downsample(d, "sig", 0, 42, ("id",)).count() == 10          # fewer negatives: keep all (D17)


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([([0.9, 0.1], [1.0, 0.0]), ([0.2, 0.3], [0.0, 0.0])],
                               "predictions array<double>, labels array<double>")
    m = {r["class_idx"]: r for r in training.metrics_per_class(df).collect()}
    assert (m[0]["precision"], m[0]["recall"], m[0]["f1"], m[0]["accuracy"]) == (1.0, 1.0, 1.0, 1.0)
    assert (m[1]["precision"], m[1]["recall"], m[1]["f1"]) == (0.0, 0.0, 0.0)
    w = {r[0]: r[1] for r in training.class_weights(df).collect()}
    assert w == {0: 1.0, 1: None}
