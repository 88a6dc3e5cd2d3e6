"""Join-back with heavy keys, kept scores and interval sweeps."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from thematica.functions.lexicon import Lexicon
from thematica.operators import overlap, scoring

rnd = random.Random(8)


@pytest.fixture
def no_aqe(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_only_heavy_keys_are_replicated(spark, no_aqe):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 2000}", None if i % 5 else "x") for i in range(24000)]
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(8)
    scored = df.select("a", "b").distinct().withColumn("score", F.length("a"))
    heavy = scoring.heavy_keys(df, ["a", "b"])
    assert len(heavy) == 2  # (hot, null) and (hot, x)
    assert scoring.replicate_heavy(scored, ["a", "b"], heavy, 16).count() == scored.count() + 2 * 15
    out = scoring.join_back(df, scored, ["a", "b"], salt=16)
    assert out.columns == ["id", "a", "b", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, a, b, len(a)) for i, a, b in rows), key=str)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 3 * median(sizes)


def test_rows_that_are_equal_are_dealt_too(spark, no_aqe):
    df = spark.createDataFrame([("hot",)] * 4000 + [(f"k{i}",) for i in range(4000)], "a string").repartition(16)
    scored = df.distinct().withColumn("score", F.length("a"))
    out = scoring.join_back(df, scored, ["a"], salt=16)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 1600 and out.where("score is null").count() == 0


def test_no_heavy_key(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(500)], "id int, a string")
    assert scoring.heavy_keys(df, ["a"]) == []
    assert scoring.heavy_keys(df.limit(0), ["a"]) == []
    assert scoring.join_back(df, df.select("a").withColumn("s", F.lit(1)), ["a"], salt=8).where("s = 1").count() == 500


def scorers(load):
    lex = {g: Lexicon(g, ("a", "b")) for g in ("gender", "climate", "disability")}
    from thematica.functions import markers as M
    return {g: scoring.PandasScorer(g, tuple(M.group_labels(g)), load, lambda m, ts, n=len(M.group_labels(g)): [[len(t) / 100] * n for t in ts], name="stored")
            for g in lex}, lex


def test_scores_are_kept_between_runs(spark, tmp_path):
    def refuse():
        raise AssertionError("a text was scored again")

    df = spark.createDataFrame([(i, f"text {i % 40}" if i % 7 else None) for i in range(200)], "id int, text string")
    store = scoring.ScoreStore(str(tmp_path / "scores"), "m1")
    once, lex = scorers(lambda: 1)
    plain = scoring.predict_budget(df, once, lex)
    part = scoring.predict_budget(df.where("id < 100 and id % 2 = 0"), once, lex, store=store)
    assert part.count() == 50
    first = scoring.predict_budget(df, once, lex, store=store)
    assert sorted(map(str, first.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    scoring._MODELS.clear()
    again, _ = scorers(refuse)
    for s in again.values():
        s.name = "not loaded yet"
    second = scoring.predict_budget(df, again, lex, store=store)
    assert sorted(map(str, second.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    kept = spark.read.parquet(store.path)
    assert kept.count() == kept.select("_hash").distinct().count() == 41  # 40 texts and the null one
    with pytest.raises(Exception, match="scored again"):  # another model's scores are not used
        scoring.predict_budget(df, again, lex, store=scoring.ScoreStore(str(tmp_path / "scores"), "m2")).collect()


def elements(rows, name):
    return {x for n, lo, hi in rows if n == name for x in range(lo, hi + 1)}


@pytest.mark.parametrize("splits", [1, 7])
def test_sweep_matches_sets(spark, splits):
    rows = [(rnd.choice("abc"), lo := rnd.randrange(-500, 500), lo + rnd.randrange(-2, 30)) for _ in range(80)]
    df = spark.createDataFrame(rows, "set_name string, lo long, hi long")
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "a"), ("a", "z")]
    got = {(r["a"], r["b"]): r["size"] for r in overlap.intersect_sizes(df, pairs, splits).collect()}
    assert got == {(p, q): len(elements(rows, p) & elements(rows, q)) for p, q in pairs}
    assert overlap.intersect_size(df.limit(0), "a", "b").first()[0] == 0


def test_sweep_of_many_ranges(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("set_name"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 4).alias("hi")).union(
        spark.range(n).select(F.lit("b"), F.col("id") * 10 + 3, F.col("id") * 10 + 8))
    out = overlap.intersect_sizes(df, [("a", "b")], 16)
    assert out.first()["size"] == 2 * n
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
