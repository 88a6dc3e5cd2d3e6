"""Marker rules (N1, N2, N11, N12, D9, D14) and the prediction pipeline
(N3, N4, C01-C03, J01) on hand-made activity frames."""

import numpy as np
from pyspark.sql import functions as F

from thematica.functions import markers as M
from thematica.functions.lexicon import Lexicon
from thematica.operators import automate, scoring

SCHEMA = ("id int, project_title string, short_description string, long_description string, "
          "gender int, climate_adaptation int, climate_mitigation int, disability int, usd double")

ROWS = [
    (1, "women and girls", None, None, 0, 0, 1, 0, 10.0),          # fully screened
    (2, "women and girls", None, None, None, 0, 1, 0, 20.0),       # gender unscreened
    (3, "solar energy", "-", None, 1, None, None, 2, 30.0),        # climate unscreened
    (4, "", "-", None, None, None, None, None, 40.0),              # blank, nothing screened
    (5, "women solar", None, "x", 3, 0, 0, 0, 50.0),               # out-of-domain gender marker
    (6, "women and girls", None, None, None, 0, 1, 0, 60.0),       # duplicate key of 2
    (7, "solar", None, "wheelchair", None, None, 0, None, None),   # null amount
]


def lexicons():
    return {"gender": Lexicon("g", ("women", "girls")), "climate": Lexicon("c", ("solar",)),
            "disability": Lexicon("d", ("wheelchair",))}


def scorers():
    return {g: scoring.lexicon_hit_scorer(g, lex, 0.5, 1.5) for g, lex in lexicons().items()}


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_screened_and_flags(spark):
    df = spark.createDataFrame([(None, None, 2, 1), (0, None, None, None), (2, 1, 0, 3)],
                               "gender int, climate_adaptation int, climate_mitigation int, disability int")
    got = df.select(M.screened("gender").alias("g"), M.screened("climate").alias("c"),
                    M.all_screened().alias("a")).collect()
    assert [tuple(r) for r in got] == [(False, True, False), (True, False, False), (True, True, False)]


def test_theme_flag_null_is_false(spark):
    df = spark.createDataFrame([(None, None, None), (2, None, None), (None, True, True), (0, True, None)],
                               "gender int, gender_pri_pred boolean, gender_kw boolean")
    got = [r[0] for r in df.select(M.theme_flag("gender", "pri")).collect()]
    assert got == [False, True, True, False]


def test_case_assign_last_rule_wins(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, None), (False, False, False)], "a boolean, b boolean, c boolean")
    lab = M.case_assign([(F.col("a"), "A"), (F.col("b"), "B"), (F.col("c"), "C")], default="")
    assert [r[0] for r in df.select(lab).collect()] == ["B", "A", ""]


def test_cap_and_multi_hot(spark):
    df = spark.createDataFrame([(None,), (0,), (1,), (2,), (3,)], "m int")
    got = df.select(M.cap_marker("m").alias("c"), M.multi_hot(F.col("m"), (1, 2)).alias("h"),
                    M.multi_hot(F.col("m"), (1, 2), ordinal=True).alias("o")).collect()
    assert [r["c"] for r in got] == [None, 0, 1, 2, 2]
    assert [r["h"] for r in got] == [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]
    assert [r["o"] for r in got] == [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [1.0, 1.0]]


def _pred(spark, **kw):
    out = scoring.predict_activities(frame(spark), scorers(), lexicons(), **kw)
    return {r["id"]: r.asDict() for r in out.collect()}


def test_predict_screened_rows_have_no_predictions(spark):
    p = _pred(spark)
    assert p[1]["gender_sig_pred"] is None and p[1]["climate_kw"] is None      # N11
    assert p[2]["gender_kw"] is True and p[2]["gender_pri_pred"] is True        # 2 hits -> principal
    # screened climate keeps the seed; marker 1 -> significant predicted with confidence 1
    assert p[2]["mitigation_sig_pred"] is True and p[2]["mitigation_sig_conf"] == 1.0
    assert p[3]["disability_pri_pred"] is True and p[3]["disability_pri_conf"] == 1.0
    assert 5 in p and p[5]["gender_sig_pred"] is not None                       # D3 default keeps it
    assert p[2] == {**p[6], "id": 2, "usd": 20.0}                              # duplicate key scored alike


def test_predict_strict_partition_drops_out_of_domain(spark):
    assert 5 not in _pred(spark, strict_partition=True)                          # N12


def test_predict_strategies_agree(spark):
    a = _pred(spark)
    assert _pred(spark, dedupe=False) == a
    assert _pred(spark, salt=3) == a


def test_join_back_null_safe(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, None, None)], "id int, k1 string, k2 string")
    scored = spark.createDataFrame([("a", None, 10), (None, "b", 20), (None, None, 30)], "k1 string, k2 string, s int")
    got = {r["id"]: r["s"] for r in scoring.join_back(rows, scored, ["k1", "k2"]).collect()}
    assert got == {1: 10, 2: 20, 3: 30}


def test_pandas_scorer_matches_expression_scorer(spark):
    words = ("women", "girls")

    def load():
        return set(words)

    def predict(model, texts):
        hits = np.array([len(set(t.split(" ")) & model) for t in texts], dtype=float)
        return np.stack([1 / (1 + np.exp(-(hits - 0.5))), 1 / (1 + np.exp(-(hits - 1.5)))], axis=1)

    ps = scoring.PandasScorer("gender", tuple(M.group_labels("gender")), load, predict, "test-model")
    sc = scorers()
    sc_p = {**sc, "gender": ps}
    a = scoring.predict_activities(frame(spark), sc, lexicons()).select("id", "gender_sig_conf", "gender_pri_pred")
    b = scoring.predict_activities(frame(spark), sc_p, lexicons()).select("id", "gender_sig_conf", "gender_pri_pred")
    ra = {r[0]: (None if r[1] is None else round(r[1], 9), r[2]) for r in a.collect()}
    rb = {r[0]: (None if r[1] is None else round(r[1], 9), r[2]) for r in b.collect()}
    assert ra == rb


def test_pandas_scorer_loads_once_a_worker_and_per_theme(spark):
    loads, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def scorer(group, value):
        def load():
            loads.add(1)
            return value

        def predict(model, texts):
            seen.add(len(texts))
            return np.full((len(texts), 2), model)

        return scoring.PandasScorer(group, ((group, "sig"), (group, "pri")), load, predict)

    df = spark.range(640).selectExpr("id", "id % 4 = 0 AS act", "array(array('a', 'b'), array('c')) AS chunks").repartition(32, "id")
    for group, value in (("gender", 0.25), ("disability", 0.75)):
        out = scorer(group, value).apply(df, "chunks", F.col("act")).collect()
        assert all(r[scoring.raw_col(group, "sig")] == (value if r.act else None) for r in out) and len(out) == 640
    assert seen.value == 2 * 2 * 160                       # the chunks of active rows only
    assert loads.value < 2 * 32                            # not once a task


def test_automate_blank_mask_and_climate_union(spark):
    p = scoring.predict_activities(frame(spark), scorers(), lexicons())
    a = {r["id"]: r for r in automate.automate_activities(p, significant=True).collect()}
    assert a[1]["principal_gender"] is False and a[1]["principal_climate"] is False
    assert a[2]["principal_gender"] is True
    assert a[3]["principal_disability"] is True                                  # marker 2
    assert a[4]["principal_gender"] is False                                     # blank record masked
    # one model word: significant (not principal) prediction, AND-ed with the lexicon match
    assert a[7]["principal_disability"] is False and a[7]["significant_disability"] is True
    # climate counts as screened when either marker is (mitigation 0): not scored, seed only
    assert a[7]["significant_climate"] is False and a[7]["climate_kw"] is True
