"""Keyword discovery/scoring (X10, X11, J02, J03, O05), synthetic requests
(X15, T17, T18, A35), vectors (G03-G05) and the streaming path."""

import math

import numpy as np
from pyspark.sql import functions as F

from thematica.functions.lexicon import Lexicon
from thematica.operators import keywords, synthetic, vectors
from thematica.session import write_table
from thematica.streaming import flags as ST


def test_lexicon_join_words_and_phrases(spark):
    lex = Lexicon("v", ("solar", "climate change", "wind", "solar"))
    df = spark.createDataFrame([(1, "solar panels and climate change"), (2, "wind wind solar"), (3, None)],
                               "id int, clean string")
    got = sorted(tuple(r) for r in keywords.lexicon_join(df, "clean", lex, "id").collect())
    assert got == [(1, "climate change"), (1, "solar"), (2, "solar"), (2, "wind")]


def test_keyword_scores_order_duplicates_and_zero(spark):
    lex = Lexicon("v", ("solar", "wind", "solar", "hydro"))
    df = spark.createDataFrame([("solar wind", 0.2), ("solar", 0.6)], "_clean string, s double")
    got = [tuple(r) for r in keywords.keyword_scores(df, lex, ["s"]).orderBy("kw_no").collect()]
    assert got == [(0, "solar", 0.4), (1, "wind", 0.2), (2, "solar", 0.4), (3, "hydro", 0.0)]


def test_top_words_exclusion_and_ties(spark):
    sc = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.5), (1, "a", 0.8), (1, "c", 0.7), (1, "d", 0.7),
                                (2, "c", 0.9), (2, "e", 0.1), (2, "z", 0.0)], "cls int, word string, score double")
    got = sorted(tuple(r) for r in keywords.top_words(sc, "cls", (0, 1, 2), k=1).select("cls", "rank", "word").collect())
    assert got == [(0, 1, "a"), (1, 1, "c"), (2, 1, "e")]                     # c tie with d broken by word


def test_class_tfidf_matches_formula(spark):
    docs = spark.createDataFrame([(1, 0, ["x", "y", "y"]), (2, 1, ["y", "z"]), (3, 1, ["z"])],
                                 "doc long, cls int, tok array<string>")
    words = keywords.explode_words(docs, "doc", "cls", "tok", stop=())
    sc = {(r[0], r[1]): r[2] for r in keywords.class_tfidf(words, F.lit(3), "doc", "cls").collect()}
    idf = {w: math.log(4 / (1 + d)) + 1 for w, d in (("x", 1), ("y", 2), ("z", 2))}
    raw0 = {"x": 1 * idf["x"], "y": 2 * idf["y"]}
    n0 = math.sqrt(sum(v * v for v in raw0.values()))
    assert abs(sc[(0, "y")] - raw0["y"] / n0) < 1e-12 and abs(sc[(0, "x")] - raw0["x"] / n0) < 1e-12


def test_synthetic_prompts_cost_and_unpack(spark):
    ex = spark.createDataFrame([("a short text here", "Significant"), ("another", "Principal")], "text string, label string")
    pr = synthetic.prepare_prompts(ex)
    p = {r["label"]: r["system_prompt"] for r in pr.collect()}
    assert "write 10 synthetic records" in p["Significant"] and "'Significant disability objective'" in p["Significant"]
    cost = synthetic.estimate_cost(pr).first()
    n_prompt = {k: len(v.split()) for k, v in p.items()}
    assert cost["tokens"] == n_prompt["Significant"] + n_prompt["Principal"] + 11 * (4 + 1)
    assert cost["cost"] == round(cost["tokens"] / 1e6 * 0.15, 4)
    resp = spark.createDataFrame([("one <sep>  two<sep> <sep>", "Principal")], "response string, label string")
    assert sorted(tuple(r) for r in synthetic.unpack_responses(resp).collect()) == [("one", "Principal"), ("two", "Principal")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 4.0]), (3, 1, [0.0, 0.0])],
                               "id int, k int, v array<float>")
    m = {r[0]: r[1] for r in vectors.mean_pool(df, "v", "k").collect()}
    assert m == {0: [2.0, 3.0], 1: [0.0, 0.0]}
    n = {r[0]: r[1] for r in df.select("id", vectors.l2_normalize("v")).collect()}
    assert np.allclose(n[1], [1 / math.sqrt(5), 2 / math.sqrt(5)]) and n[3] == [0.0, 0.0]
    f = {r[0]: r[1] for r in vectors.flatten_pool(df, "v", "k", "id").collect()}
    assert f[0] == [1.0, 2.0, 3.0, 4.0]


def test_stream_keyword_flags(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "Solar power!"), (2, "nothing")], "doc_id long, text string").write.parquet(str(src))
    s = ST.read_stream(spark, str(src), "doc_id long, text string")
    out = ST.run_available(ST.keyword_flags(s, {"solar": Lexicon("s", ("solar",))}), "t_stream_kw")
    assert sorted((r["doc_id"], r["solar_kw"]) for r in out.collect()) == [(1, True), (2, False)]


def test_keyword_discovery_shuffles_no_document_word_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 0, ["y", "x", "y", "the"]), (2, 1, ["z", "y"]), (3, 1, ["z"]), (4, 1, []), (5, 0, None)],
                                 "doc long, cls int, tok array<string>")
    marked = keywords.explode_words(docs, "doc", "cls", "tok", stop=("the",), first="first")
    assert sorted((r.doc, r.word) for r in marked.where("first").collect()) == [(1, "x"), (1, "y"), (2, "y"), (2, "z"), (3, "z")]
    plain = keywords.explode_words(docs, "doc", "cls", "tok", stop=("the",))
    rows = [sorted((r.cls, r.word, round(r.score, 12)) for r in keywords.class_tfidf(x, F.lit(5), "doc", "cls", f).collect())
            for x, f in ((marked, "first"), (plain, None))]
    assert rows[0] == rows[1] and len(rows[0]) == 4
    plans = {}

    def write(x, name):
        plans[name] = x._jdf.queryExecution().executedPlan().toString()
        return write_table(x, name)

    monkeypatch.setattr(keywords, "write_table", write)
    df = spark.createDataFrame([(i, f"solar power number {i % 40}", i % 3) for i in range(60)], "id long, text string, sig int")
    out = keywords.discover_keywords(df, order_col="id", k=5).collect()
    assert len(out) == 15 and "texts" in plans and "_doc" not in plans["counts"]
