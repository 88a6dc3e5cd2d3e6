"""T01-T19 on hand-made texts."""

from pyspark.sql import functions as F

from thematica.functions import text as T
from thematica.functions.lexicon import Lexicon, keyword_match, normalise_word


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_clean_text_unicode_and_blanks(spark):
    rows = [("L'ÉLECTRICITÉ, mini-réseaux",), ("word_with_underscore!",), ("€",), ("",), ("-",), (" ",),
            (None,), ("Énergie  propre\n\tpour TOUS",)]
    df = spark.createDataFrame(rows, "v string")
    got = [r["c"] for r in df.select(T.clean_text("v").alias("c")).collect()]
    assert got == ["l électricité mini réseaux", "word_with_underscore", None, None, None, None, None,
                   "énergie propre pour tous"]


def test_clean_text_r_keeps_symbols_drops_underscore(spark):
    assert _one(spark, T.clean_text_r(F.col("v")), "Énergie_€  (2022)") == "énergie €  2022".replace("  ", " ")
    assert _one(spark, T.clean_text_r(F.col("v")), "  -  ") == ""


def test_lexicon_normalised_like_text(spark):
    lex = Lexicon("c", ("L'électricité", "mini-reseaux", "climate change", "adapt"))
    assert lex.entries == ("l électricité", "mini reseaux", "climate change", "adapt")
    df = spark.createDataFrame([("Access to l'électricité",), ("CLIMATE-change adaptation",), ("adapt.",),
                                ("adaptation",), (None,)], "v string")
    got = [r["m"] for r in df.select(keyword_match(T.clean_text("v"), lex).alias("m")).collect()]
    assert got == [True, True, True, False, False]
    # raw style reproduces entries with punctuation never matching cleaned text
    assert normalise_word("L'électricité", "raw") == "l'électricité"


def test_build_text_null_handling(spark):
    df = spark.createDataFrame([("a", None, "c"), (None, None, None)], "x string, y string, z string")
    got = df.select(T.build_text(["x", "y", "z"]).alias("s"), T.build_text(["x", "y", "z"], na="NA").alias("r")).collect()
    assert [tuple(r) for r in got] == [("a c", "a NA c"), ("", "NA NA NA")]


def test_chunking_sizes(spark):
    rows = [(n,) for n in (0, 1, 511, 512, 513, 1025)]
    df = spark.createDataFrame(rows, "n int").withColumn(
        "tok", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i.cast("string"))))
    df = df.withColumn("ch", T.chunk_tokens(F.col("tok")))
    got = {r["n"]: [len(c) for c in r["ch"]] for r in df.select("n", "ch").collect()}
    assert got == {0: [], 1: [1], 511: [511], 512: [512], 513: [257, 256], 1025: [342, 342, 341]}


def test_text_stats_and_misc(spark):
    r = spark.createDataFrame([("2019-05-01 x y",)], "v string").select(
        T.space_count("v").alias("s"), T.first_token("v").alias("f"), T.year_prefix("v").alias("y"),
        T.strip_artifacts(F.lit("a_x005Fb_x000D_c")).alias("a"), T.fmt_percent(F.lit(0.455)).alias("p")).first()
    assert (r["s"], r["f"], r["y"], r["a"], r["p"]) == (2, "2019-05-01", 2019, "ab c", "46%")
    assert _one(spark, T.year_prefix("v"), "n/a") is None   # N8: junk -> null, no error


def test_levenshtein_ratio(spark):
    df = spark.createDataFrame([("abcdefghij", "abcdefghij"), ("abcdefghij", "abcdefghiX"),
                                ("abcdefghij", "xyz")], "a string, b string")
    exact = [r[0] for r in df.select(T.levenshtein_ratio("a", "b")).collect()]
    banded = [r[0] for r in df.select(T.levenshtein_ratio("a", "b", 0.2)).collect()]
    assert exact == [0.0, 0.1, 1.0]
    assert banded[:2] == [0.0, 0.1] and banded[2] >= 0.2
