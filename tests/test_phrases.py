"""Phrase matching by word windows against padded substrings."""

import random

from pyspark.sql import functions as F

from thematica.functions.lexicon import Lexicon, keyword_match, matched_entries
from thematica.functions.text import clean_text
from thematica.plans.q_text import VOCAB_WIDE

rnd = random.Random(2)
WORDS = ["a", "b", "cé", "d_d", "e", "ff"]


def texts():
    out = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(12))) for _ in range(300)]
    return [*out, None, "", "a", "a b", "b a b", "A, b! cé?"]


def lexicons():
    grams = [" ".join(rnd.choice(WORDS) for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(6)]
    return [Lexicon("one", ("a", "ff")), Lexicon("two", ("a b", "b a", "e")), Lexicon("many", tuple(grams + grams[:5])),
            Lexicon("long", ("a b a b a b a", "ff ff")), Lexicon("none", ()), Lexicon("raw", ("a-b", "cé  e", "a b"), "raw")]


def test_matches_padded_substrings(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("c", clean_text("text")).withColumn("tok", F.split("c", " "))
    for lex in lexicons():
        got = df.select("c", matched_entries(F.col("c"), lex).alias("m"), keyword_match(F.col("c"), lex).alias("k"),
                        keyword_match(F.col("c"), lex, F.col("tok")).alias("k2")).collect()
        for r in got:
            want = {e for e in lex.entries if f" {e} " in f" {r['c'] or ''} "}
            assert (set(r["m"]), len(r["m"]), r["k"], r["k2"]) == (want, len(want), bool(want), bool(want)), (lex.name, r["c"])


def test_long_lists_are_probed_not_scanned(spark):
    df = spark.createDataFrame([("in the of",)], "c string")
    plan = df.select(matched_entries(F.col("c"), VOCAB_WIDE), keyword_match(F.col("c"), VOCAB_WIDE))._jdf.queryExecution().optimizedPlan().toString()
    assert " INSET " in plan and "instr(" not in plan and " RLIKE " not in plan
    assert len(VOCAB_WIDE.words) == 351 and len(VOCAB_WIDE.entries) < 351
