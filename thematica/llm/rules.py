"""Adaptive quality rules (DataFrame functions only).

Fixed cut-offs are replaced by fences per language and source.  The quantiles
come from a mergeable sketch: a histogram of each measure in steps of one
thousandth, 0 to 1000, kept as rows (language, source, measure, bin, count).
Sketches of tasks merge by adding counts (Spark's partial aggregation), those
of sources merge into their language's and those into the whole table's in the
same way.  A group with fewer than ``min_rows`` documents takes the next wider
group's fences.  Counts are integers, so the result doesn't depend on the
order in which partitions are merged or recomputed.

Defined results: a null text has no words, no lines and fails the base rule;
null languages and sources are groups of their own; repeated rows are judged
one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from thematica._util import stage

from .shared import materialise, pick

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: (measure, slack above the upper fence, slack below the lower one or None), in thousandths
MEASURES = (
    ("symbols", 20, None),
    ("dup_lines", 200, None),
    ("repeats", 100, None),
    ("upper", 100, None),
    ("word_length", 100, 20),
)
FENCE = 3
MIN_ROWS = 100


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def counts(df: DataFrame, text: str = "text", keep: dict | None = None) -> DataFrame:
    """``keep`` columns (new name -> column) and the counts of each text:
    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper."""
    keep = keep or {}
    x = pick(df, **keep, _t=text).withColumn("_t", F.coalesce("_t", F.lit("")))
    x = stage(x, {"_w": F.array_remove(F.split("_t", SPACE), ""),
                  "_l": F.filter(F.split("_t", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))})
    # windows of three words as (hash, place), sorted, so equal ones are neighbours
    grams = F.transform(F.sequence(F.lit(0), F.size("_w") - 3),
                        lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"),
                                           i.alias("p")))
    none = F.lit(None).cast("array<struct<h:bigint,p:int>>")
    x = stage(x, {"_g": F.sort_array(F.when(F.size("_w") >= 3, grams).otherwise(none))})
    same = lambda a, i: F.coalesce(a.h == F.get("_g", i).h, F.lit(False))
    twice = F.filter("_g", lambda a, i: same(a, i - 1) | same(a, i + 1))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda a: F.array(a.p, a.p + 1, a.p + 2))))
    return x.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(_without(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_g").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        (F.length("_t") - F.length(_without(F.col("_t"), UPPER))).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _measure(name: str) -> Column:
    """A measure in whole thousandths, 0 to 1000 (integer arithmetic)."""
    num, den = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
                "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"),
                "word_length": ("word_chars", "n_words")}[name]
    scale = 10 if name == "word_length" else 1000
    return F.least(F.lit(1000), F.expr(f"cast({scale} * {num} div greatest({den}, 1) as int)"))


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """Histogram sketches: (by..., measure, bin, n)."""
    bins = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_m_{m}").alias("bin")) for m, _, _ in MEASURES]))
    return (measured.select(*by, bins.alias("_b")).groupBy(*by, "_b.measure", "_b.bin")
            .agg(F.count(F.lit(1)).alias("n")))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """One row per group: rows in it, and an upper and lower fence for each
    measure, from the quartiles (the least bin whose running count reaches the
    share).  A group has at most 1001 bins per measure."""
    w = W.partitionBy(*by, "measure")
    x = (sketches.withColumn("_c", F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
         .withColumn("_n", F.sum("n").over(w)))
    quart = lambda p: F.min(F.when(4 * F.col("_c") >= p * F.col("_n"), F.col("bin")))
    x = x.groupBy(*by, "measure").agg(quart(1).alias("lo"), quart(3).alias("hi"), F.max("_n").alias("n"))
    out = [F.max("n").alias(f"{prefix}_n")]
    for m, up, down in MEASURES:
        this = F.col("measure") == m
        iqr = F.col("hi") - F.col("lo")
        out.append(F.max(F.when(this, F.col("hi") + FENCE * iqr + up)).alias(f"{prefix}_hi_{m}"))
        if down is not None:
            out.append(F.max(F.when(this, F.col("lo") - FENCE * iqr - down)).alias(f"{prefix}_lo_{m}"))
    return x.groupBy(*by).agg(*out) if by else x.agg(*out)


def apply_rules(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                min_rows: int = MIN_ROWS) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and ``level``, the group
    whose fences judged it (source, lang or all)."""
    c = counts(df, text, {"doc_id": doc_id, "_lang": lang, "_source": source})
    c = c.withColumn("base_failed", base_failed()).select("*", *[_measure(m).alias(f"_m_{m}") for m, _, _ in MEASURES])
    c = materialise(c, "counts")  # read twice: once for the sketches, once to be judged
    s1 = materialise(sketch(c.where(~F.col("base_failed")), ["_lang", "_source"]), "sketches")
    s2 = merge(s1, ["_lang"])
    s3 = merge(s1, [])
    f1 = fences(s1, ["_lang", "_source"], "s").withColumnsRenamed({"_lang": "_l1", "_source": "_s1"})
    f2 = fences(s2, ["_lang"], "l").withColumnRenamed("_lang", "_l2")
    f3 = fences(s3, [], "a")
    x = (c.join(f1, F.col("_lang").eqNullSafe(F.col("_l1")) & F.col("_source").eqNullSafe(F.col("_s1")), "left")
         .join(f2, F.col("_lang").eqNullSafe(F.col("_l2")), "left")
         .join(F.broadcast(f3), F.lit(True), "left"))  # f3 is one row
    level = (F.when(F.coalesce("s_n", F.lit(0)) >= min_rows, "source")
             .when(F.coalesce("l_n", F.lit(0)) >= min_rows, "lang").otherwise("all"))
    fence = lambda side, m: (F.when(F.col("level") == "source", F.col(f"s_{side}_{m}"))
                             .when(F.col("level") == "lang", F.col(f"l_{side}_{m}")).otherwise(F.col(f"a_{side}_{m}")))
    ok = F.lit(True)
    x = x.withColumn("level", level)
    for m, _, down in MEASURES:
        ok = ok & F.coalesce(F.col(f"_m_{m}") <= fence("hi", m), F.lit(True))
        if down is not None:
            ok = ok & F.coalesce(F.col(f"_m_{m}") >= fence("lo", m), F.lit(True))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ok).alias("kept"), "level")
