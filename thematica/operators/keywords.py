"""Keyword discovery (X10: class TF-IDF, A33, A34, O05, J03, T10) and
vocabulary scoring (X11: lexicon join J02 + mean scores A31).

The reference loops over keywords and rescans the data once per keyword
(351 passes).  Here each record's words are probed once against the lexicon's hash sets
(``lexicon.matched_entries``: a parameter list of bounded size), the matches are
exploded, and a single group-by averages the scores.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._util import col_of, money_sum, stage
from ..functions import text as T
from ..functions.lexicon import Lexicon, matched_entries
from ..session import write_table
from .ranking import rank_within

STOP_LANGS = ("english", "spanish", "french", "german")


@lru_cache(maxsize=None)
def stop_words(langs=STOP_LANGS) -> tuple:
    """T10 word lists: Spark ML's shipped stop-word lists for the languages.

    Read from the Spark ML jar's resources (no JVM needed, so SQL text that
    embeds the list can be built before any session exists); falls back to
    ``StopWordsRemover.loadDefaultStopWords``.  (The reference used another
    public list; both are parameters here.)
    """
    out = set()
    for lang in langs:
        out.update(_jar_stop_words(lang) or _jvm_stop_words(lang))
    return tuple(sorted(out))


def _jar_stop_words(lang: str):
    import glob
    import os
    import zipfile

    import pyspark

    for jar in glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            name = f"org/apache/spark/ml/feature/stopwords/{lang}.txt"
            if name in z.namelist():
                return [w for w in z.read(name).decode("utf-8").splitlines() if w]
    return None


def _jvm_stop_words(lang: str):
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(lang)


def doc_tokens(text, min_len: int = 2) -> Column:
    """T01 -> T11: cleaned tokens of >= min_len chars."""
    tok = T.tokens(T.clean_text(col_of(text)))
    return F.filter(tok, lambda t: F.length(t) >= min_len)


def explode_words(docs: DataFrame, doc_id: str, cls: str | None, tokens: str, stop=None, first: str | None = None) -> DataFrame:
    """(doc, class, word) rows without stop words (J05: broadcast anti-join
    against the stop-word table, a parameter list of bounded size).  With ``first``
    a column of that name marks one row of each word of an input row."""
    spark = docs.sparkSession
    words = stop_words() if stop is None else tuple(stop)
    sw = spark.createDataFrame([(w,) for w in words], "word string")
    cols = [doc_id] + ([cls] if cls else [])
    if first:  # sorted, a word's rows lie together
        docs = stage(docs, {"_sorted": F.sort_array(F.col(tokens))})
        w = F.col("_sorted")
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))))
        both = F.when(F.size(w) > 0, F.arrays_zip(w.alias("word"), before.alias("before")))
        x = docs.select(*cols, F.inline(both)).withColumn(first, ~F.col("word").eqNullSafe(F.col("before"))).drop("before")
    else:
        x = docs.select(*cols, F.explode(F.col(tokens)).alias("word"))
    return x.join(F.broadcast(sw), "word", "left_anti")


def doc_word_counts(words: DataFrame, doc_id: str, cls: str) -> DataFrame:
    """(doc, class, word, n): one shuffle, partially aggregated map-side."""
    return words.groupBy(doc_id, cls, "word").agg(F.count(F.lit(1)).alias("n"))


def idf(counts: DataFrame, n_docs: Column) -> DataFrame:
    """Smoothed idf = ln((1+n)/(1+df)) + 1; df = documents with the word,
    summed over the classes of ``counts``."""
    d = counts.groupBy("word").agg(F.sum("df").alias("df"))
    return d.withColumn("idf", F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + F.lit(1.0))


def class_tfidf(words: DataFrame, n_docs: Column, doc_id: str, cls: str, first: str | None = None) -> DataFrame:
    """Raw term counts of each class's concatenated text x idf,
    L2-normalised per class (norm over the class's (word) rows).  tf and df
    both come from one (class, word) count, written once.

    Where every document was one row, ``first`` names the mark that ``explode_words`` set: then df counts marks,
    and what is shuffled grows with the vocabulary of a task, not with the (document, word) pairs."""
    if first:
        counts = words.groupBy(cls, "word").agg(F.count(F.lit(1)).alias("tf"), F.count_if(F.col(first)).alias("df"))
    else:
        counts = doc_word_counts(words, doc_id, cls).groupBy(cls, "word").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    counts = write_table(counts, "counts")
    s = counts.drop("df").join(idf(counts, n_docs), "word").withColumn("raw", F.col("tf") * F.col("idf"))
    # a partial aggregate: one row a class, never a class's whole vocabulary in one task
    norm = s.groupBy(F.col(cls).alias("_cls")).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"))
    s = s.join(norm, F.col(cls).eqNullSafe(F.col("_cls")))
    return s.withColumn("score", F.col("raw") / F.col("_norm")).select(cls, "word", "score")


def top_words(scores: DataFrame, cls: str, order, k: int = 250) -> DataFrame:
    """O05 + J03: top-k words per class in ``order``, each class excluding the
    final lists of the classes before it; zero scores removed; ties by word.

    The top-k is the feature here (a ranked report), so the limit is kept.
    Class number i (0-based in ``order``) can lose at most i*k words to the
    exclusions, so its final list lies within its own top k*(i+1) words.  One
    skew-safe rank over all classes (``rank_within``: no class is sorted in
    one task) cuts each class to that many candidates; the dependent
    exclusion steps then run on at most k*len(order) rows per class.
    """
    order = list(order)
    depth = F.lit(0)
    for i, c in enumerate(order):
        depth = F.when(F.col(cls) == F.lit(c), F.lit(k * (i + 1))).otherwise(depth)
    cand = scores.where((F.col("score") > 0) & F.col(cls).isin(*order)).withColumn("_neg", -F.col("score"))
    cand = rank_within(cand, [cls], ["_neg", "word"], "_r0").where(F.col("_r0") <= depth).drop("_neg", "_r0")
    cand = write_table(cand, "candidates")  # read by each dependent step
    taken = None
    out = None
    for c in order:
        s = cand.where(F.col(cls) == F.lit(c))
        if taken is not None:
            s = s.join(taken, "word", "left_anti")
        # at most k * len(order) candidate rows per class: a bounded window
        w = Window.partitionBy(cls).orderBy(F.col("score").desc(), F.col("word"))
        top = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
        tw = top.select("word")
        taken = tw if taken is None else taken.unionByName(tw)
    return out


def discover_keywords(df: DataFrame, text: str = "text", sig: str = "sig", flag: str | None = None,
                      order_col: str | None = None, classes=(0, 1, 2), k: int = 250,
                      stop=None) -> DataFrame:
    """Declared + usable texts, dedupe on text (first in ``order_col``
    wins), cleaned stop-word-free tokens, class TF-IDF, ranked lists."""
    from . import dedupe as D
    from . import filters as FL

    x = df.where(FL.declared(flag, sig, (0, 1, 2))).where(FL.usable_text(text)).select(
        text, sig, *([order_col] if order_col else []))
    x = write_table(D.dedupe(x, [text], order_col), "texts")  # counted, then read for its words
    x = stage(x.withColumn("_doc", F.md5(F.col(text))), {"_tok": doc_tokens(F.col(text))})
    n_docs = x.agg(F.count(F.lit(1))).scalar()
    words = explode_words(x, "_doc", sig, "_tok", stop, first="_first")
    sc = class_tfidf(words, n_docs, "_doc", sig, first="_first")
    return top_words(sc, sig, classes, k).select(sig, "rank", "word", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------------------
# J02 / A31 / X11
# ---------------------------------------------------------------------------

def lexicon_join(df: DataFrame, clean: str, lex: Lexicon, carry) -> DataFrame:
    """(row, entry) pairs for every lexicon entry present in the row.

    The lexicon is a bounded parameter list, so it is matched inside each row
    (``matched_entries``) and only the matches are exploded: one pass, no
    per-keyword rescans, no join of all tokens against the word list.
    """
    carry = [carry] if isinstance(carry, str) else list(carry)
    return df.select(*carry, F.explode(matched_entries(F.col(clean), lex)).alias("entry"))


def lexicon_table(spark, lex: Lexicon) -> DataFrame:
    """The lexicon as (kw_no, keyword, entry) rows in the given order;
    duplicates of the original list keep their own positions."""
    from ..functions.lexicon import normalise_word

    rows = [(i, w, normalise_word(w, lex.style)) for i, w in enumerate(lex.words)]
    return spark.createDataFrame(rows, "kw_no int, keyword string, entry string")


def keyword_scores(df: DataFrame, lex: Lexicon, score_cols, clean: str = "_clean",
                   digits: int | None = None) -> DataFrame:
    """Mean of each score over rows matching each keyword; no match -> 0.
    One row per keyword of the original list, in order (duplicates repeat)."""
    spark = df.sparkSession
    pairs = lexicon_join(df, clean, lex, list(score_cols))
    # one row per lexicon entry after the partial aggregate
    # of exact sums, so that a mean doesn't depend on the order of rows
    means = pairs.groupBy("entry").agg(*[F.try_divide(money_sum(c), F.count(c).cast("double")).alias(c) for c in score_cols])
    kws = lexicon_table(spark, lex)
    out = kws.join(F.broadcast(means), "entry", "left")   # <= one row per lexicon entry (a parameter list)
    sel = []
    for c in score_cols:
        v = F.coalesce(F.col(c), F.lit(0.0))
        sel.append((F.round(v, digits) if digits is not None else v).alias(c))
    return out.select("kw_no", "keyword", *sel)


def score_vocabulary(df: DataFrame, lex: Lexicon, score_cols, markers=("climate_adaptation_sig",
                     "climate_mitigation_sig"), text: str = "text", match_lex: Lexicon | None = None,
                     digits: int | None = None) -> DataFrame:
    """X11: declared-positive rows (any marker in {1,2}) whose cleaned text
    matches the lexicon, then per-keyword mean scores."""
    from .._util import any_of

    x = stage(df, {"_clean": T.clean_text(F.col(text))})
    pos = any_of([F.coalesce(F.col(m).isin(1, 2), F.lit(False)) for m in markers])
    ml = match_lex or lex
    x = x.where(pos & ml.match(F.col("_clean")))
    return keyword_scores(x, lex, score_cols, "_clean", digits)
