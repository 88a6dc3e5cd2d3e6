"""Scoring (C01-C03, C05, T12 use, A32, J01) and the prediction jobs X01-X03.

A *scorer* turns each record's chunk list (``array<array<string>>`` of word
tokens) into one confidence per label, already reduced over chunks with
``max`` (A32).  Three kinds:

* ``ExprScorer`` / ``LexiconHitScorer`` - the model is a SQL expression
  evaluated with higher-order functions over the chunk array: no explode, no
  shuffle, whole-stage codegen.
* ``PandasScorer`` - a user's own batch model (e.g. a transformer) run with
  ``mapInPandas``: Arrow batches in, the model is loaded once per Python
  worker, rows that do not need the model (screened theme, empty text) are
  never sent to it (C03).
* Fitted models: see ``training.fit_multilabel``.

Scoring is done on distinct key tuples only and joined back null-safely
(C02 + J01), as the reference does to save model calls.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col_of, stage
from ..session import workers_import, write_table
from ..functions import markers as M
from ..functions import text as T
from ..functions.lexicon import Lexicon
from .filters import principal_declared


class Scorer:
    group: str
    labels: tuple  # ((theme, level), ...)

    def apply(self, df: DataFrame, chunks: str, active: Column) -> DataFrame:
        """Add ``_raw_<theme>_<level>`` = max confidence over chunks (null if inactive)."""
        raise NotImplementedError


def raw_col(theme: str, level: str) -> str:
    return f"_raw_{theme}_{level}"


@dataclass
class ExprScorer(Scorer):
    """Confidence per label = sigmoid(logit(chunk)); ``logits`` maps a chunk
    token-array column to one logit Column per label."""

    group: str
    labels: tuple
    logits: Callable[[Column], list]

    def apply(self, df, chunks, active):
        upd = {}
        ch = F.col(chunks)
        for i, (theme, level) in enumerate(self.labels):
            conf = F.array_max(F.transform(ch, self._label_fn(i)))
            upd[raw_col(theme, level)] = F.when(active & (F.size(ch) > 0), conf)
        return df.withColumns(upd)

    def _label_fn(self, i):
        def f(c):
            return T.sigmoid(self.logits(c)[i])
        return f


@dataclass
class LexiconHitScorer(Scorer):
    """A transparent stand-in model: logit = slope * distinct hits - bias.

    Confidence is monotone in the hit count, so the chunk maximum is the
    sigmoid of the maximum hit count: one higher-order pass per group
    instead of one per label.
    """

    group: str
    labels: tuple
    lex: Lexicon
    biases: tuple
    slope: float = 1.0

    def apply(self, df, chunks, active):
        ch = F.col(chunks)
        mh = F.array_max(F.transform(ch, lambda c: self.lex.hits(c)))
        x = df.withColumn("_max_hits", F.when(active & (F.size(ch) > 0), mh))
        upd = {raw_col(t, lv): T.sigmoid(F.col("_max_hits") * F.lit(self.slope) - F.lit(b))
               for (t, lv), b in zip(self.labels, self.biases)}
        return x.withColumns(upd).drop("_max_hits")


def lexicon_hit_scorer(group: str, lex: Lexicon, sig_bias: float = 0.5, pri_bias: float = 1.5,
                       slope: float = 1.0) -> LexiconHitScorer:
    labels = tuple(M.group_labels(group))
    biases = tuple(sig_bias if lv == "sig" else pri_bias for (_, lv) in labels)
    return LexiconHitScorer(group, labels, lex, biases, slope)


_MODELS: dict = {}  # models of this Python worker


@dataclass
class PandasScorer(Scorer):
    """A user model applied to chunk texts in Arrow batches.

    ``load()`` returns a model object, called once in each Python worker;
    ``predict(model, texts: list[str]) -> array (n, len(labels))`` returns
    confidences in label order.  Only the chunks of active rows go to Python;
    the other columns stay where they are.  A worker keeps a model under the
    scorer's group, name and labels, so scorers of several themes can load
    different models under one name.
    """

    group: str
    labels: tuple
    load: Callable[[], object]
    predict: Callable[[object, list], object]
    name: str = "model"

    def apply(self, df, chunks, active):
        labels, load, predict = self.labels, self.load, self.predict
        key = (self.group, self.name, tuple(labels))

        @F.pandas_udf("array<double>")
        def confidences(chunk_lists: pd.Series) -> pd.Series:
            import numpy as np

            from thematica.operators import scoring  # the worker's own module: its models outlive the task

            rows, texts = [], []
            for i, chs in enumerate(chunk_lists):
                for c in chs if chs is not None else ():
                    rows.append(i)
                    texts.append(" ".join(c))
            out = pd.Series([None] * len(chunk_lists), dtype=object)
            if texts:
                if key not in scoring._MODELS:
                    scoring._MODELS[key] = load()
                conf = np.asarray(predict(scoring._MODELS[key], texts), dtype="float64")
                best = pd.DataFrame(conf).groupby(np.asarray(rows)).max()
                for i, row in zip(best.index, best.to_numpy()):
                    out[i] = row
            return out

        workers_import(df.sparkSession)
        ch = F.col(chunks)
        x = df.withColumn("_conf", confidences(F.when(active & (F.size(ch) > 0), ch)))
        return x.withColumns({raw_col(t, lv): F.col("_conf")[j] for j, (t, lv) in enumerate(labels)}).drop("_conf")


def score_text(df: DataFrame, scorers: dict, lexicons: dict, *, text_col: str = "_text",
               screened_aware: bool = True, max_tokens: int = 512, themes=None,
               round_digits: int | None = None) -> DataFrame:
    """C01+C03+A32 on rows that already carry a raw text column ``text_col``.

    Adds the prediction columns (P15 seeds, keyword matches, chunk-max
    confidences, OR-ed decisions).  ``screened_aware`` seeds from markers and
    skips screened themes (X01); otherwise seeds are FALSE/0 and every theme
    is scored (X02/X03).
    """
    themes = themes or [t.key for t in M.THEMES]
    groups = [g for g in M.GROUPS if any(M.THEME[t].group == g for t in themes)]
    clean = "_clean"
    # staged: the cleaned text and its tokens are computed once per row (an
    # expression used inside a lambda would run once per chunk otherwise)
    df = stage(df, {clean: T.clean_text(F.col(text_col))})
    df = stage(df, {"_tok": F.split(F.col(clean), " ")})
    kw = {M.kw_col(g): lexicons[g].match(F.col(clean), F.coalesce(F.col("_tok"), F.array().cast("array<string>")))
          for g in groups if g in lexicons}
    df = df.withColumns(kw)
    df = df.withColumn("_chunks", T.chunk_tokens(F.col("_tok"), max_tokens))
    for g in groups:
        active = F.col(clean).isNotNull()
        if screened_aware:
            active = active & ~M.screened(g)
        df = scorers[g].apply(df, "_chunks", active)
    upd = {}
    for t in themes:
        for lv in M.LEVELS:
            raw = F.col(raw_col(t, lv))
            if round_digits is not None:
                raw = F.round(raw, round_digits)
            sp = M.seed_pred(t, lv) if screened_aware else F.lit(False)
            sc = M.seed_conf(t, lv) if screened_aware else F.lit(0.0)
            upd[M.pred_col(t, lv)] = sp | F.coalesce(raw > 0.5, F.lit(False))
            upd[M.conf_col(t, lv)] = F.greatest(sc, raw)
    df = df.withColumns(upd)
    drop = [clean, "_tok", "_chunks"] + [raw_col(t, lv) for t in themes for lv in M.LEVELS]
    return df.drop(*[c for c in drop if c in df.columns])


#: heavy keys looked for, and counters of the sketch that finds them
HEAVY = 64
TRACKED = 4096


def heavy_keys(rows: DataFrame, keys, tasks: int | None = None) -> list[int]:
    """Hashes of the keys that hold more rows than half a task's fair share, at most ``HEAVY``.

    One pass with a frequent-items sketch of ``TRACKED`` counters a task: no shuffle of keys, and
    no count of the keys that are rare."""
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.select(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("h"))
    got = x.agg(F.expr(f"approx_top_k(h, {HEAVY}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).head()
    return sorted(t["item"] for t in got["top"] or () if t["count"] * 2 * tasks > got["n"])


def replicate_heavy(scored: DataFrame, keys, heavy: list[int], salt: int, out: str = "_salt") -> DataFrame:
    """The heavy keys' rows once for each salt, all others once with salt 0."""
    if not heavy:
        return scored.withColumn(out, F.lit(0))
    hot = F.xxhash64(*[F.col(f"`{k}`") for k in keys]).isin(*heavy)
    return scored.withColumn(out, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))))


def join_back(rows: DataFrame, scored: DataFrame, keys, salt: int = 1) -> DataFrame:
    """Left join of per-key results onto all rows, nulls equal.

    ``eqNullSafe`` keys still plan as a hash/sort-merge equi-join.  AQE's
    skew-join split is the default remedy for a hot key.  Where AQE is off, ``salt`` > 1 looks for
    heavy keys first (``heavy_keys``) and deals the rows of those over ``salt`` tasks: only their
    results are replicated, a cold key's result is never copied.
    """
    keys = list(keys)
    cond_salt = []
    r = scored
    if salt > 1:
        heavy = heavy_keys(rows, keys)
        r = replicate_heavy(r, keys, heavy, salt, "_k_salt")
        # rows that equal each other in all columns are dealt by the task they come from
        dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.spark_partition_id()), F.lit(salt)).cast("int")
        hot = F.xxhash64(*[F.col(f"`{k}`") for k in keys]).isin(*heavy) if heavy else F.lit(False)
        rows = rows.withColumn("_salt", F.when(hot, dealt).otherwise(0))
        cond_salt = [rows["_salt"] == r["_k_salt"]]
    for k in keys:
        r = r.withColumnRenamed(k, f"_k_{k}")
    out = rows.join(r, [rows[k].eqNullSafe(r[f"_k_{k}"]) for k in keys] + cond_salt, "left")
    return out.drop(*[f"_k_{k}" for k in keys], "_salt", "_k_salt")


class ScoreStore:
    """C02 between runs: scores kept by the hash of what was scored.

    ``path`` is a folder that all runs share; ``model`` names the scorers and their version, so scores of
    another model are never reused.  A run scores only the keys that aren't there (anti-join on the hash) and appends
    them; Parquet's commit makes an aborted run leave nothing.  Runs that append the same keys at once store
    them twice, and one row a hash is read."""

    def __init__(self, path: str, model: str):
        self.path = f"{path.rstrip('/')}/model={hashlib.sha256(model.encode()).hexdigest()[:32]}"

    def _known(self, spark) -> DataFrame | None:
        try:
            return spark.read.parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def scored(self, distinct: DataFrame, keys, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``score(distinct)``, of which only the rows unknown so far are scored now."""
        spark = distinct.sparkSession
        own = F.sha2(F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}), 256)
        x = write_table(distinct.withColumn("_hash", own), "to_score")
        known = self._known(spark)
        new = x if known is None else x.join(known.select("_hash"), "_hash", "left_anti")
        given = set(distinct.columns)
        fresh = score(new.drop("_hash")).withColumn("_hash", own)
        fresh.select("_hash", *[c for c in fresh.columns if c not in given and c != "_hash"]).write.mode("append").parquet(self.path)
        kept = spark.read.parquet(self.path).dropDuplicates(["_hash"])
        return x.join(kept, "_hash").drop("_hash")


def _wants_dedupe(scorers, dedupe):
    return True if dedupe is None else dedupe


def predict_activities(df: DataFrame, scorers: dict, lexicons: dict, text_cols=(
        "project_title", "short_description", "long_description"), *, strict_partition: bool = False,
        max_tokens: int = 512, salt: int = 1, round_digits: int | None = None,
        dedupe: bool | None = None, key_source: DataFrame | None = None) -> DataFrame:
    """Activity prediction.

    Screened rows (every theme's marker in {0,1,2}) keep null predictions
    (N11); the others are scored.  ``strict_partition`` reproduces the
    reference dropping rows with out-of-domain markers (N12).

    Two physical strategies with the same result:

    * ``dedupe=True`` (default): score each distinct
      (text columns + markers) tuple once and join back null-safely (C02+J01).
      Worth a shuffle when a model call costs far more than moving the row.
      The screened test is a function of the key columns, so one left join
      over all rows leaves screened rows unmatched - no union pass.
    * ``dedupe=False``: score inline, a narrow projection - no shuffle, no
      second pass over the input; pays off only when texts rarely repeat and
      the scorer is cheap (measured: 2x slower on the flows view, where
      600k rows share ~2k distinct keys).

    ``key_source`` (dedupe path): a cheaper frame holding every key tuple of
    ``df`` (a superset is fine - unmatched keys are never joined), e.g. the
    one table the text and marker columns come from, so the distinct branch
    does not recompute an expensive join that produced ``df``.
    """
    text_cols = [c for c in text_cols if c in df.columns]
    keys = text_cols + list(M.MARKERS)
    needs = ~M.all_screened()
    if strict_partition:
        df = df.where(M.all_screened() | M.unscreened_strict())
        needs = M.unscreened_strict()
    if not _wants_dedupe(scorers, dedupe):
        x = df.withColumn("_text", T.build_text(text_cols))
        x = score_text(x, scorers, lexicons, max_tokens=max_tokens, round_digits=round_digits).drop("_text")
        pcols = M.prediction_columns()
        return x.withColumns({c: F.when(needs, F.col(c)) for c in pcols if c in x.columns})
    src = df if key_source is None else key_source
    distinct = src.where(needs).select(*keys).dropDuplicates(keys)
    distinct = distinct.withColumn("_text", T.build_text(text_cols))
    scored = score_text(distinct, scorers, lexicons, max_tokens=max_tokens,
                        round_digits=round_digits).drop("_text")
    return join_back(df, scored, keys, salt=salt)


def rescore_declared(df: DataFrame, scorer: Scorer, lexicon: Lexicon, text_cols=(
        "project_title", "short_description", "long_description"), *, max_tokens: int = 512,
        round_digits: int | None = None) -> DataFrame:
    """Climate re-scoring of rows declared principal on either climate marker."""
    text_cols = [c for c in text_cols if c in df.columns]
    sl = df.where(principal_declared())
    distinct = sl.select(*text_cols).dropDuplicates(text_cols).withColumn("_text", T.build_text(text_cols))
    scored = score_text(distinct, {"climate": scorer}, {"climate": lexicon}, screened_aware=False,
                        max_tokens=max_tokens, themes=["adaptation", "mitigation"],
                        round_digits=round_digits).drop("_text")
    return join_back(sl, scored, text_cols)


def predict_budget(df: DataFrame, scorers: dict, lexicons: dict, text_col: str = "text", *,
                   max_tokens: int = 512, round_digits: int | None = None, store: ScoreStore | None = None) -> DataFrame:
    """Budget lines have no markers; every theme is scored, null text = ''.
    With a ``store`` only texts that no earlier run has scored are scored."""
    distinct = df.select(text_col).dropDuplicates([text_col])

    def score(x):
        x = x.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
        return score_text(x, scorers, lexicons, screened_aware=False, max_tokens=max_tokens, round_digits=round_digits).drop("_text")

    return join_back(df, store.scored(distinct, [text_col], score) if store else score(distinct), [text_col])


def reduce_chunks(chunk_scores: DataFrame, key, labels) -> DataFrame:
    """A32 for an exploded chunk table: OR of decisions, max of confidences."""
    keys = [key] if isinstance(key, str) else list(key)
    aggs = []
    for (t, lv) in labels:
        aggs += [F.bool_or(F.col(M.pred_col(t, lv))).alias(M.pred_col(t, lv)),
                 F.max(F.col(M.conf_col(t, lv))).alias(M.conf_col(t, lv))]
    return chunk_scores.groupBy(*keys).agg(*aggs)


def explode_chunks(df: DataFrame, clean_col: str, max_tokens: int = 512) -> DataFrame:
    """T12 as rows: one row per (record, chunk index, chunk text)."""
    x = stage(df, {"_tok": F.split(col_of(clean_col), " ")})
    ch = T.chunk_tokens(F.col("_tok"), max_tokens)
    return x.select("*", F.posexplode(ch).alias("chunk_no", "_chunk_tokens")).withColumn(
        "chunk_text", F.array_join("_chunk_tokens", " ")).drop("_chunk_tokens", "_tok")


def compare_scorers(df: DataFrame, a: Scorer, b: Scorer, text_col: str, max_tokens: int = 512) -> DataFrame:
    """Two scorers of the same group on the same rows, with differences."""
    x = stage(df, {"_clean": T.clean_text(F.col(text_col))})
    x = stage(x, {"_tok": F.split(F.col("_clean"), " ")})
    x = stage(x, {"_chunks": T.chunk_tokens(F.col("_tok"), max_tokens)})
    on = F.col("_clean").isNotNull()
    x = a.apply(x, "_chunks", on)
    ren = {raw_col(t, lv): f"a_{t}_{lv}" for (t, lv) in a.labels}
    x = x.withColumnsRenamed(ren)
    x = b.apply(x, "_chunks", on)
    ren = {raw_col(t, lv): f"b_{t}_{lv}" for (t, lv) in b.labels}
    x = x.withColumnsRenamed(ren)
    diffs = {f"diff_{t}_{lv}": F.col(f"b_{t}_{lv}") - F.col(f"a_{t}_{lv}") for (t, lv) in a.labels}
    return x.withColumns(diffs).drop("_chunks", "_tok", "_clean")
