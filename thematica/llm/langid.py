"""Language identification by Bayesian evidence fusion.

For each document the log posterior of a language is the sum of
  * the log likelihood of the text: byte trigrams under a multinomial model per
    language, divided down to ``GRAMS`` effective trigrams, as neighbouring
    trigrams aren't independent,
  * the log likelihood of the declared markup language given the language,
  * the log likelihood of the address suffix given the language,
  * the log prior of the host, smoothed towards its domain, which is smoothed
    towards the whole table.
The tables behind the last three come from grouped aggregations over all
documents of the language that the text alone favours; a document's own vote is
taken out of its host's and domain's counts.  One more class, ``und``, has all
trigrams equally likely: texts in none of the languages go there.

The trigram model is fitted, for every declared language with any text, on at
most ``rows`` of its documents (a documented bound: of each of ``SLICES`` slices
those with the smallest hash of their id); its table has ``BUCKETS`` numbers a
language.  A document is kept if a language other than ``und`` has a posterior
of ``MIN_POSTERIOR`` or more.

Defined results: null and empty texts, and texts of fewer than three bytes,
have no text evidence and are judged by the rest; with no text, no declared
language and no host evidence they are ``und`` and not kept; null hosts,
suffixes and declarations add nothing; repeated rows vote each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialise, pick, texts

BUCKETS = 1 << 16
LANGUAGES_HELD = 128  # languages whose counts a task holds at once
TRAIN_ROWS = 10_000  # of a language
SLICES = 50
GRAMS = 60
SMOOTH = 0.5
KAPPA = 20.0  # weight of the wider group, in documents
UNKNOWN_PRIOR = 1e-3
MIN_POSTERIOR = 0.5
UNKNOWN = "und"
TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;")


def grams(text: str | None, markup: bool = False) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased letters; other characters than
    letters are word breaks, so digits, marks and markup carry no evidence."""
    if not text:
        return np.zeros(0, np.int64)
    if markup:
        text = TAGS.sub(" ", text)
    a = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    a = np.where((a >= 128) | ((a >= 97) & (a <= 122)), a, 32).astype(np.uint32)
    a = a[np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]]
    if len(a) < 3:
        return np.zeros(0, np.int64)
    code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: tuple
    table: bytes  # float32, BUCKETS x (languages + und)

    def array(self) -> np.ndarray:
        return np.frombuffer(self.table, np.float32).reshape(BUCKETS, len(self.languages) + 1)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "lang", rows: int = TRAIN_ROWS) -> TextModel:
    """Trigram counts of a bounded sample of each language by grouped aggregation."""
    x = pick(docs, _id=doc_id, _lang=declared, _text=text).where("_id is not null and _lang is not null and length(_text) > 0")
    # in slices, so that a language that most documents have isn't one task
    x = x.select("_id", "_lang", F.xxhash64("_text").alias("_set")).groupBy("_id").agg(F.min(F.struct("_set", "_lang")).alias("_one"))
    x = x.select("_id", "_one._set", "_one._lang", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SLICES)).alias("_slice"))
    w = W.partitionBy("_lang", "_slice").orderBy(F.xxhash64("_id"), "_id")
    sample = (x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(1, rows // SLICES))
              .select(F.col("_id").alias("_i"), F.col("_set").alias("_s"), F.col("_lang").alias("_l")))
    x = pick(docs, _id=doc_id, _lang=declared, _text=text)
    x = x.join(sample, (F.col("_id") == F.col("_i")) & (F.col("_lang") == F.col("_l")) & (F.xxhash64("_text") == F.col("_s")))
    x = x.groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).select("_lang", "_text")  # rows that repeat an id count once

    def run(batches):
        total = {}

        def emit():
            for lang, c in total.items():
                at = np.flatnonzero(c)
                yield pa.record_batch({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at, pa.int32()),
                                       "n": pa.array(c[at], pa.int64())})
            total.clear()

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), texts(b, "_text")):
                if lang not in total and len(total) >= LANGUAGES_HELD:
                    yield from emit()
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(grams(t), minlength=BUCKETS)
        yield from emit()

    got = (x.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
           .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect())  # at most BUCKETS numbers a language
    got.sort(key=lambda r: r.lang)
    out = np.zeros((BUCKETS, len(got) + 1))
    for i, r in enumerate(got):
        for bucket, n in r.c:
            out[bucket, i] = n
    total = out.sum(0)
    out = np.log(out + SMOOTH) - np.log(total + SMOOTH * BUCKETS)
    out[:, -1] = -math.log(BUCKETS)
    return TextModel(tuple(r.lang for r in got), out.astype(np.float32).tobytes())


def evidence(df: DataFrame, model: TextModel, keep: dict, text: str, declared: Column, host: Column, suffix: Column,
             markup: bool = False) -> DataFrame:
    """``keep`` columns, the other evidence, the trigram count and the log
    likelihood of the text by language (und last)."""
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(model.table)  # BUCKETS * (languages + 1) * 4 bytes
    width = len(model.languages) + 1

    @F.pandas_udf("array<float>")
    def likelihood(t):
        m = np.frombuffer(table.value, np.float32).reshape(BUCKETS, width)
        out = []
        for x in t:
            g = grams(x, markup)
            part = np.zeros(width)
            for a in range(0, len(g), 1 << 16):  # bounds the memory of very long texts
                part += m[g[a:a + (1 << 16)]].sum(0, dtype=np.float64)
            out.append(np.r_[part, len(g)].astype(np.float32))
        return _series(out)

    x = df.select(*[F.col(f"`{c}`").alias(n) for n, c in keep.items()], declared.alias("declared"), host.alias("host"),
                  suffix.alias("suffix"), F.col(f"`{text}`").alias("_t"))
    x = x.withColumn("_ll", likelihood("_t")).drop("_t")
    return (x.withColumn("n_grams", F.element_at("_ll", width + 1).cast("long"))
            .withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
            .withColumn("ll", F.slice("_ll", 1, width)).drop("_ll"))


def _series(rows):
    import pandas as pd

    return pd.Series(rows, dtype=object)


def _votes(x: DataFrame, key: str, n: int) -> DataFrame:
    """Votes by group: (key, array of counts by language).  Partial sums first, so a hot group is no hot task."""
    sums = [F.sum(F.when(F.col("own") == i, 1).otherwise(0)) for i in range(n)]
    return (x.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}"))
            .agg(F.array(*sums).alias(f"v_{key}")))


def fuse(ev: DataFrame, languages: tuple, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Adds ``language``, ``posterior`` and ``kept`` to an evidence table."""
    n = len(languages)
    cols = [c for c in ev.columns if c not in ("ll", "domain")]
    if n == 0:
        return ev.select(*cols, F.lit(UNKNOWN).alias("language"), F.lit(1.0).alias("posterior"), F.lit(False).alias("kept"))
    ll = [F.col("ll")[i].cast("double") for i in range(n + 1)]
    top = F.greatest(*ll)
    own = F.when((F.col("n_grams") > 0) & (ll[n] < top), F.coalesce(*[F.when(v == top, i) for i, v in enumerate(ll[:n])]))
    x = materialise(ev.withColumn("own", own), "evidence")
    glob = x.agg(*[F.sum(F.when(F.col("own") == i, 1).otherwise(0)).alias(f"g{i}") for i in range(n)]).first()  # one row
    g = [(v or 0) + 1.0 for v in glob]
    share = [v / sum(g) for v in g]
    for key in ("host", "domain", "suffix", "declared"):
        x = x.join(_votes(x, key, n), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")

    def count(key, i, own_out):
        c = F.coalesce(F.col(f"v_{key}")[i], F.lit(0))
        return c - F.when(F.col("own").eqNullSafe(F.lit(i)) & F.col(f"v_{key}").isNotNull(), 1).otherwise(0) if own_out else c

    def smoothed(key, parent):
        total = sum((count(key, i, True) for i in range(n)), F.lit(0.0))
        return [(count(key, i, True) + KAPPA * parent[i]) / (total + KAPPA) for i in range(n)]

    prior = smoothed("host", smoothed("domain", [F.lit(s) for s in share]))
    score = []
    scale = F.lit(float(GRAMS)) / F.greatest(F.col("n_grams"), F.lit(GRAMS))
    for i in range(n + 1):
        s = F.col("ll")[i].cast("double") * scale
        if i < n:
            s = s + F.log(prior[i]) + math.log(1 - UNKNOWN_PRIOR)
            for key in ("suffix", "declared"):
                # P(value | language), smoothed towards the value's share among all votes
                total = sum((count(key, j, False) for j in range(n)), F.lit(0.0))
                among = (total + 1) / (float(sum(g)) + 1)
                p = (count(key, i, True) + KAPPA * among) / (g[i] + KAPPA)
                s = s + F.when(F.col(f"v_{key}").isNotNull(), F.log(p)).otherwise(0.0)
        else:
            s = s + math.log(UNKNOWN_PRIOR)
            for key in ("suffix", "declared"):
                total = sum((count(key, j, False) for j in range(n)), F.lit(0.0))
                s = s + F.when(F.col(f"v_{key}").isNotNull(), F.log((total + 1) / (float(sum(g)) + 1))).otherwise(0.0)
        score.append(s)
    x = x.withColumn("_s", F.array(*score))
    x = x.withColumn("_best", F.array_max("_s"))
    x = x.withColumn("_z", F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("_best"))))
    x = x.withColumn("_at", F.array_position("_s", F.col("_best")).cast("int"))
    nothing = (F.col("n_grams") == 0) & F.col("v_declared").isNull() & F.col("v_host").isNull() & F.col("v_suffix").isNull()
    names = F.array(*[F.lit(v) for v in (*languages, UNKNOWN)])
    language = F.when(nothing, UNKNOWN).otherwise(F.element_at(names, F.col("_at")))
    return (x.withColumn("language", language).withColumn("posterior", F.when(nothing, 1.0).otherwise(1 / F.col("_z")))
            .withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("posterior") >= min_posterior))
            .select(*cols, "language", "posterior", "kept"))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1)), F.lit(""))


def identify(documents: DataFrame | None, pages: DataFrame | None, model: TextModel) -> DataFrame:
    """Languages of documents (the source is the host, ``lang`` the declared
    language) and of pages (host and suffix from the address, declared language
    from the markup), fused over both tables: doc_id, page_id, declared, host,
    suffix, n_grams, language, posterior, kept."""
    parts = []
    none = F.lit(None).cast("string")
    if documents is not None:
        parts.append(evidence(documents, model, {"doc_id": "doc_id"}, "text", F.col("lang").cast("string"),
                              F.col("source").cast("string"), none))
    if pages is not None:
        host = host_of(F.col("url"))
        parts.append(evidence(pages, model, {"page_id": "page_id"}, "html", markup_language(F.col("html")), host,
                              F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")), markup=True))
    ev = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return fuse(ev, model.languages)


def filter_documents(docs: DataFrame, model: TextModel, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged.  Rows that
    repeat an id are kept if one of them is."""
    good = (identify(docs, None, model).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct())
    return docs.join(good, F.col(f"`{doc_id}`").eqNullSafe(F.col("_kept_id")), "left_semi")
