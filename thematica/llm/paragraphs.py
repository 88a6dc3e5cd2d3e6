"""Repeated paragraphs across documents: MinHash banding and exact verification.

A paragraph is a line of ``MIN_WORDS`` words or more.  Its 5-word shingles give
``BANDS`` band keys of ``ROWS`` minhashes; bands are many and short, so that a
pair of similarity 0.8 shares one with probability 0.9997 (1 - (1 - s^ROWS)^BANDS).
Paragraphs of equal shingle sets are one class; colliding classes are joined,
their exact Jaccard similarity is taken on the full sets, and similar ones are
clustered by connected components.  Of each cluster the first paragraph, in
order of document and place, stays; the others are removed from their texts.

A paragraph is named by one number, doc_id * 2^21 + place: ids from -2^42 to
2^42 and 2^21 lines a document, which is checked.

Defined results: null and empty texts have no paragraphs and stay as they are;
rows without an id are left alone; rows that repeat an id are one document, its
paragraphs judged by number; a paragraph repeated within one document is removed
too; lines of fewer words are never touched; an empty table gives an empty
result; all other columns are unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .near_dedup import PERCENT, link_rows, sharing
from .shared import WordHasher, materialise, mix64, parted, pick, seeds, signed, texts

K = 5
MIN_WORDS = 30
BANDS = 8
ROWS = 2
PLACE_BITS = 21
WORDS_HELD = 300_000  # words whose paragraphs a task handles at once


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys (paragraphs x bands) of shingle sets laid end to end: set i is
    ``hashes[starts[i]:starts[i + 1]]``, none empty."""
    mixed = hashes ^ (hashes >> np.uint64(31))
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(starts), 1))
    for i, m in enumerate(seeds(bands * rows, 11)):
        least = np.minimum.reduceat(mixed * m, starts)
        out[:, i // rows] = mix64(out[:, i // rows] * np.uint64(31) + least)
    return out


def shingle_sets(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of many paragraphs at once: hashes laid end to end,
    and where each paragraph's begin.  ``words`` are the paragraphs' word hashes,
    ``sizes`` (each k or more) how many each has.  As ``shared.shingles``."""
    ends = np.cumsum(sizes)
    n = len(words) - k + 1
    mult = seeds(k, 77)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += mix64(words[j:n + j] + np.uint64(j + 1)) * mult[j]
    h = mix64(h + np.uint64(k))
    own = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + k <= ends[own]  # the shingle doesn't run into the next paragraph
    h, own = h[inside], own[inside]
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
    h, own = h[first], own[first]
    return h, np.searchsorted(own, np.arange(len(sizes)))


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, k: int = K,
               bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, place, n_shingles, set_a, set_b, keys) of every paragraph."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
                        ("set_b", pa.int64()), ("keys", pa.list_(pa.int64()))])
    least = max(min_words, k)

    def batch(ids, places, words):
        sizes = np.array([len(w) for w in words])
        h, starts = shingle_sets(np.concatenate(words), sizes, k)
        sums = [np.add.reduceat(x, starts) for x in (h, mix64(h + np.uint64(9)))]
        keys = signed(np.ascontiguousarray(band_keys(h, starts, bands, rows)).reshape(-1))
        offsets = np.arange(0, len(keys) + 1, bands, dtype=np.int32)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(np.diff(np.r_[starts, len(h)])),
                                *[pa.array(signed(x)) for x in sums], pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))], schema=schema)

    def run(batches):
        hasher = WordHasher()
        ids, places, words, size = [], [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts(b, "_text")):
                for place, line in enumerate((t or "").split("\n")):
                    w = hasher.words(line)
                    if len(w) >= least:
                        ids.append(i)
                        places.append(place)
                        words.append(hasher.hash_words(w))
                        size += len(w)
                if size > WORDS_HELD:
                    yield batch(ids, places, words)
                    ids, places, words, size = [], [], [], 0
        if ids:
            yield batch(ids, places, words)

    x = pick(df, _id=doc_id, _text=text).withColumn("_id", F.col("_id").cast("long")).where("_id is not null")
    return x.mapInArrow(run, "doc_id long, place long, n_shingles long, set_a long, set_b long, keys array<long>")


def _name(doc_id: Column, place: Column) -> Column:
    n = F.shiftleft(doc_id, PLACE_BITS) + place
    fits = (F.shiftright(n, PLACE_BITS) == doc_id) & (place < (1 << PLACE_BITS))
    return F.when(fits, n).otherwise(F.raise_error(F.lit("a document id or line number is too large")).cast("long"))


def repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, k: int = K,
             bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, place, first_doc, first_place) of every paragraph to remove, and
    the paragraph that stays for its cluster."""
    sig = materialise(signatures(df, doc_id, text, min_words, k, bands, rows)
                      .withColumn("id", _name(F.col("doc_id"), F.col("place"))), "signatures")
    reps = materialise(sig.groupBy("set_a", "set_b", "n_shingles")
                       .agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "classes")
    keyed = F.transform("keys", lambda key, i: F.xxhash64(key, i))
    table = materialise(sharing(reps, keyed), "bands")
    docs = pick(df, _id=doc_id, _text=text).withColumn("_id", F.col("_id").cast("long"))
    lines = (docs.where("_id is not null").select("_id", F.posexplode(F.split("_text", "\n")).alias("place", "text"))
             .where(F.length("text") >= 2 * max(min_words, k) - 1)  # shorter ones have fewer words
             .select("_id", "place", (F.shiftleft("_id", PLACE_BITS) + F.col("place")).alias("id"), "text")
             .where((F.shiftright("id", PLACE_BITS) == F.col("_id")) & (F.col("place") < (1 << PLACE_BITS))).select("id", "text"))
    links = link_rows(table, lines, k, percent)
    same = (sig.join(reps.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.col("n_shingles").alias("_n"), "rep"),
                     (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")) & (F.col("n_shingles") == F.col("_n")))
            .where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    same = materialise(same.distinct(), "same")
    # Copies go where the first of their class goes; they are no vertices, but for those of repeated ids, which may stand in several classes.
    twice = docs.groupBy(F.col("_id").alias("_doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_doc")
    ties = same.join(twice, F.shiftright("u", PLACE_BITS) == F.col("_doc"), "left_semi")
    parts = connected_components(links.union(ties))
    copies = (same.join(parts, F.col("v") == F.col("id"), "left")
              .select(F.col("u").alias("id"), F.coalesce("component", "v").alias("component")))
    gone = parts.union(copies).distinct()
    mask = (1 << PLACE_BITS) - 1
    return gone.select(F.shiftright("id", PLACE_BITS).alias("doc_id"), F.col("id").bitwiseAND(F.lit(mask).cast("long")).cast("int").alias("place"),
                       F.shiftright("component", PLACE_BITS).alias("first_doc"),
                       F.col("component").bitwiseAND(F.lit(mask).cast("long")).cast("int").alias("first_place"))


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, places: pd.Series) -> pd.Series:
    def cut(t, p):
        if t is None or p is None:
            return t
        drop = set(p)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
    return pd.Series([cut(t, p) for t, p in zip(text, places)], dtype=object)


def remove_repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None, **kw) -> DataFrame:
    """``df`` with repeated paragraphs cut out of its texts; with ``removed`` a
    column of that name lists the numbers of the lines cut."""
    gone = materialise(repeated(df, doc_id, text, **kw).groupBy(F.col("doc_id").alias("_gone_doc"))
                       .agg(F.sort_array(F.collect_list("place")).alias("_gone")), "gone")  # at most the lines of one document
    stay, go = parted(df, doc_id, gone, "_gone_doc")
    new = F.when(F.col("_gone").isNull(), F.col(f"`{text}`")).otherwise(_without(F.col(f"`{text}`"), F.col("_gone")))
    out = [new.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    if removed:
        none = F.array().cast("array<int>")
        stay = stay.select(*[F.col(f"`{c}`") for c in df.columns], none.alias(removed))
        out.append(F.coalesce("_gone", none).alias(removed))
    return stay.union(go.select(*out))
