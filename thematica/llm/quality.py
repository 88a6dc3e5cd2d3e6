"""Quality scores learnt from preferences (Bradley-Terry).

A document's strength is w . x(text).  For a pair of labelled documents, one
good and one bad, the chance that the good one wins is the logistic function of
the difference of their strengths; w minimises the logistic loss of such pairs'
feature differences with a ridge term.  The cut is a quantile of the training
strengths: the share of documents to turn away that separates the two labels
best.  The score is the logistic function of the strength, shifted so that the
cut lies at ``CUT_SCORE``.

The fit uses at most ``rows`` labelled rows (a documented bound: those with the
smallest hash of their id); only their feature vectors, a few MB, go to the
driver.  Every text is scored, whole, in one pass without a shuffle.

Defined results: null and empty texts have the feature vector of an empty text
and get its score; null ids are scored like others; repeated rows score alike;
labels other than 0 and 1 are not learnt from; with no usable pair w is zero and
every score is ``CUT_SCORE``; other columns don't take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WordHasher, pick

TRAIN_ROWS = 20_000
PAIRS = 200_000
RIDGE = 1e-3
CUT_SCORE = 0.3
SYMBOLS = b"#*$%&|<>"
FEATURES = ("length", "symbols", "upper", "digits", "marks", "word_length", "short_words", "long_words", "distinct", "again",
            "repeated_pairs", "top_word", "line_words", "repeated_lines", "bars", "shouts", "tails", "accents")


def features(text: str | None, hasher: WordHasher) -> list[float]:
    """One document's features, each of bounded size and free of its language."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = hasher.words(text)
    n = len(words)
    if n == 0:
        return [0.0] * len(FEATURES)
    h = hasher.hash_words(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, int(count[33:].sum()))
    sizes = np.fromiter(map(len, words), np.int32, n)
    _, per_word = np.unique(h, return_counts=True)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    of = lambda s: float(count[list(s)].sum())
    return [
        float(np.log1p(n)),
        of(SYMBOLS) / chars,
        float(count[65:91].sum()) / chars,
        float(count[48:58].sum()) / chars,
        of(b".,;:") / n,
        float(min(40, sizes.mean())),
        float((sizes <= 3).mean()),
        float((sizes >= 12).mean()),
        len(per_word) / n,
        float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0.0,
        float(per_word.max()) / n,
        float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        float(count[124]) / n,
        float(count[33]) / n,
        of(b"#*$%&") / n,
        float(count[128:].sum()) / chars,
    ]


@dataclass(frozen=True)
class Model:
    mean: tuple
    scale: tuple
    weights: tuple
    cut: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8)
        return z @ np.array(self.weights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = np.clip(self.strengths(x) - self.cut, -30, 30) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-s))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, steps: int = 40) -> Model:
    """Bradley-Terry fit: Newton's method on the logistic loss of differences."""
    k = x.shape[1] if len(x) else len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(7)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(k)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance of the wrong order
        grad = ridge * w - d.T @ p / pairs
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    # the quantile that separates the labels best; of equally good ones a low one, which keeps more
    edges = np.quantile(s, np.linspace(0, 1, 1001))
    gain = [((s[good] >= c).mean() + (s[bad] < c).mean()) for c in edges]
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-12)
    return Model(tuple(mean), tuple(scale), tuple(w), float(0.75 * edges[best[0]] + 0.25 * edges[best[-1]]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAIN_ROWS) -> Model:
    """Fits on labelled rows that are not held out, ``rows`` at most."""
    lab = pick(labels, _id=doc_id, _y=label).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    sample = F.broadcast(lab.orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows))  # at most ``rows`` pairs of numbers
    x = pick(docs, _id=doc_id, _text=text).join(sample, "_id")

    def vectors(batches):
        hasher = WordHasher()
        for b in batches:
            yield pd.DataFrame({"id": b["_id"], "y": b["_y"], "x": [features(t, hasher) for t in b["_text"]]})

    got = x.mapInPandas(vectors, "id long, y int, x array<double>").collect()  # bounded by ``rows``
    got.sort(key=lambda r: (r.id, r.y, r.x))
    return fit_pairs(np.array([r.x for r in got]), np.array([r.y for r in got]))


def scorer(model: Model):
    """The model as a column function of the text."""

    @F.pandas_udf("double")
    def score(it: pd.Series) -> pd.Series:
        hasher = score_state.setdefault("hasher", WordHasher())
        x = np.array([features(t, hasher) for t in it]).reshape(-1, len(FEATURES))
        return pd.Series(model.scores(x))

    score_state: dict = {}
    return score


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    x = pick(docs, doc_id=doc_id, _text=text).withColumn("score", scorer(model)(F.col("_text")))
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns unchanged."""
    model = train(docs, labels, doc_id, text)
    return docs.where(scorer(model)(F.col(f"`{text}`")) >= CUT_SCORE)
