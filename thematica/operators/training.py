"""Training-set preparation and evaluation (O04, O06, W06, P17, P20, P23,
A17, A28-A30, C04, X12-X14).

Shuffles are seeded md5 orders (reproducible in SQL); per-class counts and
allocations are exact and found by counting hashes, not by ranking rows
(``selection.first_of_each``).  Training is one joint fit: an iteration is one
pass and one aggregate for all labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._util import col_of
from ..functions import markers as M
from ..functions import text as T
from . import dedupe as D
from . import filters as FL
from ..session import workers_import, write_table
from .ranking import hash_order
from .selection import first_of_each


def sample_n(df: DataFrame, n: int, seed, key_cols) -> DataFrame:
    """N rows in a seeded pseudo-random order, chosen without sorting the
    table (``selection.first_of_each``); no task or driver holds n rows."""
    x = df.withColumn("_h", hash_order(seed, *key_cols))
    wanted = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("k"))
    return first_of_each(x, "_h", key_cols, wanted, out="_c").where("_c").drop("_h", "_c")


def downsample(df: DataFrame, label: str, negative=0, seed=42, key_cols=("text",)) -> DataFrame:
    """Keep all positives and as many negatives as positives (at most all
    negatives, D17), negatives chosen in a seeded hash order."""
    neg = df.where(F.col(label) == negative).withColumn("_h", hash_order(seed, *key_cols))
    pos = df.where(F.col(label) != negative)
    n_pos = pos.agg(F.count(F.lit(1)).alias("k"))
    keep = first_of_each(neg, "_h", key_cols, n_pos, out="_c").where("_c").drop("_h", "_c")
    return keep.unionByName(pos)


def encode_class(df: DataFrame, col: str, out: str = "class_id") -> DataFrame:
    """P20: dense ids of the sorted distinct labels (0-based).  The id table
    has one row per label (small) and is joined back."""
    ids = df.select(col).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(col)) - 1)
    # one row per distinct label; no broadcast hint - the label count is data,
    # so AQE broadcasts it only when its measured size is small
    return df.join(ids, col, "left")


def stratified_split(df: DataFrame, label: str, test: float = 0.2, seed=42, key_cols=("text",),
                     out: str = "split") -> DataFrame:
    """Per stratum, the first bround(test * n) rows in a seeded hash
    order go to 'test', the rest to 'train' (exact counts; D19)."""
    x = df.withColumn("_h", hash_order(seed, *key_cols))
    x = first_of_each(x, "_h", key_cols, lambda n: F.bround(F.lit(test) * n, 0), label, "_c")
    return x.withColumn(out, F.when(F.col("_c"), F.lit("test")).otherwise(F.lit("train"))).drop("_h", "_c")


def label_counts(df: DataFrame, col: str) -> DataFrame:
    """Label counter."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, labels: str = "labels") -> DataFrame:
    """negative/positive count per label position, one pass."""
    x = df.select(F.posexplode(F.col(labels)).alias("label_idx", "v"))
    return x.groupBy("label_idx").agg(
        F.try_divide(F.sum(F.when(F.col("v") == 0.0, 1).otherwise(0)).cast("double"),
                     F.sum(F.when(F.col("v") == 1.0, 1).otherwise(0)).cast("double")).alias("weight"))


def _binary_metrics(tp, fp, fn, tn):
    n = tp + fp + fn + tn
    prec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return [F.try_divide((tp + tn).cast("double"), n.cast("double")).alias("accuracy"),
            f1.alias("f1"), prec.alias("precision"), rec.alias("recall")]


def metrics_per_class(df: DataFrame, preds: str = "predictions", labels: str = "labels",
                      threshold: float = 0.5) -> DataFrame:
    """Accuracy, F1, precision, recall per class (decision: > threshold)."""
    x = df.select(F.posexplode(F.arrays_zip(F.col(preds).alias("p"), F.col(labels).alias("y"))).alias(
        "class_idx", "z"))
    p = (F.col("z.p") > threshold).cast("int")
    y = F.col("z.y").cast("int")
    g = x.groupBy("class_idx").agg(
        F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"),
        F.sum((1 - p) * y).alias("fn"), F.sum((1 - p) * (1 - y)).alias("tn"))
    return g.select("class_idx", *_binary_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def metrics_flat(df: DataFrame, preds: str = "predictions", labels: str = "labels",
                 threshold: float = 0.5, logits: bool = False) -> DataFrame:
    """The same metrics over the flattened label matrix (micro)."""
    x = df.select(F.explode(F.arrays_zip(F.col(preds).alias("p"), F.col(labels).alias("y"))).alias("z"))
    score = T.sigmoid(F.col("z.p")) if logits else F.col("z.p")
    p = (score > threshold).cast("int")
    y = F.col("z.y").cast("int")
    g = x.agg(F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"),
              F.sum((1 - p) * y).alias("fn"), F.sum((1 - p) * (1 - y)).alias("tn"))
    return g.select(*_binary_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def unpack_classes(df: DataFrame, names, preds: str = "predictions", labels: str = "labels") -> DataFrame:
    """Wide ``Predicted X`` / ``Label X`` columns from the arrays."""
    cols = {}
    for i, nm in enumerate(names):
        cols[f"Predicted {nm}"] = F.element_at(F.col(preds), i + 1)
        cols[f"Label {nm}"] = F.element_at(F.col(labels), i + 1)
    return df.withColumns(cols)


# ---------------------------------------------------------------------------
# X12 / X13 / X14
# ---------------------------------------------------------------------------

def prepare_training(df: DataFrame, sig: str, text: str = "text", flag: str | None = None,
                     order_col: str | None = None, seed=42, test: float = 0.2, ordinal: bool = False,
                     balance: bool = True) -> DataFrame:
    """Declared -> usable -> dedupe -> balance negatives -> stratified
    split -> multi-hot labels (significant, principal)."""
    x = df.where(FL.declared(flag, sig, (0, 1, 2))).where(FL.usable_text(text))
    x = x.select(text, sig, *([order_col] if order_col else []))
    x = write_table(D.dedupe(x, [text], order_col), "texts")  # counted, ranked and split below
    if balance:
        x = downsample(x, sig, 0, seed, (text,))
    x = stratified_split(x, sig, test, seed, (text,))
    return x.withColumn("labels", M.multi_hot(F.col(sig), (1, 2), ordinal)).select(text, sig, "split", "labels")


def publish_curated(df: DataFrame, label="label", text: str = "text", remove: str | None = "Remove",
                    seed=1337, test: float = 0.2, path: str | None = None) -> DataFrame:
    """Drop rows marked for removal, keep text and label(s), class-encode,
    stratified split, optionally write partitioned by split.  Several labels
    (climate: adaptation and mitigation) are stratified by their combination
    (P19)."""
    labels = [label] if isinstance(label, str) else list(label)
    x = df.where(FL.removal_not_flagged(remove)) if remove and remove in df.columns else df
    x = write_table(x.select(text, *labels), "curated")
    stratum = "_stratum"
    x = encode_class(x.withColumn(stratum, M.concat_label(*labels)), stratum, "class_label")
    x = stratified_split(x, "class_label", test, seed, (text,)).drop("class_label", stratum)
    if path is not None:
        from ..sources.io import write_split
        write_split(x, path)
    return x


#: buckets of the hashed vocabulary: with the labels it bounds a model's size
FEATURES = 1 << 16
#: words whose rows a task handles at once
HELD_WORDS = 1 << 18


def hashed_words(text, num_features: int = FEATURES) -> Column:
    """The bucket of each word of the cleaned text, repeats included: md5 modulo ``num_features``
    (the same in Spark and DuckDB)."""
    tok = F.coalesce(T.tokens(T.clean_text(col_of(text))), F.array().cast("array<string>"))
    words = F.filter(tok, lambda t: t != "")
    return F.transform(words, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(num_features)).cast("int"))


def _counted(buckets, num_features: int):
    """(start, sizes, f, n) for pieces of a column of rows' buckets, of about ``HELD_WORDS`` words or one longer row:
    from which row, each row's number of distinct buckets, and these with their counts, laid end to end."""
    sizes, words = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(), buckets.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = done = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, done + HELD_WORDS, "right")))
        row = np.repeat(np.arange(to - at), sizes[at:to])
        key, n = np.unique(row * num_features + words[done:ends[to - 1]], return_counts=True)
        row, f = np.divmod(key, num_features)
        yield at, np.bincount(row, minlength=to - at), f, n
        at, done = to, ends[to - 1]


def _vectors(sizes, f, n, idf) -> tuple[np.ndarray, np.ndarray]:
    """(row, v): the row of each entry and its L2-normalised tf-idf."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    v = n * idf[f]
    return row, v / np.sqrt(np.bincount(row, v * v, len(sizes)))[row]


def _chances(rows, row, f, v, weights, bias) -> np.ndarray:
    """Each row's probability of each label."""
    z = np.stack([np.bincount(row, v * w[f], rows) for w in weights.T], axis=1) + bias
    return 1.0 / (1.0 + np.exp(-z))


def _read(blocks):
    """(sizes, f, n, y) of each written block."""
    for b in blocks:
        for i in range(b.num_rows):
            sizes, f, n = (np.frombuffer(b.column(j)[i].as_buffer(), np.int32) for j in range(3))
            yield sizes, f, n, b.column(3)[i].values.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def _gradient(blocks, weights, bias, scale, idf):
    """Sums over a task's rows of each label's gradient: (bucket, g) of the buckets met, -1 for the intercept."""
    g, met, b = np.zeros_like(weights), np.zeros(len(weights), bool), np.zeros(len(bias))
    for sizes, f, n, y in _read(blocks):
        row, v = _vectors(sizes, f, n, idf)
        r = (_chances(len(sizes), row, f, v, weights, bias) - y) * np.where(y == 1.0, scale, 1.0)
        b += r.sum(axis=0)
        for k in range(len(bias)):
            g[:, k] += np.bincount(f, v * r[row, k], len(weights))
        met[f] = True
    at = np.flatnonzero(met)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1).astype(np.int32)), *[pa.array(np.append(g[at, k], b[k])) for k in range(len(bias))]],
        ["f", *[f"g{k}" for k in range(len(bias))]])


def fit_multilabel(df: DataFrame, text: str = "text", labels: str = "labels", num_features: int = FEATURES,
                   weights: dict | None = None, max_iter: int = 60, reg: float = 0.0, rate: float = 4.0):
    """Weighted multi-label training: one joint logistic model over hashed tf-idf words.

    Positive rows of a label carry its weight (neg/pos by default, A28).  Gradient descent on the mean
    weighted log loss plus ``reg`` * w^2 / 2: each iteration is one pass whose tasks return the
    gradients of all labels at once, one row a bucket, summed in Spark and read by the driver:
    ``num_features`` * labels numbers at most, whatever the number of rows.  A row's vector is unit
    length, so steps of ``rate`` are stable with the default weights.  Deterministic for a given table."""
    def counted(batches):
        for b in batches:
            for at, sizes, *entries in _counted(b.column(0), num_features):
                y = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), b.column(1).slice(at, len(sizes)))
                yield pa.RecordBatch.from_arrays([*[pa.array([a.astype(np.int32).tobytes()], pa.binary()) for a in (sizes, *entries)], y],
                                                 ["sizes", "f", "n", "y"])

    def frequencies(blocks):
        rows, have = 0, np.zeros(num_features, np.int64)
        for sizes, f, _, _ in _read(blocks):
            rows += len(sizes)
            have += np.bincount(f, minlength=num_features)
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(have[at], rows))], ["f", "df"])

    workers_import(df.sparkSession)
    x = df.select(hashed_words(text, num_features).alias("words"), F.col(labels).cast("array<double>").alias("y"))
    x = write_table(x.mapInArrow(counted, "sizes binary, f binary, n binary, y array<array<double>>"), "words")
    k = len(x.select("y").first()[0][0])
    if weights is None:
        w = class_weights(x.select(F.explode("y").alias("y")), "y").collect()  # one row per label position
        weights = {r["label_idx"]: (r["weight"] or 1.0) for r in w}
    scale = np.array([float(weights.get(i, 1.0)) for i in range(k)])
    # one row a bucket
    have = {r["f"]: r["df"] for r in x.mapInArrow(frequencies, "f int, df long").groupBy("f").agg(F.sum("df").alias("df")).collect()}
    n = have.pop(-1)
    idf = np.full(num_features, np.log(1.0 + n) + 1.0)
    for f, d in have.items():
        idf[f] = np.log((1.0 + n) / (1.0 + d)) + 1.0

    coef, bias = np.zeros((num_features, k)), np.zeros(k)
    schema = "f int, " + ", ".join(f"g{i} double" for i in range(k))
    for _ in range(max_iter):
        at = coef.copy(), bias.copy()
        sums = x.mapInArrow(lambda it, at=at: _gradient(it, *at, scale, idf), schema).groupBy("f").agg(
            *[F.sum(F.col(f"g{i}").cast("decimal(38,18)")).cast("double").alias(f"g{i}") for i in range(k)])  # sums in any order are equal
        got = sums.toPandas()
        step = np.zeros((num_features, k))
        grads = got[[f"g{i}" for i in range(k)]].to_numpy()
        f = got["f"].to_numpy()
        step[f[f >= 0]] = grads[f >= 0]
        coef = coef - rate * (step / n + reg * coef)
        bias = bias - rate * grads[f < 0].sum(axis=0) / n
    return MultiLabelModel(coef, bias, idf, text)


class LabelModel:
    """One label's part of a joint model, named as in Spark ML."""

    def __init__(self, coefficients, intercept):
        from pyspark.ml.linalg import Vectors

        self.coefficients, self.intercept = Vectors.dense(coefficients), float(intercept)


class MultiLabelModel:
    """C01 with a fitted model: probability of each label from hashed words."""

    def __init__(self, coef, bias, idf, text):
        self.coef, self.bias, self.idf, self.text = coef, bias, idf, text

    @property
    def models(self) -> list:
        return [LabelModel(self.coef[:, i], self.bias[i]) for i in range(len(self.bias))]

    def predict(self, df: DataFrame, out: str = "predictions") -> DataFrame:
        coef, bias, idf = self.coef, self.bias, self.idf

        @F.arrow_udf("array<double>")
        def score(words: pa.Array) -> pa.Array:
            got = [_chances(len(sizes), row, f, v, coef, bias) for _, sizes, f, n in _counted(words, len(idf))
                   for row, v in [_vectors(sizes, f, n, idf)]]
            p = np.concatenate([np.empty((0, len(bias))), *got]).reshape(-1)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) + 1, len(bias), dtype=np.int32)), pa.array(p))

        workers_import(df.sparkSession)
        return df.withColumn(out, score(hashed_words(self.text, len(idf))))


def climate_labels(adaptation, mitigation) -> Column:
    """P17 for climate: adaptation significant, principal, mitigation significant, principal."""
    return F.concat(M.multi_hot(adaptation, (1, 2)), M.multi_hot(mitigation, (1, 2)))


def evaluate_per_class(df: DataFrame, scorer_preds: Column, labels: Column, names) -> tuple[DataFrame, DataFrame]:
    """(rows with ``labels``, ``predictions`` and the wide ``Predicted X``
    and ``Label X`` columns (P23), metrics per class with the class's name)."""
    names = list(names)
    x = df.withColumns({"labels": labels, "predictions": scorer_preds})
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("class_idx").cast("int") + 1)
    return unpack_classes(x, names), metrics_per_class(x).withColumn("class_name", named)
