"""Vector pooling (G03-G05), re-aimed from hidden-state pooling onto an
``array<float>`` column.  Element-wise aggregation runs in the JVM
(``Summarizer``); nothing is collected beyond one output vector per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col_of


def mean_pool(df: DataFrame, vec: str, key) -> DataFrame:
    """Element-wise mean of the vectors of each key."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys = [key] if isinstance(key, str) else list(key)
    x = df.select(*keys, array_to_vector(F.col(vec)).alias("_v"))
    return x.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(f"{vec}_mean"))


def l2_normalize(vec) -> Column:
    """V / ||v||_2 (a zero vector stays zero)."""
    v = col_of(vec)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def flatten_pool(df: DataFrame, vec: str, key, ord_col: str) -> DataFrame:
    """The vectors of each key concatenated in ``ord_col`` order.

    The output is one long vector per key, so a key's row count bounds the
    collected array (the reference's keys are texts of at most 512 tokens).
    """
    keys = [key] if isinstance(key, str) else list(key)
    s = F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(vec).alias("v"))))
    return df.groupBy(*keys).agg(F.flatten(F.transform(s, lambda e: e["v"])).alias(f"{vec}_flat"))
