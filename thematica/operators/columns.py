"""Column selection and construction helpers."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_only(df: DataFrame, cols) -> DataFrame:
    """Keep a column list (order as given)."""
    return df.select(*cols)


def first_columns(df: DataFrame, n: int) -> list:
    """The first ``n`` input column names (the reference keeps 'original' columns by position)."""
    return df.columns[:n]


def rename(df: DataFrame, mapping) -> DataFrame:
    """Rename by map, or positionally when given a list of new names."""
    if isinstance(mapping, dict):
        return df.withColumnsRenamed(mapping)
    return df.toDF(*mapping)


def constant(df: DataFrame, name: str, value) -> DataFrame:
    """Constant column."""
    return df.withColumn(name, F.lit(value))


def cast_cols(df: DataFrame, types: dict, safe: bool = True) -> DataFrame:
    """Cast columns; ``safe`` uses try_cast so junk becomes null."""
    upd = {}
    for c, t in types.items():
        upd[c] = F.col(c).try_cast(t) if safe else F.col(c).cast(t)
    return df.withColumns(upd)


def source_order() -> Column:
    """P25: a number that rises with a row's place in its file, for a frame straight from a file scan.

    It is the start of the block that a task reads plus the row's place among those the task has read.  A row has a
    byte at least, and a task reads at most a block's length in all, so numbers of one block lie before the start of
    the next: a file that is split over tasks keeps its order.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + place


def map_rows(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """Per-row Python logic as an Arrow-batched map (escape hatch).

    ``fn`` takes and returns a pandas DataFrame batch.  Prefer column
    expressions; this exists for logic that has none.
    """
    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)
