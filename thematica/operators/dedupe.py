"""De-duplication (A23-A26, W07) and row-count funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys, order=None) -> DataFrame:
    """One row per key tuple (nulls equal, N4).

    Without ``order`` any row may win and ``dropDuplicates`` is used (map-side
    partial aggregation, so a key holding a third of the rows is collapsed
    before the shuffle).  With ``order`` the first row in that order wins
    (W07): ``min_by`` over a struct of the other columns - also a partial
    aggregate, never a per-key sort of all the key's rows.
    """
    keys = list(keys)
    if order is None:
        return df.dropDuplicates(keys)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(o) for o in order])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordk).alias("_first"))
    return agg.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def distinct_values(df: DataFrame, cols, out: str = "value") -> DataFrame:
    """Distinct values over one or several columns combined."""
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias(out)).distinct()


def funnel_counts(df: DataFrame, stages: dict) -> DataFrame:
    """A27 where every stage is a condition on the same rows: one aggregate."""
    x = df.agg(*[F.count(F.when(c, 1)).alias(f"s{i}") for i, c in enumerate(stages.values())])
    rows = ", ".join(f"'{name}', {i}, s{i}" for i, name in enumerate(stages))
    return x.selectExpr(f"stack({len(stages)}, {rows}) as (stage, step, rows)")


def funnel(stages: dict) -> DataFrame:
    """before/after row counts, one row per named stage (one job each
    stage, counts only - nothing but integers reaches the driver)."""
    items = list(stages.items())
    first = items[0][1].select(F.lit(items[0][0]).alias("stage"), F.lit(0).alias("step")).limit(0)
    out = None
    for i, (name, df) in enumerate(items):
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), F.lit(i).alias("step"),
                                                            "rows")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else first
