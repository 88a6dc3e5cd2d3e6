from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(cols) -> Column:
    cols = [col_of(c) for c in cols]
    return reduce(or_, cols) if cols else F.lit(False)


def fbool(c) -> Column:
    """Null-as-false (R ``which()`` semantics, N1)."""
    return F.coalesce(col_of(c), F.lit(False))


MONEY_SCALE = 12


def money_sum(c, scale: int | None = MONEY_SCALE) -> Column:
    """Order-independent money total, returned as double.

    A double sum depends on the order partitions are added in.  Values are
    summed as DECIMAL(38, scale) instead: with 12 decimals an amount in
    millions is exact to a millionth of a unit, so rows are not rounded in any
    way that shows, and totals have 26 digits before the point.
    ``scale=None`` is a plain double sum."""
    c = col_of(c)
    if scale is None:
        return F.sum(c)
    return F.sum(c.cast(f"decimal(38,{scale})")).cast("double")


def stage(df, cols: dict):
    """Add expensive derived columns so that each is computed once per row.

    Catalyst substitutes a projected expression into every filter pushed
    below it and every consumer it collapses into, and a lambda re-evaluates
    outer expressions per element, so a regex-cleaned text used by three
    predicates can run three times.  Columns produced by a generator are
    different: a one-element ``inline`` yields them as generator outputs,
    which predicates cannot be pushed beneath and projections cannot inline.
    The Generate stays inside whole-stage codegen and adds no shuffle.
    """
    df = df.drop(*[n for n in cols if n in df.columns])
    return df.select("*", F.inline(F.array(F.struct(*[col_of(c).alias(n) for n, c in cols.items()]))))
