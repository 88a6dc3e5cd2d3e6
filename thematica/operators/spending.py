"""Sector and spending report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._util import col_of, fbool, money_sum
from ..functions import markers as M


def total_strict(df: DataFrame, amount: str) -> DataFrame:
    """Grand total that is null when any value is null (R ``sum`` w/o na.rm, N6)."""
    return df.agg(F.when(F.count(F.lit(1)) == F.count(amount), money_sum(amount)).alias("total"))


def ratio_by(df: DataFrame, key: str, num: str, den: str, out: str = "ratio") -> DataFrame:
    """Ratio of null-skipping sums per group; x/0 -> null (N7).  Sorted
    ascending, nulls last (O03)."""
    r = F.try_divide(F.coalesce(money_sum(num), F.lit(0.0)), F.coalesce(money_sum(den), F.lit(0.0)))
    return df.groupBy(key).agg(r.alias(out)).orderBy(F.col(out).asc_nulls_last(), F.col(key))


def freq(df: DataFrame, col: str, out: str = "n", desc: bool = True) -> DataFrame:
    """A16/A17 (+O02): frequency table, nulls excluded, most frequent first."""
    f = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    return f.orderBy(F.col(out).desc(), F.col(col)) if desc else f


def spend_panel(df: DataFrame, subsets: dict, periods: dict, disb: str = "usd_disbursement",
                comm: str = "usd_commitment") -> DataFrame:
    """{subset} x {period} disbursed / committed / ratio in ONE pass.

    ``subsets`` and ``periods`` map a name to a boolean Column.  One
    aggregate of conditional sums, then ``stack`` to long form.
    """
    aggs, names = [], []
    for pn, pc in periods.items():
        for sn, sc in subsets.items():
            cond = fbool(pc) & fbool(sc)
            k = f"{pn}__{sn}"
            aggs += [F.coalesce(money_sum(F.when(cond, F.col(disb))), F.lit(0.0)).alias(f"{k}__d"),
                     F.coalesce(money_sum(F.when(cond, F.col(comm))), F.lit(0.0)).alias(f"{k}__c")]
            names.append((pn, sn, k))
    wide = df.agg(*aggs)
    n = len(names)
    parts = ", ".join(f"'{pn}', '{sn}', `{k}__d`, `{k}__c`" for pn, sn, k in names)
    long = wide.selectExpr(f"stack({n}, {parts}) as (period, subset, disbursed, committed)")
    return long.withColumn("ratio", F.try_divide(F.col("disbursed"), F.col("committed")))


def spending_report(df: DataFrame, health_sectors, window=(2018, 2022), same_year: int = 2022,
                    text_cols=("project_title", "short_description", "long_description"),
                    blanks=("", "-")) -> dict:
    """Principal-gender flag (P11 + P12), health flag (P22), then the
    gender sector table, two disbursement/commitment ratio tables and the
    spending panel.  Returns a dict of DataFrames."""
    text_cols = [c for c in text_cols if c in df.columns]
    x = M.mask_blank(df, text_cols, blanks)
    x = x.withColumns({
        "principal_gender": M.theme_flag("gender", "pri"),
        "health": M.in_set(F.col("sector_name"), health_sectors),
    })
    cy = col_of("commitment_year")
    # a difference, not an equality: where the years come from two tables, an equality would become a key of
    # their join, and every comparison of its sort would work out the year of a date
    same = F.col("year") - cy == 0
    return {
        "gender_sectors": freq(x.where(F.col("principal_gender")), "sector_name"),
        "ratio_all": ratio_by(x, "sector_name", "usd_disbursement", "usd_commitment", "aid_debt_ratio"),
        "ratio_same_year": ratio_by(x.where(same), "sector_name", "usd_disbursement",
                                    "usd_commitment", "aid_debt_ratio"),
        "panel": spend_panel(
            x,
            {"health": F.col("health"), "gender": F.col("principal_gender"),
             "gender_health": F.col("principal_gender") & F.col("health")},
            {"window": cy.between(*window),
             "same_year": (F.col("year") == same_year) & (cy == same_year)}),
    }
