"""Flag automation (X04 activities, X05 budgets) and flag descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import text as T
from ..functions.lexicon import Lexicon, extend_match, shipped

FLAGS = ("principal_gender", "principal_climate", "principal_disability")
DEFAULT_TEXT_COLS = ("project_title", "short_description", "long_description")


def add_theme_flags(df: DataFrame, marker: bool = True, significant: bool = True) -> DataFrame:
    """P12-P14 for every theme and level, then climate = adaptation OR mitigation."""
    upd = {}
    for t in M.THEMES:
        upd[f"principal_{t.key}"] = M.theme_flag(t.key, "pri", marker)
        if significant:
            upd[f"significant_{t.key}"] = M.theme_flag(t.key, "sig", marker)
    df = df.withColumns(upd)
    df = df.withColumn("principal_climate", M.any_flag(["principal_adaptation", "principal_mitigation"]))
    if significant:
        df = df.withColumn("significant_climate",
                           M.any_flag(["significant_adaptation", "significant_mitigation"]))
    return df


def automate_activities(df: DataFrame, text_cols=DEFAULT_TEXT_COLS, *, supplemental: Lexicon | None = None,
                        blanks=("", "-"), significant: bool = False) -> DataFrame:
    """Supplemental disability match, blank mask, theme flags.

    Input: activities with markers and the prediction columns of X01.
    Output: input columns + principal flags (+ significant flags).
    """
    text_cols = [c for c in text_cols if c in df.columns]
    lex = supplemental if supplemental is not None else shipped()["supplemental_disability"]
    text_r = T.clean_text_r(T.build_text(text_cols))
    df = df.withColumn(M.kw_col("disability"), extend_match(F.col(M.kw_col("disability")), text_r, lex))
    df = M.mask_blank(df, text_cols, blanks)
    out = add_theme_flags(df, marker=True, significant=True)
    drop = [] if significant else [c for c in out.columns if c.startswith("significant_")]
    drop += ["principal_adaptation", "principal_mitigation"] if not significant else []
    return out.drop(*drop)


def automate_budget(df: DataFrame, text_col: str = "text", *, blanks=("", "-"),
                    significant: bool = False) -> DataFrame:
    """Budget lines have no markers: flag = prediction AND lexicon match."""
    df = M.mask_blank(df, [text_col], blanks)
    out = add_theme_flags(df, marker=False, significant=True)
    drop = [] if significant else [c for c in out.columns if c.startswith("significant_")]
    drop += ["principal_adaptation", "principal_mitigation"] if not significant else []
    return out.drop(*drop)


def describe_flags(df: DataFrame, flags) -> DataFrame:
    """A18 for several flags in one aggregate, one row a flag."""
    aggs, rows = [], []
    for f in flags:
        c = F.col(f)
        aggs += [F.sum(c.isNull().cast("long")).alias(f"{f}__missing"), F.countDistinct(c).alias(f"{f}__distinct"),
                 F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"{f}__true"), F.avg(c.cast("double")).alias(f"{f}__mean")]
        rows.append(f"'{f}', n, `{f}__missing`, `{f}__distinct`, `{f}__true`, `{f}__mean`")
    x = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    return x.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (flag, n, missing, distinct, n_true, mean)")


def to_reference_names(df: DataFrame) -> DataFrame:
    """Sink-side rename to the reference's column titles."""
    m = {k: v for k, v in M.reference_names().items() if k in df.columns}
    return df.withColumnsRenamed(m)
