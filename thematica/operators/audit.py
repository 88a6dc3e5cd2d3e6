"""Disagreement audits (F16-F21) and the mislabel report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import fbool
from ..functions import markers as M
from . import filters as FL


def audit_conf_no_match(theme: str, threshold: float = 0.9) -> Column:
    """F16: principal confidence above threshold but no lexicon match."""
    t = M.THEME[theme]
    return (F.col(M.conf_col(theme, "pri")) > threshold) & ~F.col(M.kw_col(t.lexicon))


def audit_match_no_conf(threshold: float = 0.1) -> Column:
    """both climate principal confidences below threshold with a match."""
    return ((F.col(M.conf_col("adaptation", "pri")) < threshold)
            & (F.col(M.conf_col("mitigation", "pri")) < threshold) & F.col("climate_kw"))


def audit_swapped(declared: str, scored: str, hi: float = 0.95, lo: float = 0.5) -> Column:
    """declared ``declared`` principal and ``scored`` marker 0, but the
    model is confident about ``scored`` and not about ``declared``."""
    d, s = M.THEME[declared], M.THEME[scored]
    return (F.col("climate_kw") & (F.col(s.marker) == 0) & (F.col(d.marker) == 2)
            & (F.col(M.conf_col(declared, "pri")) < lo) & (F.col(M.conf_col(scored, "pri")) > hi))


def audit_off_theme(threshold: float = 0.01) -> Column:
    """both climate markers principal, no match, both confidences tiny."""
    return (~F.col("climate_kw") & (F.col("climate_adaptation") == 2) & (F.col("climate_mitigation") == 2)
            & (F.col(M.conf_col("adaptation", "pri")) < threshold)
            & (F.col(M.conf_col("mitigation", "pri")) < threshold))


# FIXED VALUES: second-round label texts (gender).
NO_LABEL = "No gender equality objective"
SIG_LABEL = "Significant gender equality objective"
PRI_LABEL = "Principal gender equality objective"
BUCKETS = ("true_negative", "true_pos_sig", "true_pos_pri", "false_neg_sig", "false_neg_pri",
           "false_pos_sig", "false_pos_pri", "false_pos", "false_neg")


def confusion_flags(label: str = "label", sig_pred: str = "sig_pred", pri_pred: str = "pri_pred",
                    no=NO_LABEL, sig=SIG_LABEL, pri=PRI_LABEL) -> dict:
    """the nine confusion subsets as boolean columns (R ``subset`` drops
    NA, so each is null-as-false).  Predictions are "True"/"False" texts."""
    lab, sp, pp = F.col(label), F.col(sig_pred) == "True", F.col(pri_pred) == "True"
    sn, pn = F.col(sig_pred) == "False", F.col(pri_pred) == "False"
    d = {
        "true_negative": (lab == no) & sn & pn,
        "true_pos_sig": (lab == sig) & sp,
        "true_pos_pri": (lab == pri) & pp,
        "false_neg_sig": (lab == sig) & sn,
        "false_neg_pri": (lab == pri) & pn,
        "false_pos_sig": (lab != sig) & sp,
        "false_pos_pri": (lab != pri) & pp,
        "false_pos": (lab == no) & (pp | sp),
        "false_neg": (lab != no) & sn & pn,
    }
    return {k: fbool(v) for k, v in d.items()}


def confusion_buckets(df: DataFrame, **kw) -> DataFrame:
    """F21 in one pass: each row is emitted once per bucket it belongs to."""
    flags = confusion_flags(**kw)
    arr = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]), lambda x: x.isNotNull())
    return df.withColumn("bucket", F.explode(arr))


# FIXED VALUES: columns of the mislabel report.
MISLABEL_KEEP = ("crs_id", "year", "donor_name", "recipient_name", "purpose_name", "sector_name",
                 "project_title", "short_description", "long_description", "climate_adaptation",
                 "climate_mitigation", "adaptation_pri_conf", "mitigation_pri_conf", "climate_kw")


def mislabel_report(df: DataFrame, text_cols=("project_title", "short_description", "long_description"),
                    keep=MISLABEL_KEEP, id_col: str = "crs_id", blanks=("", "-", " "), confident: float = 0.95,
                    unsure: float = 0.5, off_theme: float = 0.01) -> DataFrame:
    """Drop blank records, keep the report columns, distinct, drop empty
    ids, then the three audit lists (two swap directions and off-theme) as rows
    of one table with the list's name in ``report``; one pass over the records."""
    keep = [c for c in keep if c in df.columns]
    base = df.where(FL.drop_blank(text_cols, blanks)).select(*keep).distinct()
    base = base.where(F.col(id_col) != "")
    lists = {
        "adaptation_mislabeled_mitigation": audit_swapped("mitigation", "adaptation", confident, unsure),
        "mitigation_mislabeled_adaptation": audit_swapped("adaptation", "mitigation", confident, unsure),
        "non_climate_mislabeled": audit_off_theme(off_theme),
    }
    names = F.filter(F.array(*[F.when(fbool(c), F.lit(k)) for k, c in lists.items()]), lambda x: x.isNotNull())
    return base.select(F.explode(names).alias("report"), *keep)
