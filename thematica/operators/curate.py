"""Training-set curation: quantile hard-example mining (X08), fixed-threshold
climate curation (X09), exact distributed percentiles (A20), histograms (A19),
rates (A21) and near-duplicate removal over the text order (W03, W04).

Scale notes
* Percentiles are exact without ranking rows: ``selection`` brackets the wanted
  ranks and counts.
* Percentiles used as thresholds are read once and become literals.
* The adjacent-row distance cuts the text order by splitters of the whole
  key: ``lead`` inside each segment, and each segment's first text is handed to
  the one before as a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._util import any_of, fbool, stage
from ..functions import markers as M
from ..functions import text as T
from ..functions.lexicon import keyword_match, shipped
from ..session import write_table
from . import filters as FL
from . import selection
from .ranking import segment_of, text_splitters

PROBS = (0.01, 0.1, 0.5, 0.9, 0.99)


def percentiles(df: DataFrame, cols, probs=PROBS, method: str = "exact", splits: int | None = None,
                accuracy: int = 100000) -> DataFrame:
    """Percentiles with linear interpolation (R type 7 = Spark
    ``percentile`` = DuckDB ``quantile_cont``), one row per probability with
    one column per input column.

    ``exact``: selection, not ranking (``selection.exact_percentiles``): sketches
    bracket the wanted ranks, rows below and inside are counted, and the last few
    values are counted one by one.  A value that half of all rows hold costs a row a task.
    ``splits`` is accepted for callers that still name a number of segments; there are none.
    ``approx``: ``percentile_approx`` of all columns in one scan; for sketches that
    are kept and merged see ``selection.quantile_sketches``.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    if method == "exact":
        return selection.exact_percentiles(df, cols, probs)
    ps = F.array(*[F.lit(float(p)) for p in probs])
    x = df.agg(*[F.percentile_approx(c, list(probs), accuracy).alias(c) for c in cols])
    x = x.select(*cols, F.posexplode(ps).alias("p_no", "prob"))
    return x.select("p_no", "prob", *[F.element_at(F.col(c), F.col("p_no") + 1).cast("double").alias(c) for c in cols]).orderBy("p_no")


def percentile_scalars(df: DataFrame, cols, probs=PROBS, method: str = "exact") -> dict:
    """Percentiles of several columns as literals for row predicates.

    The table has one row per probability; its values are read once and become
    literals.  Returns ``{col: [Column per prob]}``.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    rows = sorted(percentiles(df, cols, probs, method).collect(), key=lambda r: r["p_no"])  # len(probs) rows
    return {c: [F.lit(r[c]).cast("double") for r in rows] for c in cols}


def histogram(df: DataFrame, col: str, lo: float = 0.0, hi: float = 1.0, bins: int = 10) -> DataFrame:
    """Equal-width histogram (values at ``hi`` fall in the last bin)."""
    b = F.least(F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return (df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("lo", F.lit(lo) + (F.col("bin") - 1) * F.lit((hi - lo) / bins))
            .orderBy("bin"))


def rate(df: DataFrame, pred: Column, subset: Column | None = None, out: str = "rate") -> DataFrame:
    """Share of rows (optionally within a subset) where ``pred`` holds."""
    x = df.where(fbool(subset)) if subset is not None else df
    return x.agg(F.avg(fbool(pred).cast("double")).alias(out))


# ---------------------------------------------------------------------------
# Quantile hard-example mining (gender / disability curation)
# ---------------------------------------------------------------------------
# FIXED VALUES: gender label texts of the curated set.
GENDER_LABELS = ("No gender equality objective", "Significant gender equality objective",
                 "Principal gender equality objective")
CRITERIA_X08 = ("strong_pri_weak_sig", "strong_sig_weak_pri", "fn_sig", "fn_pri", "fp_sig", "fp_pri", "tn")


def hard_example_flags(df: DataFrame, method: str = "exact") -> DataFrame:
    """The seven criteria as boolean columns, thresholds from the
    percentiles of the filtered input itself."""
    ps = percentile_scalars(df, ["pri_conf", "sig_conf"], PROBS, method)
    p, s = ps["pri_conf"], ps["sig_conf"]
    sig, pri = F.col("sig_conf"), F.col("pri_conf")
    pos_p, pos_s, neg = F.col("sig") == 2, F.col("sig") == 1, F.col("sig") == 0
    pp, sp = F.col("pri_pred") == "True", F.col("sig_pred") == "True"
    crit = {
        "strong_pri_weak_sig": (pri >= p[4]) & (sig <= s[2]) & pos_p,
        "strong_sig_weak_pri": (sig >= s[3]) & (pri <= p[2]) & pos_s,
        "fn_sig": pos_s & ~sp & (sig <= s[2]),
        "fn_pri": pos_p & ~pp & (pri <= p[2]),
        "fp_sig": ~pos_s & sp & (sig >= s[4]),
        "fp_pri": ~pos_p & pp & (pri >= p[4]),
        "tn": neg & (sig <= s[1]) & (pri <= p[1]),
    }
    return df.withColumns({k: fbool(v) for k, v in crit.items()})


def prefilter_quantile(df: DataFrame) -> DataFrame:
    """F06 + F07 + F05 as the reference applies them before mining."""
    return (df.where(FL.drop_unmatched_positive()).where(FL.drop_matched_negative())
            .where(FL.fits_context("text")))


def curate_quantile(df: DataFrame, labels=GENDER_LABELS, method: str = "exact", keep_flags: bool = False) -> DataFrame:
    """Input text, sig, match/sig_pred/pri_pred ('True'/'False'),
    sig_conf, pri_conf -> (text, label) of the rows meeting any criterion."""
    x = hard_example_flags(prefilter_quantile(df), method)
    x = x.where(any_of([F.col(c) for c in CRITERIA_X08]))
    x = x.withColumn("label", M.marker_label(F.col("sig"), *labels))
    return x if keep_flags else x.select("text", "label")


# ---------------------------------------------------------------------------
# Climate curation with fixed thresholds
# ---------------------------------------------------------------------------
# FIXED VALUES: thresholds of the climate criteria.
GAP_RULES = {  # level gaps: (conf, other conf, margin, marker, value)
    "a_strong_pri_weak_sig": ("adapt_pri_conf", "adapt_sig_conf", 0.01, "adapt_sig", 2),
    "m_strong_pri_weak_sig": ("mitig_pri_conf", "mitig_sig_conf", 0.01, "mitig_sig", 2),
    "a_strong_sig_weak_pri": ("adapt_sig_conf", "adapt_pri_conf", 0.68, "adapt_sig", 1),
    "m_strong_sig_weak_pri": ("mitig_sig_conf", "mitig_pri_conf", 0.62, "mitig_sig", 1),
}
CROSS_RULES = {  # cross-theme: (conf, other conf, margin, marker, value, other marker)
    "a_sig_over_m_sig": ("adapt_sig_conf", "mitig_sig_conf", 0.5, "adapt_sig", 1, "mitig_sig"),
    "m_sig_over_a_sig": ("mitig_sig_conf", "adapt_sig_conf", 0.1, "mitig_sig", 1, "adapt_sig"),
    "a_pri_over_m_pri": ("adapt_pri_conf", "mitig_pri_conf", 0.6, "adapt_sig", 2, "mitig_sig"),
    "m_pri_over_a_pri": ("mitig_pri_conf", "adapt_pri_conf", 0.3, "mitig_sig", 2, "adapt_sig"),
}
FN_RULES = {"fn_sig_a": ("adapt_sig", 1, "adapt_sig_pred", "adapt_sig_conf", 0.3),
            "fn_sig_m": ("mitig_sig", 1, "mitig_sig_pred", "mitig_sig_conf", 0.25),
            "fn_pri_a": ("adapt_sig", 2, "adapt_pri_pred", "adapt_pri_conf", 0.4),
            "fn_pri_m": ("mitig_sig", 2, "mitig_pri_pred", "mitig_pri_conf", 0.4)}
FP_RULES = {"fp_sig_a": ("adapt_sig", 1, "adapt_sig_pred", "adapt_sig_conf", 0.976),
            "fp_sig_m": ("mitig_sig", 1, "mitig_sig_pred", "mitig_sig_conf", 0.985),
            "fp_pri_a": ("adapt_sig", 2, "adapt_pri_pred", "adapt_pri_conf", 0.98),
            "fp_pri_m": ("mitig_sig", 2, "mitig_pri_pred", "mitig_pri_conf", 0.98)}
TN_RULES = {"tn_a": ("adapt_sig", ("adapt_sig_conf", "adapt_pri_conf"), 0.0132),
            "tn_m": ("mitig_sig", ("mitig_sig_conf", "mitig_pri_conf"), 0.01132)}
MISSED_THRESHOLD = 0.75
ADAPTATION_LABELS = ("No climate adaptation objective", "Significant climate adaptation objective",
                     "Principal climate adaptation objective")
MITIGATION_LABELS = ("No climate mitigation objective", "Significant climate mitigation objective",
                     "Principal climate mitigation objective")
ERROR_SET = tuple(FN_RULES) + tuple(FP_RULES)


def climate_hard_flags(df: DataFrame) -> DataFrame:
    """Eighteen boolean criteria."""
    c = {}
    for k, (a, b, m, mk, v) in GAP_RULES.items():
        c[k] = (F.col(a) >= F.col(b) + m) & (F.col(mk) == v)
    for k, (a, b, m, mk, v, other) in CROSS_RULES.items():
        c[k] = (F.col(a) >= F.col(b) + m) & (F.col(mk) == v) & (F.col(mk) > F.col(other))
    for k, (mk, v, pred, conf, thr) in FN_RULES.items():
        c[k] = (F.col(mk) == v) & ~F.col(pred) & (F.col(conf) <= thr)
    for k, (mk, v, pred, conf, thr) in FP_RULES.items():
        c[k] = ~(F.col(mk) == v) & F.col(pred) & (F.col(conf) >= thr)
    for k, (mk, confs, thr) in TN_RULES.items():
        cond = F.col(mk) == 0
        for cc in confs:
            cond = cond & (F.col(cc) <= thr)
        c[k] = cond
    return df.withColumns({k: fbool(v) for k, v in c.items()})


def prepare_climate(df: DataFrame, lexicons: dict | None = None) -> DataFrame:
    """X09 load/repair: decisions from confidences, supplemental and negative
    vocabularies, strong-vocabulary matches, capped markers, label filters,
    context filter.  Input: text, adapt_sig, mitig_sig, match ('True'/'False'),
    adapt_sig_conf, adapt_pri_conf, mitig_sig_conf, mitig_pri_conf."""
    lx = lexicons or shipped()
    x = df.withColumns({
        f"{c}_pred": M.binarize(f"{c}_conf") for c in ("adapt_sig", "adapt_pri", "mitig_sig", "mitig_pri")
    })
    x = stage(x, {"_clean_r": T.clean_text_r(F.col("text"))})
    x = stage(x, {"_tok_r": F.split(F.coalesce(F.col("_clean_r"), F.lit("")), " ")})
    clean, tok = F.col("_clean_r"), F.col("_tok_r")
    x = stage(x, {
        "_supp": keyword_match(clean, lx["supplemental_climate"], tok),
        "_neg": keyword_match(clean, lx["negative_climate"], tok),
        "adaptation_match": keyword_match(clean, lx["strong_adaptation"], tok),
        "mitigation_match": keyword_match(clean, lx["strong_mitigation"], tok),
    })
    x = x.withColumn("match", F.when(F.col("_supp"), F.lit("True")).otherwise(F.col("match")))
    x = x.where(~F.col("_neg")).drop("_supp", "_neg", "_clean_r", "_tok_r")
    x = x.withColumns({"adapt_sig": M.cap_marker("adapt_sig"), "mitig_sig": M.cap_marker("mitig_sig")})
    x = x.where(~((F.col("match") == "True") & (F.col("adapt_sig") == 0) & (F.col("mitig_sig") == 0)))
    x = x.where(~((F.col("match") == "False") & ((F.col("adapt_sig") > 0) | (F.col("mitig_sig") > 0))))
    return x.where(FL.fits_context("text"))


def curate_climate(df: DataFrame, *, lexicons: dict | None = None, exclude_mislabeled: bool = True,
                   reference_union: bool = False, near_dup: float | None = 0.2, keep_last: bool = True,
                   order_col: str | None = None) -> DataFrame:
    """Climate training set: criteria union minus likely mislabels,
    labels, then near-duplicate removal in text order.

    ``reference_union`` reproduces the union list that names one criterion
    twice and omits mitigation strong-significant (D4); ``exclude_mislabeled
    =False`` reproduces the set difference that was never applied (D2).
    """
    x = climate_hard_flags(prepare_climate(df, lexicons))
    crit = list(GAP_RULES) + list(CROSS_RULES) + list(FN_RULES) + list(FP_RULES) + list(TN_RULES)
    if reference_union:
        crit.remove("m_strong_sig_weak_pri")
    keep = any_of([F.col(c) for c in crit])
    if exclude_mislabeled:
        missed_a = fbool(_missed("adapt_sig", "adaptation_match", ("adapt_pri_conf", "adapt_sig_conf")))
        missed_m = fbool(_missed("mitig_sig", "mitigation_match", ("mitig_pri_conf", "mitig_sig_conf")))
        keep = keep & ~(missed_a | missed_m)
    x = x.where(keep).select(
        "text", *([order_col] if order_col else []),
        M.marker_label(F.col("adapt_sig"), *ADAPTATION_LABELS).alias("adaptation_label"),
        M.marker_label(F.col("mitig_sig"), *MITIGATION_LABELS).alias("mitigation_label"))
    if near_dup is None:
        return x
    return drop_near_dups(write_table(x, "curated"), "text", order_col, near_dup, keep_last)


def _missed(marker, match, confs):
    c = F.lit(False)
    for cc in confs:
        c = c | (F.col(cc) > MISSED_THRESHOLD)
    return (F.col(marker) == 0) & F.col(match) & c


def error_rows(df: DataFrame) -> DataFrame:
    """Union of the FN/FP criteria; ``fp_drill`` = FP rows with both markers 0."""
    x = climate_hard_flags(df)
    x = x.where(any_of([F.col(c) for c in ERROR_SET]))
    fp = any_of([F.col(c) for c in FP_RULES])
    return x.withColumn("fp_drill", fp & (F.col("adapt_sig") == 0) & (F.col("mitig_sig") == 0))


# ---------------------------------------------------------------------------
# Adjacent distance in text order, near-duplicate removal
# ---------------------------------------------------------------------------

def adjacent_next(df: DataFrame, col: str, tiebreak: str | None = None, splits: int | None = None,
                  out: str = "next_text") -> DataFrame:
    """The value of ``col`` on the next row in (col, tiebreak) order.

    Distributed: a global ``lead`` would put every row in one task.  The order
    is cut by splitters of the whole key (``ranking.text_splitters``), so texts
    that share a long opening, or are equal, are cut too.  Each segment also
    gets the first text of the next one as a row that sorts last and is dropped after
    ``lead``: the texts cross one exchange and nothing is joined back.  ``df``
    is read four times, the last time whole; pass a written table where it is dear to compute.
    """
    cuts = text_splitters(df, col, tiebreak, splits)
    x = df.withColumns({"_seg": segment_of(cuts, col, tiebreak), "_edge": F.lit(False)})
    # one row a segment
    firsts = x.groupBy("_seg").agg(F.min(F.col(col)).alias(col))
    edges = firsts.select(F.lag("_seg").over(Window.orderBy("_seg")).alias("_seg"), col, F.lit(True).alias("_edge"))
    x = x.unionByName(edges.where(F.col("_seg").isNotNull()), allowMissingColumns=True)
    x = x.repartitionById(len(cuts) + 1, F.col("_seg"))
    w = Window.partitionBy("_seg").orderBy("_edge", col, *([tiebreak] if tiebreak else []))
    return x.withColumn(out, F.lead(F.col(col)).over(w)).where(~F.col("_edge")).drop("_seg", "_edge")


def near_dup_distance(df: DataFrame, col: str = "text", tiebreak: str | None = None, threshold: float = 0.2,
                      out: str = "dist") -> DataFrame:
    """W03 + T13: ``levenshtein(text, next)/length(text)``.

    Exact when the distance is within the band ``ceil(threshold * length)``;
    beyond it the value is a lower bound that is still >= threshold (the
    banded DP stops early, and a length gap larger than the band skips the DP
    entirely), which is all the near-duplicate decision needs.

    The distance expression occurs once in the plan: ``pmod(d, k + 2)`` maps
    the banded result's "beyond band" marker -1 to k + 1, so no second
    reference is needed (filters pushed through projections copy every
    reference of an aliased expression).
    """
    x = adjacent_next(df, col, tiebreak)
    a, b = F.col(col), F.col("next_text")
    la = F.length(a)
    k = F.ceil(la * F.lit(threshold)).cast("int")
    near_len = F.abs(la - F.length(b)) <= k
    band = F.pmod(F.call_function("levenshtein", a, b, k), k + 2)
    dist = (F.when(b.isNull() | (la == 0), F.lit(None).cast("double"))
            .when(~near_len, (F.abs(la - F.length(b))).cast("double") / la.cast("double"))
            .otherwise(band.cast("double") / la.cast("double")))
    return x.withColumn(out, dist).drop("next_text")


def drop_near_dups(df: DataFrame, col: str = "text", tiebreak: str | None = None, threshold: float = 0.2,
                   keep_last: bool = True) -> DataFrame:
    """Keep rows whose distance to the next text is >= threshold; the
    last row (no next) is kept by default, dropped with ``keep_last=False``
    like the reference (D5)."""
    x = near_dup_distance(df, col, tiebreak, threshold)
    return x.where(F.coalesce(F.col("dist") >= threshold, F.lit(keep_last))).drop("dist")
