"""Activity queries over the ``flows`` view: predictions, flags, overlaps,
Venn sizes, audits, spending report, filters and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._util import money_sum
from ..functions import markers as M
from ..operators import audit, automate, dedupe, filters, overlap, scoring, spending
from ..operators.training import sample_n
from ..sources import tables as TB
from . import sqlkit as S
from .catalog import (AUTOMATED_FLOWS_SQL, FLOW_KEYS, _pred_sql_for_keys, automated_flows, flow_lexicons,
                      flow_scorers, predicted_flows, register)

FLAGS = ("principal_gender", "principal_climate", "principal_disability")
FLAG_SQL = ", ".join(FLAGS)
W = f"WITH {AUTOMATED_FLOWS_SQL.strip()}"


def _money(expr: str = "usd_disbursement", out: str = "usd_disbursement") -> str:
    return f"coalesce(CAST(sum(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE), 0) AS {out}"


# --- A02-A04: overlap by other keys ------------------------------------------
for name, keys in (("overlap_by_region", ["year", "region_name"]),
                   ("overlap_by_flow", ["year", "flow_name"]),
                   ("overlap_by_donor_recipient_flow", ["year", "donor_name", "recipient_name", "flow_name"])):
    def _q(spark, sf, keys=keys):
        return overlap.overlap_by(automated_flows(spark, sf), keys, amount="usd_disbursement")
    register(name, f"""{W}
SELECT {', '.join(keys)}, {FLAG_SQL}, {_money()} FROM automated GROUP BY ALL""")(_q)


# --- A05: flag combinations over all years, any-flag rows -------------------
@register("overlap_any_flag", f"""{W}
SELECT {FLAG_SQL}, {_money()} FROM automated
WHERE principal_gender OR principal_climate OR principal_disability GROUP BY ALL""")
def q_overlap_any(spark, sf):
    return overlap.overlap_by(automated_flows(spark, sf), [], amount="usd_disbursement", any_only=True)


# --- A06: year level and all-years level in one grouping-sets pass ----------
@register("overlap_rollup", f"""{W}
SELECT year, {FLAG_SQL}, {_money()}, false AS is_total FROM automated GROUP BY ALL
UNION ALL
SELECT NULL AS year, {FLAG_SQL}, {_money()}, true AS is_total FROM automated
WHERE principal_gender OR principal_climate OR principal_disability GROUP BY ALL""")
def q_overlap_rollup(spark, sf):
    return overlap.overlap_rollup(automated_flows(spark, sf), ["year"], amount="usd_disbursement")


# --- A07/A08/U05/G02: Venn set sizes, disjoint regions, intersections --------
def _venn(spark, sf):
    v = overlap.overlap_by(automated_flows(spark, sf), [], amount="usd_disbursement", any_only=True)
    v = v.select(F.col("principal_gender").alias("Gender"), F.col("principal_climate").alias("Climate"),
                 F.col("principal_disability").alias("Disability"),
                 (F.col("usd_disbursement") / 1e6).alias("usd_disbursement"))
    return overlap.set_sizes(v)


VENN_SQL = f"""{W},
venn AS (
  SELECT principal_gender AS g, principal_climate AS c, principal_disability AS d,
         coalesce(fsum(usd_disbursement), 0) / 1e6 AS v
  FROM automated WHERE principal_gender OR principal_climate OR principal_disability GROUP BY ALL),
sizes AS (
  SELECT round_even(coalesce(sum(CASE WHEN c THEN v END), 0), 0) AS c,
         round_even(coalesce(sum(CASE WHEN g THEN v END), 0), 0) AS g,
         round_even(coalesce(sum(CASE WHEN d THEN v END), 0), 0) AS d,
         round_even(coalesce(sum(CASE WHEN c AND g THEN v END), 0), 0) AS cg,
         round_even(coalesce(sum(CASE WHEN c AND d THEN v END), 0), 0) AS cd,
         round_even(coalesce(sum(CASE WHEN g AND d THEN v END), 0), 0) AS gd,
         round_even(coalesce(sum(CASE WHEN g AND d AND c THEN v END), 0), 0) AS cgd
  FROM venn)"""


@register("venn_regions", f"""{VENN_SQL}
SELECT c - cg - cd + cgd AS only_c, g - cg - gd + cgd AS only_g, d - cd - gd + cgd AS only_d,
       cg - cgd AS cg_only, cd - cgd AS cd_only, gd - cgd AS gd_only, cgd,
       c + g + d - cg - cd - gd + cgd AS union_size FROM sizes""")
def q_venn_regions(spark, sf):
    return overlap.venn_regions(_venn(spark, sf))


@register("venn_set_sizes", f"{VENN_SQL}\nSELECT * FROM sizes")
def q_venn_sizes(spark, sf):
    return _venn(spark, sf)


@register("venn_intersections", f"""{VENN_SQL},
ranges AS (
  SELECT 'climate' AS set_name, 1 AS lo, c AS hi FROM sizes
  UNION ALL SELECT 'gender', 1, cg FROM sizes
  UNION ALL SELECT 'gender', c + 1, c + 1 + (g - cg) - 1 FROM sizes
  UNION ALL SELECT 'disability', 1, cgd FROM sizes
  UNION ALL SELECT 'disability', c + 1, c + 1 + (gd - cgd) - 1 FROM sizes
  UNION ALL SELECT 'disability', cg + 1, cg + 1 + (cd - cgd) - 1 FROM sizes
  UNION ALL SELECT 'disability', (c + 1 + (g - cg) - 1) + 1, (c + 1 + (g - cg) - 1) + 1 + (((d - cd) - gd) + cgd) - 1 FROM sizes),
r AS (SELECT * FROM ranges WHERE hi >= lo),
pairs AS (SELECT 'gender' AS a, 'disability' AS b UNION ALL SELECT 'climate', 'disability'
          UNION ALL SELECT 'climate', 'gender')
SELECT p.a, p.b, CAST(coalesce(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo) + 1), 0) AS BIGINT) AS size
FROM pairs p LEFT JOIN r x ON x.set_name = p.a LEFT JOIN r y ON y.set_name = p.b AND x.lo <= y.hi AND y.lo <= x.hi
GROUP BY p.a, p.b""")
def q_venn_intersections(spark, sf):
    rng = overlap.element_ranges(_venn(spark, sf))
    return overlap.intersect_sizes(rng, [("gender", "disability"), ("climate", "disability"), ("climate", "gender")])


# --- G01: replicate each combination ceil(amount in millions) times ----------
@register("replicate_overlap", f"""{W},
agg AS (SELECT year, {FLAG_SQL}, coalesce(fsum(usd_disbursement), 0) / 1e6 AS v FROM automated GROUP BY ALL)
SELECT year, {FLAG_SQL}, CAST(unnest(range(1, CAST(ceil(v) AS BIGINT) + 1)) AS BIGINT) AS copy_no
FROM agg WHERE ceil(v) > 0""")
def q_replicate(spark, sf):
    a = overlap.overlap_by(automated_flows(spark, sf), ["year"], amount="usd_disbursement")
    a = a.withColumn("usd_disbursement", F.col("usd_disbursement") / 1e6)
    return overlap.replicate(a, "usd_disbursement", block=1000, spread=8)


# --- A18: describe each flag ------------------------------------------------
@register("describe_flags", f"""{W}
""" + "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS flag, count(*) AS n, CAST(sum(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       count(DISTINCT {f}) AS distinct, CAST(coalesce(sum(CAST({f} AS BIGINT)), 0) AS BIGINT) AS n_true,
       round(avg(CAST({f} AS DOUBLE)), 6) AS mean FROM automated""" for f in FLAGS))
def q_describe(spark, sf):
    d = automate.describe_flags(automated_flows(spark, sf), FLAGS)
    return d.select("flag", "n", "missing", "distinct", "n_true", F.round("mean", 6).alias("mean"))


# --- X01 / J01: prediction columns (and the salted join-back) ---------------
PRED_COLS = M.prediction_columns()


def _pred_out(df):
    sel = ["l_orderkey", "l_linenumber"]
    for c in PRED_COLS:
        sel.append(F.round(c, 6).alias(c) if c.endswith("_conf") else F.col(c))
    return df.select(*sel)


PRED_SQL = f"""WITH {TB.FLOWS_SQL.strip()},
preds AS ({_pred_sql_for_keys('flows', FLOW_KEYS, "coalesce(project_title, '')")})
SELECT f.l_orderkey, f.l_linenumber, {', '.join(('round(p.' + c + ', 6) AS ' + c) if c.endswith('_conf') else 'p.' + c for c in PRED_COLS)}
FROM flows f LEFT JOIN preds p ON {' AND '.join(f'f.{k} IS NOT DISTINCT FROM p.{k}' for k in FLOW_KEYS)}"""


@register("predict_activities", PRED_SQL)
def q_predict(spark, sf):
    return _pred_out(predicted_flows(spark, sf))


@register("predict_activities_salted", PRED_SQL)
def q_predict_salted(spark, sf):
    f = TB.flows(spark, sf)
    p = scoring.predict_activities(f, flow_scorers(), flow_lexicons(), text_cols=("project_title",),
                                   round_digits=6, salt=4)
    return _pred_out(p)


@register("predict_activities_inline", PRED_SQL)
def q_predict_inline(spark, sf):
    f = TB.flows(spark, sf)
    p = scoring.predict_activities(f, flow_scorers(), flow_lexicons(), text_cols=("project_title",),
                                   round_digits=6, dedupe=False)
    return _pred_out(p)


# --- X04: automated flags per activity --------------------------------------
@register("automate_activities", f"""{W}
SELECT l_orderkey, l_linenumber, {FLAG_SQL} FROM automated""")
def q_automate(spark, sf):
    return automated_flows(spark, sf).select("l_orderkey", "l_linenumber", *FLAGS)


# --- X02: climate re-scoring of principal-declared rows ---------------------
CLIMATE_PRED = [c for c in PRED_COLS if c.startswith(("adaptation", "mitigation")) or c == "climate_kw"]


def _rescore_ctes():
    from .catalog import SIG_BIAS, PRI_BIAS, flow_model_lexicons
    kw = flow_lexicons()["climate"]
    mdl = flow_model_lexicons()["climate"]
    sel = []
    for t in ("adaptation", "mitigation"):
        for lv in M.LEVELS:
            bias = SIG_BIAS if lv == "sig" else PRI_BIAS
            raw = f"CASE WHEN clean IS NOT NULL THEN round({S.sigmoid(f'{S.hits(S.tokens('clean'), mdl)} - {bias}')}, 6) END"
            sel.append(f"coalesce(({raw}) > 0.5, false) AS {M.pred_col(t, lv)}")
            sel.append(f"CASE WHEN ({raw}) IS NULL OR ({raw}) < 0 THEN 0.0 ELSE ({raw}) END AS {M.conf_col(t, lv)}")
    sel.append(f"{S.match('clean', kw)} AS climate_kw")
    return f"""WITH {TB.FLOWS_SQL.strip()},
sl AS (SELECT * FROM flows WHERE climate_adaptation = 2 OR climate_mitigation = 2),
d AS (SELECT DISTINCT project_title, {S.clean("coalesce(project_title, '')")} AS clean FROM sl),
p AS (SELECT project_title, {', '.join(sel)} FROM d)"""


def _rescore_sql():
    return _rescore_ctes() + f"""
SELECT sl.l_orderkey, sl.l_linenumber, {', '.join(('round(p.' + c + ', 6) AS ' + c) if c.endswith('_conf') else 'p.' + c for c in CLIMATE_PRED)}
FROM sl LEFT JOIN p ON sl.project_title IS NOT DISTINCT FROM p.project_title"""


def rescored_flows(spark, sf):
    from .catalog import SIG_BIAS, PRI_BIAS, flow_model_lexicons
    sc = scoring.lexicon_hit_scorer("climate", flow_model_lexicons()["climate"], SIG_BIAS, PRI_BIAS)
    return scoring.rescore_declared(TB.flows(spark, sf), sc, flow_lexicons()["climate"],
                                    text_cols=("project_title",), round_digits=6)


@register("rescore_declared", _rescore_sql())
def q_rescore(spark, sf):
    r = rescored_flows(spark, sf)
    return r.select("l_orderkey", "l_linenumber",
                    *[F.round(c, 6).alias(c) if c.endswith("_conf") else F.col(c) for c in CLIMATE_PRED])


# --- F16 / F17: disagreement audits -----------------------------------------
@register("audit_disagreements", f"""WITH {TB.FLOWS_SQL.strip()},
preds AS ({_pred_sql_for_keys('flows', FLOW_KEYS, "coalesce(project_title, '')")}),
x AS (SELECT f.l_orderkey, f.l_linenumber, p.* FROM flows f LEFT JOIN preds p ON {' AND '.join(f'f.{k} IS NOT DISTINCT FROM p.{k}' for k in FLOW_KEYS)})
SELECT 'gender' AS audit, count(*) AS n FROM x WHERE gender_pri_conf > 0.6 AND NOT gender_kw
UNION ALL SELECT 'adaptation', count(*) FROM x WHERE adaptation_pri_conf > 0.6 AND NOT climate_kw
UNION ALL SELECT 'mitigation', count(*) FROM x WHERE mitigation_pri_conf > 0.6 AND NOT climate_kw
UNION ALL SELECT 'disability', count(*) FROM x WHERE disability_pri_conf > 0.6 AND NOT disability_kw
UNION ALL SELECT 'match_no_conf', count(*) FROM x WHERE adaptation_pri_conf < 0.4 AND mitigation_pri_conf < 0.4 AND climate_kw""")
def q_audits(spark, sf):
    p = predicted_flows(spark, sf)
    conds = {t: audit.audit_conf_no_match(t, 0.6) for t in ("gender", "adaptation", "mitigation", "disability")}
    conds["match_no_conf"] = audit.audit_match_no_conf(0.4)
    agg = p.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in conds.items()])
    return agg.selectExpr("stack(5, " + ", ".join(f"'{k}', `{k}`" for k in conds) + ") as (audit, n)")


# --- X16: mislabel report on predicted activities ----------------------------
@register("mislabel_report", _rescore_ctes() + f""",
x AS (SELECT DISTINCT CAST(sl.l_orderkey AS VARCHAR) || '-' || CAST(sl.l_linenumber AS VARCHAR) AS crs_id, sl.year,
             sl.donor_name, sl.recipient_name, sl.sector_name, sl.project_title, sl.climate_adaptation, sl.climate_mitigation,
             round(p.adaptation_pri_conf, 6) AS adaptation_pri_conf, round(p.mitigation_pri_conf, 6) AS mitigation_pri_conf, p.climate_kw
      FROM sl LEFT JOIN p ON sl.project_title IS NOT DISTINCT FROM p.project_title
      WHERE NOT coalesce(sl.project_title, '') IN ('', '-', ' ')),
y AS (SELECT * FROM x WHERE crs_id <> '')
SELECT 'adaptation_mislabeled_mitigation' AS report, * FROM y WHERE climate_kw AND climate_adaptation = 0 AND climate_mitigation = 2 AND mitigation_pri_conf < 0.5 AND adaptation_pri_conf > 0.8
UNION ALL SELECT 'mitigation_mislabeled_adaptation', * FROM y WHERE climate_kw AND climate_mitigation = 0 AND climate_adaptation = 2 AND adaptation_pri_conf < 0.5 AND mitigation_pri_conf > 0.8
UNION ALL SELECT 'non_climate_mislabeled', * FROM y WHERE NOT climate_kw AND climate_adaptation = 2 AND climate_mitigation = 2 AND adaptation_pri_conf < 0.5 AND mitigation_pri_conf < 0.5""")
def q_mislabel(spark, sf):
    """X16 on the climate re-scoring of declared-principal rows."""
    p = rescored_flows(spark, sf).withColumn(
        "crs_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    keep = ("crs_id", "year", "donor_name", "recipient_name", "sector_name", "project_title", "climate_adaptation",
            "climate_mitigation", "adaptation_pri_conf", "mitigation_pri_conf", "climate_kw")
    p = p.withColumns({c: F.round(c, 6) for c in ("adaptation_pri_conf", "mitigation_pri_conf")})
    return audit.mislabel_report(p, ("project_title",), keep, confident=0.8, off_theme=0.5)


# --- X17: spending report ----------------------------------------------------
HEALTH = ("SMALL", "MEDIUM")
WINDOW_YEARS = (1996, 2000)
SAME_YEAR = 1998


def _report(spark, sf):
    return spending.spending_report(predicted_flows(spark, sf), HEALTH, WINDOW_YEARS, SAME_YEAR,
                                    text_cols=("project_title",))


GENDER_FLAG_SQL = f"""WITH {TB.FLOWS_SQL.strip()},
preds AS ({_pred_sql_for_keys('flows', FLOW_KEYS, "coalesce(project_title, '')")}),
x AS (SELECT f.*, (coalesce(f.gender = 2, false) OR coalesce((CASE WHEN coalesce(f.project_title, '') IN ('', '-') THEN false ELSE p.gender_pri_pred END) AND p.gender_kw, false)) AS principal_gender,
             coalesce(f.sector_name IN ('SMALL', 'MEDIUM'), false) AS health
      FROM flows f LEFT JOIN preds p ON {' AND '.join(f'f.{k} IS NOT DISTINCT FROM p.{k}' for k in FLOW_KEYS)})"""


@register("gender_sectors", f"""{GENDER_FLAG_SQL}
SELECT sector_name, count(*) AS n FROM x WHERE principal_gender AND sector_name IS NOT NULL GROUP BY ALL""")
def q_gender_sectors(spark, sf):
    return _report(spark, sf)["gender_sectors"]


@register("aid_debt_ratio", f"""{GENDER_FLAG_SQL}
SELECT sector_name, round(coalesce(fsum(usd_disbursement), 0) / nullif(coalesce(CAST(sum(CAST(usd_commitment AS DECIMAL(18,4))) AS DOUBLE), 0), 0), 6) AS aid_debt_ratio
FROM x GROUP BY ALL""")
def q_ratio(spark, sf):
    r = _report(spark, sf)["ratio_all"]
    return r.select("sector_name", F.round("aid_debt_ratio", 6).alias("aid_debt_ratio"))


@register("aid_debt_ratio_same_year", f"""{GENDER_FLAG_SQL}
SELECT sector_name, round(coalesce(fsum(usd_disbursement), 0) / nullif(coalesce(CAST(sum(CAST(usd_commitment AS DECIMAL(18,4))) AS DOUBLE), 0), 0), 6) AS aid_debt_ratio
FROM x WHERE year = commitment_year GROUP BY ALL""")
def q_ratio_same(spark, sf):
    r = _report(spark, sf)["ratio_same_year"]
    return r.select("sector_name", F.round("aid_debt_ratio", 6).alias("aid_debt_ratio"))


def _panel_sql():
    parts = []
    subsets = {"health": "health", "gender": "principal_gender", "gender_health": "principal_gender AND health"}
    periods = {"window": f"commitment_year BETWEEN {WINDOW_YEARS[0]} AND {WINDOW_YEARS[1]}",
               "same_year": f"year = {SAME_YEAR} AND commitment_year = {SAME_YEAR}"}
    for pn, pc in periods.items():
        for sn, sc in subsets.items():
            cond = f"coalesce({pc}, false) AND coalesce({sc}, false)"
            parts.append(f"""SELECT '{pn}' AS period, '{sn}' AS subset,
  coalesce(CAST(sum(CAST(CASE WHEN {cond} THEN usd_disbursement END AS DECIMAL(18,4))) AS DOUBLE), 0) AS disbursed,
  coalesce(CAST(sum(CAST(CASE WHEN {cond} THEN usd_commitment END AS DECIMAL(18,4))) AS DOUBLE), 0) AS committed,
  round(coalesce(CAST(sum(CAST(CASE WHEN {cond} THEN usd_disbursement END AS DECIMAL(18,4))) AS DOUBLE), 0) / nullif(coalesce(CAST(sum(CAST(CASE WHEN {cond} THEN usd_commitment END AS DECIMAL(18,4))) AS DOUBLE), 0), 0), 6) AS ratio
FROM x""")
    return GENDER_FLAG_SQL + "\n" + "\nUNION ALL\n".join(parts)


@register("spend_panel", _panel_sql())
def q_panel(spark, sf):
    p = _report(spark, sf)["panel"]
    return p.select("period", "subset", "disbursed", "committed", F.round("ratio", 6).alias("ratio"))


# --- F01 / F02 / F22 / F24: warehouse slices ---------------------------------
RECIPIENTS = ("NATION_1", "NATION_3", "NATION_5", "NATION_8", "NATION_13", "NATION_21")


@register("warehouse_slice", f"""WITH {TB.FLOWS_SQL.strip()}
SELECT recipient_name, count(*) AS n, {_money()} FROM flows
WHERE year BETWEEN 1996 AND 2000 AND usd_disbursement > 0 AND recipient_name IN ({', '.join(f"'{r}'" for r in RECIPIENTS)})
GROUP BY ALL""")
def q_slice(spark, sf):
    f = TB.flows(spark, sf, years=(1996, 2000))
    c = filters.warehouse_slice(None, (1996, 2000), "usd_disbursement", RECIPIENTS, "recipient_name")
    return f.where(c).groupBy("recipient_name").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(money_sum("usd_disbursement"), F.lit(0.0)).alias(
            "usd_disbursement"))


@register("exclude_regions", f"""WITH {TB.FLOWS_SQL.strip()}
SELECT region_name, count(*) AS n FROM flows
WHERE region_name NOT IN ('AFRICA', 'MIDDLE EAST') AND recipient_name NOT ILIKE '%nation_1%' AND recipient_name NOT ILIKE '%5'
GROUP BY ALL""")
def q_exclude(spark, sf):
    f = TB.flows(spark, sf)
    return f.where(filters.exclude_regions(("AFRICA", "MIDDLE EAST"), ("%nation_1%", "%5"))).groupBy(
        "region_name").agg(F.count(F.lit(1)).alias("n"))


@register("any_theme_total", f"""{W}
SELECT count(*) AS n,
       CASE WHEN count(*) = count(usd_disbursement) THEN fsum(usd_disbursement) END AS total
FROM automated WHERE (principal_gender OR principal_climate OR principal_disability)
  AND commitment_year BETWEEN 1996 AND 2000""")
def q_any_total(spark, sf):
    a = automated_flows(spark, sf).where(filters.any_theme() & filters.commitment_window((1996, 2000)))
    strict = F.when(F.count(F.lit(1)) == F.count("usd_disbursement"), money_sum("usd_disbursement"))
    return a.agg(F.count(F.lit(1)).alias("n"), strict.alias("total"))


# --- F09 + A27: screened partition and funnel --------------------------------
@register("screening_funnel", f"""WITH {TB.FLOWS_SQL.strip()}
SELECT 'all' AS stage, 0 AS step, count(*) AS rows FROM flows
UNION ALL SELECT 'screened', 1, count(*) FROM flows WHERE {S.all_screened()}
UNION ALL SELECT 'needs_scoring', 2, count(*) FROM flows WHERE NOT {S.all_screened()}
UNION ALL SELECT 'needs_scoring_strict', 3, count(*) FROM flows WHERE gender IS NULL OR (climate_adaptation IS NULL AND climate_mitigation IS NULL) OR disability IS NULL
UNION ALL SELECT 'distinct_keys', 4, count(*) FROM (SELECT DISTINCT {', '.join(FLOW_KEYS)} FROM flows WHERE NOT {S.all_screened()})""")
def q_funnel(spark, sf):
    f = TB.flows(spark, sf)
    counted = dedupe.funnel_counts(f, {"all": F.lit(True), "screened": M.all_screened(), "needs_scoring": ~M.all_screened(),
                                       "needs_scoring_strict": M.unscreened_strict()})
    _, needs = filters.partition_screened(f)
    keys = needs.select(*FLOW_KEYS).dropDuplicates().agg(F.count(F.lit(1)).alias("rows"))
    return counted.unionByName(keys.select(F.lit("distinct_keys").alias("stage"), F.lit(4).alias("step"), "rows"))


# --- A25 / W07 / A23 / A24 / A16 / O04 ---------------------------------------
@register("dedupe_first_wins", f"""WITH {TB.FLOWS_SQL.strip()}
SELECT project_title, gender, climate_adaptation, climate_mitigation, disability,
       arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey,
       arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS l_linenumber
FROM flows GROUP BY ALL""")
def q_dedupe(spark, sf):
    f = TB.flows(spark, sf).select(*FLOW_KEYS, "l_orderkey", "l_linenumber")
    return dedupe.dedupe(f, FLOW_KEYS, ["l_orderkey", "l_linenumber"])


@register("distinct_countries", f"""WITH {TB.FLOWS_SQL.strip()}
SELECT DISTINCT value FROM (SELECT donor_name AS value FROM flows UNION ALL SELECT recipient_name FROM flows)""")
def q_distinct_values(spark, sf):
    return dedupe.distinct_values(TB.flows(spark, sf), ["donor_name", "recipient_name"])


@register("distinct_donor_recipient_sector", f"""WITH {TB.FLOWS_SQL.strip()}
SELECT DISTINCT donor_name, recipient_name, sector_name FROM flows""")
def q_distinct_rows(spark, sf):
    return TB.flows(spark, sf).select("donor_name", "recipient_name", "sector_name").distinct()


@register("flow_freq", f"""WITH {TB.FLOWS_SQL.strip()}
SELECT flow_name, count(*) AS n FROM flows WHERE flow_name IS NOT NULL GROUP BY ALL""")
def q_freq(spark, sf):
    return spending.freq(TB.flows(spark, sf), "flow_name")


@register("sample_activities", f"""WITH {TB.FLOWS_SQL.strip()}
SELECT l_orderkey, l_linenumber, project_title FROM flows
ORDER BY md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), l_orderkey, l_linenumber
LIMIT 100""")
def q_sample(spark, sf):
    f = TB.flows(spark, sf).select("l_orderkey", "l_linenumber", "project_title")
    return sample_n(f, 100, 42, ["l_orderkey", "l_linenumber"])


# --- F26 + A26 + O04: labelled evaluation sample (distinct texts, seeded order)
@register("evaluation_sample", f"""WITH {TB.FLOWS_SQL.strip()},
d AS (SELECT DISTINCT gender, project_title FROM flows WHERE gender IS NOT NULL AND year = 1998)
SELECT gender, project_title FROM d
ORDER BY md5(concat_ws('|', '7', coalesce(CAST(gender AS VARCHAR), ''), coalesce(project_title, ''))), gender, project_title
LIMIT 20""")
def q_eval_sample(spark, sf):
    f = TB.flows(spark, sf).where(filters.labelled_year("gender", 1998)).select("gender", "project_title").distinct()
    return sample_n(f, 20, 7, ["gender", "project_title"])
