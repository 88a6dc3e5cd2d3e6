"""Query catalog: each registered query is a Spark job over the driver tables
(``fn(spark, sf_dir) -> DataFrame``) plus, when SQL can express it, the
equivalent DuckDB SQL over the same tables (the correctness oracle).

Doubles are rounded on both sides (money to 2 places, scores to 6) because
distributed sums add in a different order than a single-threaded engine.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions.lexicon import Lexicon, shipped
from ..operators import automate, overlap, scoring
from ..sources import tables as TB
from . import sqlkit as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# flows: lexicons and scorers used by the activity queries
# ---------------------------------------------------------------------------
# FIXED VALUES: stand-in model vocabularies for the part-name texts of flows.
FLOW_MODEL_WORDS = {
    "gender": ("red", "blue", "new"),
    "climate": ("hot", "cold", "old", "large"),
    "disability": ("gizmo", "anvil", "rod"),
}
SIG_BIAS, PRI_BIAS = 0.5, 1.5


def flow_lexicons() -> dict:
    return {g: Lexicon(g, w) for g, w in TB.FLOW_LEXICONS.items()}


def flow_model_lexicons() -> dict:
    return {g: Lexicon(f"{g}_model", w) for g, w in FLOW_MODEL_WORDS.items()}


def flow_scorers() -> dict:
    return {g: scoring.lexicon_hit_scorer(g, lex, SIG_BIAS, PRI_BIAS) for g, lex in flow_model_lexicons().items()}


def predicted_flows(spark, sf_dir) -> DataFrame:
    f = TB.flows(spark, sf_dir)
    return scoring.predict_activities(f, flow_scorers(), flow_lexicons(), text_cols=("project_title",),
                                      round_digits=6, key_source=TB.flow_keys(spark, sf_dir))


def automated_flows(spark, sf_dir) -> DataFrame:
    return automate.automate_activities(predicted_flows(spark, sf_dir), text_cols=("project_title",))


# --- the same pipeline in SQL ------------------------------------------------

def _pred_sql_for_keys(src: str, keys: list, text_expr: str) -> str:
    """Per distinct key: cleaned text, keyword matches, seeded chunk-max scores.

    Texts in these views are shorter than one chunk, so the chunk maximum is
    the whole-text score.
    """
    kw = flow_lexicons()
    mdl = flow_model_lexicons()
    cols = ", ".join(keys)
    sel = [f"{cols}"]
    for g in M.GROUPS:
        sel.append(f"{S.match('clean', kw[g])} AS {g}_kw")
        sel.append(f"CASE WHEN clean IS NOT NULL AND NOT {S.screened(g)} THEN {S.hits(S.tokens('clean'), mdl[g])} END AS {g}_hits")
    body = [f"{cols}"] + [f"{g}_kw" for g in M.GROUPS]
    for t in M.THEMES:
        for lv in M.LEVELS:
            k = 1 if lv == "sig" else 2
            bias = SIG_BIAS if lv == "sig" else PRI_BIAS
            raw = f"round({S.sigmoid(f'{t.group}_hits - {bias}')}, 6)"
            seed = f"coalesce({t.marker} = {k}, false)"
            body.append(f"({seed} OR coalesce({raw} > 0.5, false)) AS {M.pred_col(t.key, lv)}")
            body.append(f"CASE WHEN {raw} IS NULL OR (CASE WHEN {seed} THEN 1.0 ELSE 0.0 END) > {raw} "
                        f"THEN (CASE WHEN {seed} THEN 1.0 ELSE 0.0 END) ELSE {raw} END AS {M.conf_col(t.key, lv)}")
    return (f"SELECT {', '.join(body)} FROM (SELECT {', '.join(sel)} FROM "
            f"(SELECT DISTINCT {cols}, {S.clean(text_expr)} AS clean FROM {src} WHERE NOT {S.all_screened()}) d0) d1")


FLOW_KEYS = ["project_title", "gender", "climate_adaptation", "climate_mitigation", "disability"]


def _flags_sql(pred_alias: str = "p") -> str:
    supp = shipped()["supplemental_disability"]
    supp_match = S.match(S.clean_r("coalesce(f.project_title, '')"), supp)
    dis_kw = f"(coalesce({pred_alias}.disability_kw, false) OR {supp_match})"
    blank = "coalesce(f.project_title, '') IN ('', '-')"

    def pred(theme, lv):
        return f"(CASE WHEN {blank} THEN false ELSE {pred_alias}.{M.pred_col(theme, lv)} END)"

    def flag(theme, marker, kwexpr):
        return f"(coalesce(f.{marker} = 2, false) OR coalesce({pred(theme, 'pri')} AND {kwexpr}, false))"

    g = flag("gender", "gender", f"{pred_alias}.gender_kw")
    a = flag("adaptation", "climate_adaptation", f"{pred_alias}.climate_kw")
    m = flag("mitigation", "climate_mitigation", f"{pred_alias}.climate_kw")
    d = flag("disability", "disability", dis_kw)
    return f"{g} AS principal_gender, ({a} OR {m}) AS principal_climate, {d} AS principal_disability"


def _join_keys(a: str, b: str, keys) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


AUTOMATED_FLOWS_SQL = f"""
{TB.FLOWS_SQL.strip()},
preds AS ({_pred_sql_for_keys('flows', FLOW_KEYS, "coalesce(project_title, '')")}),
automated AS (
  SELECT f.*, {_flags_sql('p')}
  FROM flows f LEFT JOIN preds p ON {_join_keys('f', 'p', FLOW_KEYS)}
)"""


# ---------------------------------------------------------------------------
# A01 flagship: flags -> amount by year x flag combination
# ---------------------------------------------------------------------------

def q_overlap_year(spark, sf_dir):
    return overlap.overlap_by(automated_flows(spark, sf_dir), ["year"], amount="usd_disbursement")


register("overlap_by_year", f"""WITH {AUTOMATED_FLOWS_SQL.strip()}
SELECT year, principal_gender, principal_climate, principal_disability,
       coalesce(CAST(sum(CAST(usd_disbursement AS DECIMAL(18,4))) AS DOUBLE), 0) AS usd_disbursement
FROM automated GROUP BY ALL""")(q_overlap_year)
