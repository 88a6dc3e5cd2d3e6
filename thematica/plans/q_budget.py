"""Budget-sheet queries: ordered fills on a stacked sheet, the three sheet
normalisers and the cross-country budget comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markers as M
from ..operators import automate, budgets, overlap, scoring
from ..sources import tables as TB
from . import sqlkit as S
from .catalog import flow_lexicons, flow_model_lexicons, register

# stand-in budget model: one model word in a line is a principal signal
BUDGET_BIAS = (0.0, 0.5)


def budget_scorers():
    return {g: scoring.lexicon_hit_scorer(g, lex, *BUDGET_BIAS) for g, lex in flow_model_lexicons().items()}

SH = f"WITH {TB.SHEET_SQL.strip()}"


# --- W01 / W02 ------------------------------------------------------------------
def _fill_q(fn, col):
    def q(spark, sf):
        s = TB.sheet(spark, sf)
        return fn(s, col, "block", "row_ord", out=f"{col}_filled").select(
            "block", "row_ord", f"{col}_filled")
    return q


DOWN_SQL = f"""{SH}
SELECT block, row_ord, last_value(header IGNORE NULLS) OVER (PARTITION BY block ORDER BY row_ord
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header_filled FROM sheet"""
UP_SQL = f"""{SH}
SELECT block, row_ord, first_value(footer IGNORE NULLS) OVER (PARTITION BY block ORDER BY row_ord
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS footer_filled FROM sheet"""
register("fill_down", DOWN_SQL)(_fill_q(budgets.fill_down, "header"))
register("fill_up", UP_SQL)(_fill_q(budgets.fill_up, "footer"))


# --- X06 Kenya: footer rows name the vote of the block above ------------------
def ke_sheet(spark, sf):
    c = TB.load(spark, sf, "conversations")
    program = (F.when(F.col("turn") % 3 == 2, F.concat(F.lit("Total Expenditure for Vote "), F.col("text")))
               .when((F.col("role") == "user") & (F.col("turn") == 0), F.lit("Programme"))
               .otherwise(F.concat(F.col("text"), F.lit("_x000D_"))))
    value = F.when(F.col("role") == "assistant", F.length("text").cast("string")).otherwise(F.lit("n/a"))
    return c.select(F.col("conv_id").alias("sheet"), F.col("turn").alias("row_ord"), program.alias("program"),
                    value.alias("value"), (F.lit(2018) + F.col("conv_id") % 5).cast("string").alias("year"))


KE_SQL = """WITH ke AS (
  SELECT conv_id AS sheet, turn AS row_ord,
         CASE WHEN turn % 3 = 2 THEN 'Total Expenditure for Vote ' || text
              WHEN role = 'user' AND turn = 0 THEN 'Programme' ELSE text || '_x000D_' END AS program,
         CASE WHEN role = 'assistant' THEN CAST(length(text) AS VARCHAR) ELSE 'n/a' END AS value,
         CAST(2018 + conv_id % 5 AS VARCHAR) AS year
  FROM conversations),
k1 AS (SELECT *, replace(replace(replace(CASE WHEN starts_with(program, 'Total Expenditure for Vote') THEN program END,
                 'Total Expenditure for Vote ', ''), '_x005F', ''), '_x000D_', ' ') AS vote0,
              replace(replace(program, '_x005F', ''), '_x000D_', ' ') AS program1
       FROM ke WHERE program IS NOT NULL AND program <> 'Programme'),
k2 AS (SELECT *, first_value(vote0 IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_ord
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vote FROM k1)
SELECT sheet, row_ord, program1 AS program, TRY_CAST(value AS DOUBLE) AS value, vote, year,
       concat_ws(' ', coalesce(vote, 'NA'), coalesce(program1, 'NA')) AS text
FROM k2 WHERE vote IS NOT NULL AND NOT starts_with(program1, 'Total Expenditure for Vote')"""


@register("clean_budget_ke", KE_SQL)
def q_ke(spark, sf):
    out = budgets.clean_budget_ke(ke_sheet(spark, sf))
    return out.select("sheet", "row_ord", "program", "value", "vote", "year", "text")


# --- X06 Ethiopia: code columns mark the hierarchy level of a row --------------
def et_sheet(spark, sf):
    c = TB.load(spark, sf, "conversations")
    role, turn, cid = F.col("role"), F.col("turn"), F.col("conv_id")
    return c.select(
        (F.lit(2011) + cid % 5).alias("year"),
        F.when(cid % 2 == 0, F.lit("recurrent")).otherwise(F.lit("capital")).alias("type"),
        (cid * 10000 + turn).alias("row_ord"),
        F.col("text").alias("description"),
        F.when(turn == 0, cid.cast("string")).alias("public_body_code"),
        F.when(role == "user", turn.cast("string")).alias("program_code"),
        F.when(role == "assistant", turn.cast("string")).alias("activity_code"),
        F.when(role == "system", turn.cast("string")).alias("sub_program_code"),
        F.when((role == "assistant") & (turn % 4 == 1), turn.cast("string")).alias("project_code"),
        F.length("text").cast("double").alias("treasury"),
        turn.cast("double").alias("retained"),
        F.lit(None).cast("double").alias("assistance"),
        F.lit(None).cast("double").alias("loan"),
        (F.length("text") + turn).cast("double").alias("total"))


def _et_sql():
    levels = [("project_code", "project_name"), ("sub_program_code", "sub_program_name"),
              ("activity_code", "activity_name"), ("program_code", "program_name"),
              ("public_body_code", "public_body_name")]
    fills = ",\n       ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN description END IGNORE NULLS) OVER w AS {n}" for c, n in levels)
    return f"""WITH et AS (
  SELECT 2011 + conv_id % 5 AS year, CASE WHEN conv_id % 2 = 0 THEN 'recurrent' ELSE 'capital' END AS type,
         conv_id * 10000 + turn AS row_ord, text AS description,
         CASE WHEN turn = 0 THEN CAST(conv_id AS VARCHAR) END AS public_body_code,
         CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END AS program_code,
         CASE WHEN role = 'assistant' THEN CAST(turn AS VARCHAR) END AS activity_code,
         CASE WHEN role = 'system' THEN CAST(turn AS VARCHAR) END AS sub_program_code,
         CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN CAST(turn AS VARCHAR) END AS project_code,
         CAST(length(text) AS DOUBLE) AS treasury, CAST(turn AS DOUBLE) AS retained,
         CAST(NULL AS DOUBLE) AS assistance, CAST(NULL AS DOUBLE) AS loan, CAST(length(text) + turn AS DOUBLE) AS total
  FROM conversations),
f AS (SELECT *, {fills}
      FROM et WINDOW w AS (PARTITION BY year, type ORDER BY row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT year, type, public_body_name, program_name, activity_name, sub_program_name, project_name,
       concat_ws(' ', public_body_name, program_name, activity_name, sub_program_name, project_name) AS text,
       treasury, retained, assistance, loan, total
FROM f WHERE (type = 'recurrent' AND activity_code IS NOT NULL) OR (type = 'capital' AND project_code IS NOT NULL)"""


@register("clean_budget_et", _et_sql())
def q_et(spark, sf):
    return budgets.clean_budget_et(et_sheet(spark, sf))


# --- X06 Uganda: five text columns pasted with NA -------------------------------
@register("clean_budget_ug", """SELECT conv_id, turn,
  concat_ws(' ', coalesce(role, 'NA'), coalesce(CAST(conv_id AS VARCHAR), 'NA'),
            coalesce(CASE WHEN role = 'system' THEN 'sub' END, 'NA'), coalesce(text, 'NA'),
            coalesce(CAST(turn AS VARCHAR), 'NA')) AS text
FROM conversations""")
def q_ug(spark, sf):
    c = TB.load(spark, sf, "conversations")
    ug = c.select("conv_id", "turn", F.col("role").alias("Vote"), F.col("conv_id").cast("string").alias("Programme"),
                  F.when(F.col("role") == "system", F.lit("sub")).alias("SubProgramme"),
                  F.col("text").alias("KeyOutputDescription"),
                  F.col("turn").cast("string").alias("Description"), F.lit(True).alias("Gender"))
    return budgets.clean_budget_ug(ug).select("conv_id", "turn", "text")


# --- X03 + X05 + X07: budget comparison by value and by count -----------------
def automated_budgets(spark, sf):
    b = TB.budgets(spark, sf)
    p = scoring.predict_budget(b, budget_scorers(), flow_lexicons(), "text", round_digits=6)
    return automate.automate_budget(p, "text")


def _budget_flags_sql() -> str:
    kw = flow_lexicons()
    mdl = flow_model_lexicons()
    sel = []
    for g in M.GROUPS:
        sel.append(f"{S.match('clean', kw[g])} AS {g}_kw")
        sel.append(f"CASE WHEN clean IS NOT NULL THEN {S.hits(S.tokens('clean'), mdl[g])} END AS {g}_h")
    preds = []
    for t in M.THEMES:
        raw = f"round({S.sigmoid(f'{t.group}_h - {BUDGET_BIAS[1]}')}, 6)"
        preds.append(f"(NOT coalesce(text, '') IN ('', '-') AND coalesce({raw} > 0.5, false)) AS {t.key}_pri_pred")
    flags = {t.key: f"coalesce({t.key}_pri_pred AND {t.lexicon}_kw, false)" for t in M.THEMES}
    return f"""WITH {TB.FLOWS_SQL.strip()},
budgets AS (
  SELECT region_name AS country, year, concat_ws(' ', CAST(l_orderkey AS VARCHAR), project_title) AS program,
         project_title AS text, usd_commitment AS amount,
         CASE WHEN l_linenumber % 2 = 0 THEN usd_disbursement END AS approved
  FROM flows),
d AS (SELECT DISTINCT text, {S.clean("coalesce(text, '')")} AS clean FROM budgets),
p0 AS (SELECT text, {', '.join(sel)} FROM d),
p AS (SELECT text, gender_kw, climate_kw, disability_kw, {', '.join(preds)} FROM p0),
automated AS (
  SELECT b.*, {flags['gender']} AS principal_gender, ({flags['adaptation']} OR {flags['mitigation']}) AS principal_climate,
         {flags['disability']} AS principal_disability
  FROM budgets b LEFT JOIN p ON b.text IS NOT DISTINCT FROM p.text)"""


LABEL_SQL = """CASE WHEN principal_disability THEN 'Disability' WHEN principal_climate THEN 'Climate change'
                    WHEN principal_gender THEN 'Gender' ELSE '' END"""
FLAGS = "principal_gender, principal_climate, principal_disability"


@register("budget_value", f"""{_budget_flags_sql()},
g AS (SELECT country, {FLAGS},
             coalesce({S.money_sum('amount')}, 0) + coalesce({S.money_sum('approved')}, 0) AS value
      FROM automated GROUP BY ALL),
s AS (SELECT *, sum(value) OVER (PARTITION BY country) AS total FROM g)
SELECT country, {FLAGS}, round(value, 2) AS value, round(total, 2) AS total, round(value / total, 6) AS percentage,
       {LABEL_SQL} AS label
FROM s WHERE {LABEL_SQL} <> ''""")
def q_budget_value(spark, sf):
    c = budgets.compare_budgets(automated_budgets(spark, sf), "value", ("amount", "approved"))
    return c.select("country", *budgets.FLAGS, F.round("value", 2).alias("value"), F.round("total", 2).alias("total"),
                    F.round("percentage", 6).alias("percentage"), "label")


@register("budget_count", f"""{_budget_flags_sql()},
g AS (SELECT country, {FLAGS}, count(*) AS value FROM automated GROUP BY ALL),
s AS (SELECT *, sum(value) OVER (PARTITION BY country) AS total FROM g)
SELECT country, {FLAGS}, value, CAST(total AS BIGINT) AS total, round(value / total, 6) AS percentage, {LABEL_SQL} AS label
FROM s WHERE {LABEL_SQL} <> ''""")
def q_budget_count(spark, sf):
    c = budgets.compare_budgets(automated_budgets(spark, sf), "count")
    return c.select("country", *budgets.FLAGS, "value", F.col("total").cast("bigint").alias("total"),
                    F.round("percentage", 6).alias("percentage"), "label")


@register("budget_count_complete", f"""{_budget_flags_sql()},
l AS (SELECT country, {LABEL_SQL} AS label FROM automated),
c AS (SELECT country, label, count(*) AS value FROM l WHERE label <> '' GROUP BY ALL),
grid AS (SELECT DISTINCT country, lab AS label FROM c, (SELECT unnest(['Gender', 'Climate change', 'Disability']) AS lab))
SELECT g.country, g.label, coalesce(c.value, 0) AS value FROM grid g LEFT JOIN c USING (country, label)""")
def q_budget_complete(spark, sf):
    a = automated_budgets(spark, sf)
    lab = budgets.label_groups(a)
    cnt = lab.groupBy("country", "label").agg(F.count(F.lit(1)).alias("value"))
    return overlap.complete(cnt, "country", "label", ("Gender", "Climate change", "Disability"), "value", 0)


@register("budget_max_by_label", f"""{_budget_flags_sql()},
g AS (SELECT country, {FLAGS}, count(*) AS value FROM automated GROUP BY ALL),
l AS (SELECT *, {LABEL_SQL} AS label FROM g)
SELECT label, max(value) AS max_value FROM l WHERE label <> '' GROUP BY label""")
def q_budget_max(spark, sf):
    agg = budgets.budget_count(automated_budgets(spark, sf))
    return budgets.max_by_label(budgets.label_groups(agg))


@register("drop_aggregate_lines", f"""WITH {TB.FLOWS_SQL.strip()},
b AS (SELECT region_name AS country, concat_ws(' ', CAST(l_orderkey AS VARCHAR), project_title) AS program FROM flows)
SELECT country, count(*) AS n FROM b WHERE NOT coalesce(ends_with(string_split(program, ' ')[1], '000'), false)
GROUP BY country""")
def q_drop_agg(spark, sf):
    b = budgets.drop_aggregate_lines(TB.budgets(spark, sf), "program")
    return b.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
