"""Text, scoring and curation queries over ``documents`` (+ ``labels``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import text as T
from ..functions.lexicon import Lexicon, normalise_word
from ..operators import audit, curate, keywords, scoring
from ..operators import dedupe as D
from ..operators import filters as FL
from ..sources import tables as TB
from . import sqlkit as S
from .catalog import register

DOC_MATCH = Lexicon("doc_match", TB.DOC_MATCH_WORDS)
# FIXED VALUES: per-theme stand-in model words for documents
DOC_GROUP_WORDS = {"gender": ("thble", "erin", "the"), "climate": ("anea", "thor", "and"),
                   "disability": ("eron", "thly", "of")}
DOC_BIAS = (1.5, 2.5)


def _docs(spark, sf):
    return TB.load(spark, sf, "documents")


# --- T01 / T02 / T09 / T06 ----------------------------------------------------
@register("clean_text", f"SELECT doc_id, {S.clean('text')} AS clean FROM documents")
def q_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text("text").alias("clean"))


@register("clean_text_r", f"SELECT doc_id, {S.clean_r('text')} AS clean FROM documents")
def q_clean_r(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text_r("text").alias("clean"))


@register("text_stats", f"""SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, ' ', '')) AS spaces,
  string_split(text, ' ')[1] AS first_token, (length(text) > 10 AND length(text) - length(replace(text, ' ', '')) < 500) AS fits,
  (text IS NOT NULL AND text <> '' AND length(text) > 10) AS usable
FROM documents""")
def q_stats(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", T.char_length("text").alias("n_chars"), T.space_count("text").alias("spaces"),
        T.first_token("text").alias("first_token"), FL.fits_context("text").alias("fits"),
        FL.usable_text("text").alias("usable"))


# --- T04 / T05: lexicon matches --------------------------------------------
EXTRA = Lexicon("extra", ("thly", "ou en"))


@register("keyword_match", f"""SELECT doc_id, {S.match(S.clean('text'), DOC_MATCH)} AS match,
  ({S.match(S.clean('text'), DOC_MATCH)} OR {S.match(S.clean('text'), EXTRA)}) AS extended
FROM documents""")
def q_kw(spark, sf):
    from ..functions.lexicon import extend_match
    c = T.clean_text("text")
    return _docs(spark, sf).select("doc_id", DOC_MATCH.match(c).alias("match"),
                                   extend_match(DOC_MATCH.match(c), c, EXTRA).alias("extended"))


# --- T12: balanced chunks ----------------------------------------------------
CHUNK = 512
CHUNK_SQL = f"""c0 AS (SELECT doc_id, string_split({S.clean('text')}, ' ') AS tok FROM documents),
c1 AS (SELECT doc_id, tok, len(tok) AS L FROM c0 WHERE tok IS NOT NULL),
c2 AS (SELECT doc_id, tok, L, CAST(ceil(L / ceil(L / {CHUNK}.0)) AS BIGINT) AS sz FROM c1 WHERE L > 0),
chunks AS (SELECT doc_id, CAST(st / sz AS INTEGER) AS chunk_no, list_slice(tok, st + 1, st + sz) AS c
           FROM (SELECT doc_id, tok, sz, unnest(range(0, L, sz)) AS st FROM c2))"""


@register("chunk_tokens", f"""WITH {CHUNK_SQL}
SELECT doc_id, chunk_no, len(c) AS n_tokens, c[1] AS first_token, c[len(c)] AS last_token FROM chunks""")
def q_chunks(spark, sf):
    x = scoring.explode_chunks(_docs(spark, sf).withColumn("_c", T.clean_text("text")), "_c", CHUNK)
    tok = F.split("chunk_text", " ")
    return x.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.size(tok).alias("n_tokens"),
                    F.element_at(tok, 1).alias("first_token"), F.element_at(tok, -1).alias("last_token"))


# --- X03 / C01 / A32: scoring long documents in chunks ---------------------
def doc_scorers():
    return {g: scoring.lexicon_hit_scorer(g, Lexicon(g, w), *DOC_BIAS) for g, w in DOC_GROUP_WORDS.items()}


def doc_lexicons():
    return {"gender": DOC_MATCH, "climate": Lexicon("c", ("thor", "eron")), "disability": Lexicon("d", ("thly",))}


def _doc_pred_sql():
    lx = doc_lexicons()
    sel = []
    for g in M.GROUPS:
        words = S.lit_list(DOC_GROUP_WORDS[g])
        sel.append(f"list_max(list_transform(chunks, lambda c: len(list_distinct(list_intersect(c, {words}))))) AS {g}_h")
        sel.append(f"{S.match('clean', lx[g])} AS {g}_kw")
    out = ["doc_id"]
    for t in M.THEMES:
        for lv in M.LEVELS:
            b = DOC_BIAS[0] if lv == "sig" else DOC_BIAS[1]
            raw = f"round({S.sigmoid(f'{t.group}_h - {b}')}, 6)"
            out.append(f"coalesce({raw} > 0.5, false) AS {M.pred_col(t.key, lv)}")
            out.append(f"coalesce({raw}, 0.0) AS {M.conf_col(t.key, lv)}")
    out += [f"{g}_kw" for g in M.GROUPS]
    return f"""WITH d0 AS (SELECT doc_id, text, {S.clean("coalesce(text, '')")} AS clean FROM documents),
d1 AS (SELECT doc_id, clean, string_split(clean, ' ') AS tok FROM d0),
d2 AS (SELECT *, CASE WHEN len(tok) > 0 THEN CAST(ceil(len(tok) / ceil(len(tok) / {CHUNK}.0)) AS BIGINT) END AS sz FROM d1),
d3 AS (SELECT doc_id, clean, CASE WHEN sz IS NULL THEN [] ELSE list_transform(range(0, len(tok), sz), lambda st: list_slice(tok, st + 1, st + sz)) END AS chunks FROM d2),
d4 AS (SELECT doc_id, {', '.join(sel)} FROM d3)
SELECT {', '.join(out)} FROM d4"""


def _pred_cols():
    return [c for c in M.prediction_columns()]


@register("predict_documents", _doc_pred_sql())
def q_predict_docs(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    p = scoring.predict_budget(d, doc_scorers(), doc_lexicons(), "text", round_digits=6)
    return p.select("doc_id", *[F.round(c, 6).alias(c) if c.endswith("_conf") else F.col(c) for c in _pred_cols()])


def _model_scorer(group):
    """A user model in Python: distinct model words of a chunk, as the expression scorer counts them."""
    words = frozenset(Lexicon(group, DOC_GROUP_WORDS[group]).single)
    expr = doc_scorers()[group]

    def load():
        return words

    def predict(model, texts, biases=tuple(expr.biases)):
        import numpy as np

        hits = np.array([len(set(t.split(" ")) & model) for t in texts], dtype=float)
        return np.stack([1 / (1 + np.exp(-(hits - b))) for b in biases], axis=1)

    return scoring.PandasScorer(group, expr.labels, load, predict)


@register("predict_documents_model", _doc_pred_sql())
def q_predict_docs_model(spark, sf):
    """C01 with user models (``PandasScorer``) for all themes."""
    d = _docs(spark, sf).select("doc_id", "text")
    p = scoring.predict_budget(d, {g: _model_scorer(g) for g in doc_scorers()}, doc_lexicons(), "text", round_digits=6)
    return p.select("doc_id", *[F.round(c, 6).alias(c) if c.endswith("_conf") else F.col(c) for c in _pred_cols()])


@register("reduce_chunks", f"""WITH {CHUNK_SQL},
h AS (SELECT doc_id, len(list_distinct(list_intersect(c, {S.lit_list(DOC_GROUP_WORDS['gender'])}))) AS hits FROM chunks),
s AS (SELECT doc_id, round({S.sigmoid(f'hits - {DOC_BIAS[0]}')}, 6) AS sc, round({S.sigmoid(f'hits - {DOC_BIAS[1]}')}, 6) AS pc FROM h)
SELECT doc_id, bool_or(sc > 0.5) AS gender_sig_pred, max(sc) AS gender_sig_conf,
       bool_or(pc > 0.5) AS gender_pri_pred, max(pc) AS gender_pri_conf
FROM s GROUP BY doc_id""")
def q_reduce_chunks(spark, sf):
    """T12 as rows -> per-chunk scores -> A32 reduction."""
    lex = Lexicon("g", DOC_GROUP_WORDS["gender"])
    x = scoring.explode_chunks(_docs(spark, sf).withColumn("_c", T.clean_text("text")), "_c", CHUNK)
    h = lex.hits(F.split("chunk_text", " "))
    sc = F.round(T.sigmoid(h - F.lit(DOC_BIAS[0])), 6)
    pc = F.round(T.sigmoid(h - F.lit(DOC_BIAS[1])), 6)
    x = x.select("doc_id", (sc > 0.5).alias("gender_sig_pred"), sc.alias("gender_sig_conf"),
                 (pc > 0.5).alias("gender_pri_pred"), pc.alias("gender_pri_conf"))
    return scoring.reduce_chunks(x, "doc_id", [("gender", "sig"), ("gender", "pri")])


# --- C05: two scorers on the same rows ---------------------------------------
@register("compare_scorers", f"""WITH {CHUNK_SQL},
h AS (SELECT doc_id, max(len(list_distinct(list_intersect(c, {S.lit_list(DOC_GROUP_WORDS['gender'])})))) AS hits FROM chunks GROUP BY doc_id),
x AS (SELECT doc_id, {S.sigmoid('hits - 1.5')} AS a_s, {S.sigmoid('hits - 2.5')} AS a_p,
             {S.sigmoid('2 * hits - 3')} AS b_s, {S.sigmoid('2 * hits - 5')} AS b_p FROM h)
SELECT doc_id, round(a_s, 6) AS a_gender_sig, round(b_s, 6) AS b_gender_sig, round(b_s - a_s, 6) AS diff_gender_sig,
       round(a_p, 6) AS a_gender_pri, round(b_p, 6) AS b_gender_pri, round(b_p - a_p, 6) AS diff_gender_pri FROM x""")
def q_compare(spark, sf):
    lex = Lexicon("g", DOC_GROUP_WORDS["gender"])
    a = scoring.lexicon_hit_scorer("gender", lex, 1.5, 2.5)
    b = scoring.LexiconHitScorer("gender", a.labels, lex, (3.0, 5.0), 2.0)
    x = scoring.compare_scorers(_docs(spark, sf).select("doc_id", "text"), a, b, "text", CHUNK)
    x = x.where(F.col("a_gender_sig").isNotNull())
    cols = ["a_gender_sig", "b_gender_sig", "diff_gender_sig", "a_gender_pri", "b_gender_pri", "diff_gender_pri"]
    return x.select("doc_id", *[F.round(c, 6).alias(c) for c in cols])


# --- W03 / W04: near-duplicates in text order ---------------------------------
# DuckDB measures edit distance in bytes: the oracle first gives every accented
# letter of the tables a one-byte stand-in that no text holds
ACCENTED = "ÀÁÂÄÇÈÉÊÍÑÓÖÚÜßàáäçèéêíñóöúü"
STAND_INS = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32), 127][:len(ACCENTED)])


def one_byte(expr: str) -> str:
    return f"translate({expr}, '{ACCENTED}', {STAND_INS})"


NEAR_SRC = """SELECT doc_id, text FROM documents
WHERE length(text) > 10 AND length(text) - length(replace(text, ' ', '')) < 500"""


@register("near_duplicates", f"""WITH src AS ({NEAR_SRC}),
o AS (SELECT doc_id, text, lead(text) OVER (ORDER BY text, doc_id) AS nxt FROM src)
SELECT doc_id FROM o WHERE nxt IS NULL OR levenshtein({one_byte('text')}, {one_byte('nxt')}) / length(text) >= 0.2""")
def q_near(spark, sf):
    d = TB.load(spark, sf, "documents", dealt=False).where(FL.fits_context("text")).select("doc_id", "text")
    return curate.drop_near_dups(d, "text", "doc_id", 0.2, keep_last=True).select("doc_id")


# --- X08 / A20 / A19 / A21 / F21 on scored records ---------------------------
def _scored_str(spark, sf):
    s = TB.scored(spark, sf)
    return s.select("doc_id", "text", "sig", F.when(F.col("match"), "True").otherwise("False").alias("match"),
                    F.when(F.col("sig_pred"), "True").otherwise("False").alias("sig_pred"), "sig_conf",
                    F.when(F.col("pri_pred"), "True").otherwise("False").alias("pri_pred"), "pri_conf")


SC = f"WITH {TB.RECORDS_SQL.strip()},\n{TB.SCORED_SQL.strip()}"
PRE_X08 = f"""{SC},
pre AS (SELECT doc_id, text, sig, CASE WHEN match THEN 'True' ELSE 'False' END AS match,
               CASE WHEN sig_pred THEN 'True' ELSE 'False' END AS sig_pred, sig_conf,
               CASE WHEN pri_pred THEN 'True' ELSE 'False' END AS pri_pred, pri_conf FROM scored),
f AS (SELECT * FROM pre WHERE (match = 'True' OR sig = 0) AND NOT (match = 'True' AND sig = 0)
        AND length(text) > 10 AND length(text) - length(replace(text, ' ', '')) < 500),
q AS (SELECT quantile_cont(pri_conf, [0.01, 0.1, 0.5, 0.9, 0.99]) AS p, quantile_cont(sig_conf, [0.01, 0.1, 0.5, 0.9, 0.99]) AS s FROM f)"""


@register("curate_quantile", f"""{PRE_X08}
SELECT text, CASE WHEN sig = 2 THEN 'Principal gender equality objective' WHEN sig = 1 THEN 'Significant gender equality objective'
                  ELSE 'No gender equality objective' END AS label
FROM f, q WHERE
  coalesce(pri_conf >= p[5] AND sig_conf <= s[3] AND sig = 2, false)
  OR coalesce(sig_conf >= s[4] AND pri_conf <= p[3] AND sig = 1, false)
  OR coalesce(sig = 1 AND NOT sig_pred = 'True' AND sig_conf <= s[3], false)
  OR coalesce(sig = 2 AND NOT pri_pred = 'True' AND pri_conf <= p[3], false)
  OR coalesce(NOT sig = 1 AND sig_pred = 'True' AND sig_conf >= s[5], false)
  OR coalesce(NOT sig = 2 AND pri_pred = 'True' AND pri_conf >= p[5], false)
  OR coalesce(sig = 0 AND sig_conf <= s[2] AND pri_conf <= p[2], false)""")
def q_curate_quantile(spark, sf):
    return curate.curate_quantile(_scored_str(spark, sf))


@register("percentiles", f"""{SC}
SELECT p_no, prob, round(sig_conf_q, 6) AS sig_conf, round(pri_conf_q, 6) AS pri_conf FROM (
  SELECT unnest(range(0, 5)) AS p_no, unnest([0.01, 0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS prob,
         unnest(quantile_cont(sig_conf, [0.01, 0.1, 0.5, 0.9, 0.99])) AS sig_conf_q,
         unnest(quantile_cont(pri_conf, [0.01, 0.1, 0.5, 0.9, 0.99])) AS pri_conf_q FROM scored)""")
def q_percentiles(spark, sf):
    p = curate.percentiles(TB.scored(spark, sf), ["sig_conf", "pri_conf"])
    return p.select(F.col("p_no").cast("bigint").alias("p_no"), "prob", F.round("sig_conf", 6).alias("sig_conf"),
                    F.round("pri_conf", 6).alias("pri_conf"))


@register("percentiles_approx", f"""{SC},
r AS (SELECT 'sig_conf' AS name, sig_conf AS v FROM scored UNION ALL SELECT 'pri_conf', pri_conf FROM scored),
o AS (SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY v) AS k, count(*) OVER (PARTITION BY name) AS n
      FROM r WHERE v IS NOT NULL),
p AS (SELECT unnest(range(0, 5)) AS p_no, unnest([0.01, 0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS prob)
SELECT CAST(p_no AS BIGINT) AS p_no, prob, round(max(v) FILTER (name = 'sig_conf'), 6) AS sig_conf,
       round(max(v) FILTER (name = 'pri_conf'), 6) AS pri_conf
FROM p JOIN o ON k = greatest(1, ceil(round(prob * n, 6))) GROUP BY ALL""")
def q_percentiles_approx(spark, sf):
    """The sketch's accuracy exceeds the row count of the tables compared, so
    it returns the value at rank ceil(p * n)."""
    p = curate.percentiles(TB.scored(spark, sf), ["sig_conf", "pri_conf"], method="approx")
    return p.select(F.col("p_no").cast("bigint").alias("p_no"), "prob", F.round("sig_conf", 6).alias("sig_conf"),
                    F.round("pri_conf", 6).alias("pri_conf"))


@register("conf_histogram", f"""{SC}
SELECT CAST(least(floor(sig_conf * 10) + 1, 10) AS BIGINT) AS bin, count(*) AS n,
       round((least(floor(sig_conf * 10) + 1, 10) - 1) * 0.1, 6) AS lo
FROM scored WHERE sig_conf IS NOT NULL GROUP BY ALL""")
def q_hist(spark, sf):
    h = curate.histogram(TB.scored(spark, sf), "sig_conf", 0.0, 1.0, 10)
    return h.select(F.col("bin").cast("bigint").alias("bin"), "n", F.round("lo", 6).alias("lo"))


@register("curation_rates", f"""{SC}
SELECT
  (SELECT round(avg(CASE WHEN NOT sig_pred AND NOT pri_pred THEN 1.0 ELSE 0.0 END), 6) FROM scored WHERE sig = 0) AS neg_rate,
  (SELECT round(avg(CASE WHEN sig_pred THEN 1.0 ELSE 0.0 END), 6) FROM scored WHERE sig = 1) AS sig_rate,
  (SELECT round(avg(CASE WHEN pri_pred THEN 1.0 ELSE 0.0 END), 6) FROM scored WHERE sig = 2) AS pri_rate""")
def q_rates(spark, sf):
    """Three subset rates in one aggregate (avg skips rows outside the subset)."""
    s = TB.scored(spark, sf)

    def r(pred, subset):
        return F.round(F.avg(F.when(subset, pred.cast("double"))), 6)

    return s.agg(r(~F.col("sig_pred") & ~F.col("pri_pred"), F.col("sig") == 0).alias("neg_rate"),
                 r(F.col("sig_pred"), F.col("sig") == 1).alias("sig_rate"),
                 r(F.col("pri_pred"), F.col("sig") == 2).alias("pri_rate"))


LABEL_CASE = """CASE WHEN sig = 2 THEN 'Principal gender equality objective' WHEN sig = 1 THEN 'Significant gender equality objective'
                ELSE 'No gender equality objective' END"""


@register("confusion_buckets", f"""{PRE_X08},
l AS (SELECT *, {LABEL_CASE} AS label FROM pre),
b AS (
  SELECT 'true_negative' AS bucket, count(*) AS n FROM l WHERE label = 'No gender equality objective' AND sig_pred = 'False' AND pri_pred = 'False'
  UNION ALL SELECT 'true_pos_sig', count(*) FROM l WHERE label = 'Significant gender equality objective' AND sig_pred = 'True'
  UNION ALL SELECT 'true_pos_pri', count(*) FROM l WHERE label = 'Principal gender equality objective' AND pri_pred = 'True'
  UNION ALL SELECT 'false_neg_sig', count(*) FROM l WHERE label = 'Significant gender equality objective' AND sig_pred = 'False'
  UNION ALL SELECT 'false_neg_pri', count(*) FROM l WHERE label = 'Principal gender equality objective' AND pri_pred = 'False'
  UNION ALL SELECT 'false_pos_sig', count(*) FROM l WHERE label <> 'Significant gender equality objective' AND sig_pred = 'True'
  UNION ALL SELECT 'false_pos_pri', count(*) FROM l WHERE label <> 'Principal gender equality objective' AND pri_pred = 'True'
  UNION ALL SELECT 'false_pos', count(*) FROM l WHERE label = 'No gender equality objective' AND (pri_pred = 'True' OR sig_pred = 'True')
  UNION ALL SELECT 'false_neg', count(*) FROM l WHERE label <> 'No gender equality objective' AND sig_pred = 'False' AND pri_pred = 'False')
SELECT * FROM b WHERE n > 0""")
def q_confusion(spark, sf):
    x = _scored_str(spark, sf).withColumn("label", M.marker_label(F.col("sig"), *curate.GENDER_LABELS))
    return audit.confusion_buckets(x).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


# --- X09: climate curation -----------------------------------------------------
def _climate_sql(select: str) -> str:
    rules = []
    for k, (a, b, m, mk, v) in curate.GAP_RULES.items():
        rules.append(f"coalesce({a} >= {b} + {m} AND {mk} = {v}, false)")
    for k, (a, b, m, mk, v, o) in curate.CROSS_RULES.items():
        rules.append(f"coalesce({a} >= {b} + {m} AND {mk} = {v} AND {mk} > {o}, false)")
    for k, (mk, v, pred, conf, thr) in curate.FN_RULES.items():
        rules.append(f"coalesce({mk} = {v} AND NOT {pred} AND {conf} <= {thr}, false)")
    for k, (mk, v, pred, conf, thr) in curate.FP_RULES.items():
        rules.append(f"coalesce(NOT ({mk} = {v}) AND {pred} AND {conf} >= {thr}, false)")
    for k, (mk, confs, thr) in curate.TN_RULES.items():
        rules.append(f"coalesce({mk} = 0 AND " + " AND ".join(f"{c} <= {thr}" for c in confs) + ", false)")
    from ..functions.lexicon import shipped
    lx = shipped()
    cr = S.clean_r("text")
    return f"""WITH {TB.CLIMATE_SQL.strip()},
p0 AS (SELECT *, adapt_sig_conf > 0.5 AS adapt_sig_pred, adapt_pri_conf > 0.5 AS adapt_pri_pred,
              mitig_sig_conf > 0.5 AS mitig_sig_pred, mitig_pri_conf > 0.5 AS mitig_pri_pred,
              {S.match(cr, lx['supplemental_climate'])} AS supp, {S.match(cr, lx['negative_climate'])} AS neg,
              {S.match(cr, lx['strong_adaptation'])} AS adaptation_match, {S.match(cr, lx['strong_mitigation'])} AS mitigation_match
       FROM climate),
p1 AS (SELECT * REPLACE (CASE WHEN supp THEN 'True' ELSE match END AS match,
                         CASE WHEN adapt_sig > 2 THEN 2 ELSE adapt_sig END AS adapt_sig,
                         CASE WHEN mitig_sig > 2 THEN 2 ELSE mitig_sig END AS mitig_sig) FROM p0 WHERE NOT neg),
p2 AS (SELECT * FROM p1 WHERE NOT (match = 'True' AND adapt_sig = 0 AND mitig_sig = 0)
         AND NOT (match = 'False' AND (adapt_sig > 0 OR mitig_sig > 0))
         AND coalesce(length(text) > 10 AND length(text) - length(replace(text, ' ', '')) < 500, false)),
p3 AS (SELECT * FROM p2 WHERE ({' OR '.join(rules)})
         AND NOT (coalesce(adapt_sig = 0 AND adaptation_match AND (adapt_pri_conf > 0.75 OR adapt_sig_conf > 0.75), false)
               OR coalesce(mitig_sig = 0 AND mitigation_match AND (mitig_pri_conf > 0.75 OR mitig_sig_conf > 0.75), false)))
{select}"""


CLIMATE_LABELS_SQL = """CASE WHEN adapt_sig = 2 THEN 'Principal climate adaptation objective' WHEN adapt_sig = 1 THEN 'Significant climate adaptation objective' ELSE 'No climate adaptation objective' END AS adaptation_label,
       CASE WHEN mitig_sig = 2 THEN 'Principal climate mitigation objective' WHEN mitig_sig = 1 THEN 'Significant climate mitigation objective' ELSE 'No climate mitigation objective' END AS mitigation_label"""


@register("curate_climate", _climate_sql(f"SELECT doc_id, text, {CLIMATE_LABELS_SQL} FROM p3"))
def q_curate_climate(spark, sf):
    return curate.curate_climate(TB.climate_predictions(spark, sf), near_dup=None, order_col="doc_id")


@register("curate_climate_dedup", _climate_sql(f"""
SELECT doc_id, text, adaptation_label, mitigation_label FROM (
  SELECT *, lead(text) OVER (ORDER BY text, doc_id) AS nxt FROM (SELECT doc_id, text, {CLIMATE_LABELS_SQL} FROM p3))
WHERE nxt IS NULL OR levenshtein({one_byte('text')}, {one_byte('nxt')}) / length(text) >= 0.2"""))
def q_curate_climate_full(spark, sf):
    """X09 end to end, with near-duplicate removal in text order."""
    return curate.curate_climate(TB.climate_predictions(spark, sf), order_col="doc_id")


def _error_rows_sql() -> str:
    rule = {}
    for k, (mk, v, pred, conf, thr) in curate.FN_RULES.items():
        rule[k] = f"coalesce({mk} = {v} AND NOT {pred} AND {conf} <= {thr}, false)"
    for k, (mk, v, pred, conf, thr) in curate.FP_RULES.items():
        rule[k] = f"coalesce(NOT ({mk} = {v}) AND {pred} AND {conf} >= {thr}, false)"
    fp = " OR ".join(rule[k] for k in curate.FP_RULES)
    return _climate_sql(f"""SELECT doc_id, ({fp}) AND adapt_sig = 0 AND mitig_sig = 0 AS fp_drill
FROM p2 WHERE {' OR '.join(rule.values())}""")


@register("climate_error_rows", _error_rows_sql())
def q_climate_errors(spark, sf):
    x = curate.prepare_climate(TB.climate_predictions(spark, sf))
    return curate.error_rows(x).select("doc_id", "fp_drill")


# --- X10: keyword discovery --------------------------------------------------
def _stop_sql():
    return S.lit_list(keywords.stop_words())


@register("discover_keywords", f"""WITH {TB.RECORDS_SQL.strip()},
d AS (SELECT text, arg_min(sig, doc_id) AS sig FROM records
      WHERE coalesce(sig IN (0, 1, 2), false) AND text IS NOT NULL AND text <> '' AND length(text) > 10 GROUP BY text),
t AS (SELECT md5(text) AS doc, sig, unnest(string_split({S.clean('text')}, ' ')) AS word FROM d),
w AS (SELECT * FROM t WHERE length(word) >= 2 AND NOT list_contains({_stop_sql()}, word)),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT word, count(DISTINCT doc) AS df FROM w GROUP BY word),
idf AS (SELECT word, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n),
tf AS (SELECT sig, word, count(*) AS tf FROM w GROUP BY sig, word),
raw AS (SELECT sig, word, tf * idf AS raw FROM tf JOIN idf USING (word)),
sc AS (SELECT sig, word, raw / sqrt(sum(raw * raw) OVER (PARTITION BY sig)) AS score FROM raw),
t0 AS (SELECT *, row_number() OVER (ORDER BY score DESC, word) AS rank FROM sc WHERE sig = 0 AND score > 0 QUALIFY rank <= 250),
t1 AS (SELECT *, row_number() OVER (ORDER BY score DESC, word) AS rank FROM sc WHERE sig = 1 AND score > 0
       AND word NOT IN (SELECT word FROM t0) QUALIFY rank <= 250),
t2 AS (SELECT *, row_number() OVER (ORDER BY score DESC, word) AS rank FROM sc WHERE sig = 2 AND score > 0
       AND word NOT IN (SELECT word FROM t0) AND word NOT IN (SELECT word FROM t1) QUALIFY rank <= 250)
SELECT sig, rank, word, round(score, 6) AS score FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)""")
def q_discover(spark, sf):
    r = TB.records(spark, sf)
    k = keywords.discover_keywords(r, "text", "sig", None, "doc_id")
    return k.select("sig", F.col("rank").cast("bigint").alias("rank"), "word", "score")


# --- X11 / A31 / J02: vocabulary scores ---------------------------------------
VOCAB = Lexicon("vocab", ("thble", "erin", "anea", "thor", "eron", "thly", "erin", "ou en", "zzzz", "of the"))


def _vocab_sql(lex=VOCAB, digits=6):
    def mean(c):
        return f"sum(CAST(x.{c} AS DECIMAL(38,12)))::DOUBLE / count(*) AS {c}"

    def shown(c):
        return f"{f'round(coalesce(m.{c}, 0), {digits})' if digits else f'coalesce(m.{c}, 0)'} AS {c}"

    rows = " UNION ALL ".join(
        f"SELECT {i} AS kw_no, '{w}' AS keyword, '{e}' AS entry" for i, (w, e) in enumerate(
            (w, normalise_word(w)) for w in lex.words))
    return f"""{SC},
x AS (SELECT *, ' ' || coalesce(clean, '') || ' ' AS padded FROM scored0 s JOIN (SELECT doc_id, sig_conf, pri_conf FROM scored) c USING (doc_id)
      WHERE coalesce(sig IN (1, 2), false) AND {S.match('clean', lex)}),
k AS ({rows}),
m AS (SELECT k.entry, {mean('sig_conf')}, {mean('pri_conf')} FROM (SELECT DISTINCT entry FROM k) k
      JOIN x ON contains(x.padded, ' ' || k.entry || ' ') GROUP BY k.entry)
SELECT k.kw_no, k.keyword, {shown('sig_conf')}, {shown('pri_conf')}
FROM k LEFT JOIN m USING (entry)"""


@register("score_vocabulary", _vocab_sql())
def q_vocab(spark, sf):
    s = TB.scored(spark, sf)
    return keywords.score_vocabulary(s, VOCAB, ["sig_conf", "pri_conf"], markers=("sig",), digits=6)


# a list as long as the extended climate lexicon, made by a rule: words, pairs, triples and repeats
COMMON = ("in", "the", "en", "of", "and", "to", "a", "on", "is", "that", "it", "as", "be", "was", "for", "er", "with")
PAIRS = tuple(f"{a} {b}" for a in COMMON for b in COMMON)
VOCAB_WIDE = Lexicon("vocab_wide", COMMON + PAIRS + tuple(f"{a} {b} {a}" for a, b in zip(COMMON, COMMON[1:] + COMMON[:1])) + PAIRS[::11] + ("The",))


@register("score_vocabulary_wide", _vocab_sql(VOCAB_WIDE, None))
def q_vocab_wide(spark, sf):
    """351 entries of one to three words: one probe of the texts, whatever the list's length."""
    s = TB.scored(spark, sf)
    return keywords.score_vocabulary(s, VOCAB_WIDE, ["sig_conf", "pri_conf"], markers=("sig",))


PHRASES = Lexicon("phrases", PAIRS)


@register("lexicon_pairs", f"""WITH d AS (SELECT doc_id, ' ' || {S.clean('text')} || ' ' AS padded FROM documents),
e AS (SELECT unnest({S.lit_list(PAIRS)}) AS entry)
SELECT doc_id, entry FROM d JOIN e ON contains(padded, ' ' || entry || ' ')""")
def q_lexicon_pairs(spark, sf):
    """Every (document, phrase) pair of the list."""
    d = _docs(spark, sf).select("doc_id", T.clean_text("text").alias("_c"))
    return keywords.lexicon_join(d, "_c", PHRASES, "doc_id")


RARE_PAIRS = Lexicon("rare_pairs", tuple(f"{a} {b}" for a in COMMON[5:] for b in ("that", "er", "es", "ha") if a != b) + ("thble", "anea of the"))


@register("keyword_match_phrases", f"SELECT doc_id, {S.match(S.clean('text'), RARE_PAIRS)} AS match FROM documents")
def q_match_phrases(spark, sf):
    return _docs(spark, sf).select("doc_id", RARE_PAIRS.match(T.clean_text("text")).alias("match"))


# --- A25 / F03 / F04 / A27 on records ------------------------------------------
@register("records_funnel", f"""WITH {TB.RECORDS_SQL.strip()}
SELECT 'all' AS stage, 0 AS step, count(*) AS rows FROM records
UNION ALL SELECT 'declared', 1, count(*) FROM records WHERE coalesce(sig IN (0, 1, 2), false)
UNION ALL SELECT 'usable', 2, count(*) FROM records WHERE coalesce(sig IN (0, 1, 2), false) AND text IS NOT NULL AND text <> '' AND length(text) > 10
UNION ALL SELECT 'distinct_text', 3, count(DISTINCT text) FROM records WHERE coalesce(sig IN (0, 1, 2), false) AND text IS NOT NULL AND text <> '' AND length(text) > 10""")
def q_records_funnel(spark, sf):
    r = TB.records(spark, sf)
    dec = FL.declared(None, "sig")
    use = dec & FL.usable_text("text")
    counted = D.funnel_counts(r, {"all": F.lit(True), "declared": dec, "usable": use})
    texts = r.where(use).select(F.sha2("text", 256).alias("t")).distinct().agg(F.count(F.lit(1)).alias("rows"))
    return counted.unionByName(texts.select(F.lit("distinct_text").alias("stage"), F.lit(3).alias("step"), "rows"))


@register("dedupe_texts", f"""WITH {TB.RECORDS_SQL.strip()}
SELECT text, min(doc_id) AS doc_id, arg_min_null(sig, doc_id) AS sig FROM records GROUP BY text""")
def q_dedupe_texts(spark, sf):
    r = TB.records(spark, sf).select("text", "doc_id", "sig")
    return D.dedupe(r, ["text"], "doc_id")
