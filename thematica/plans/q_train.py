"""Training-data, evaluation, synthetic-request and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import text as T
from ..operators import curate, synthetic, training, vectors
from ..session import write_table
from ..sources import tables as TB
from . import sqlkit as S
from .catalog import register
from .q_text import CLIMATE_LABELS_SQL, DOC_MATCH, PRE_X08, SC, _climate_sql

REC = f"WITH {TB.RECORDS_SQL.strip()}"


def _h(seed, col):
    return f"md5(concat_ws('|', '{seed}', coalesce(CAST({col} AS VARCHAR), '')))"


# --- W06 / O06 / P20 ----------------------------------------------------------
@register("stratified_split", f"""{REC},
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h(42, 'doc_id')}, doc_id) AS rk,
             count(*) OVER (PARTITION BY lang) AS n FROM records)
SELECT doc_id, lang, CASE WHEN rk <= round_even(0.2 * n, 0) THEN 'test' ELSE 'train' END AS split FROM r""")
def q_split(spark, sf):
    r = TB.records(spark, sf).select("doc_id", "lang")
    return training.stratified_split(r, "lang", 0.2, 42, ("doc_id",))


@register("downsample_negatives", f"""{REC},
d AS (SELECT doc_id, sig FROM records WHERE sig IS NOT NULL),
np AS (SELECT count(*) AS n FROM d WHERE sig <> 0),
neg AS (SELECT doc_id, sig, row_number() OVER (ORDER BY {_h(42, 'doc_id')}, doc_id) AS rk FROM d WHERE sig = 0)
SELECT doc_id, sig FROM neg, np WHERE rk <= np.n
UNION ALL SELECT doc_id, sig FROM d WHERE sig <> 0""")
def q_downsample(spark, sf):
    r = TB.records(spark, sf).where(F.col("sig").isNotNull()).select("doc_id", "sig")
    return training.downsample(r, "sig", 0, 42, ("doc_id",))


@register("encode_class", f"""{REC},
ids AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS class_id FROM (SELECT DISTINCT source FROM records))
SELECT doc_id, source, CAST(class_id AS INTEGER) AS class_id FROM records LEFT JOIN ids USING (source)""")
def q_encode(spark, sf):
    r = TB.records(spark, sf).select("doc_id", "source")
    return training.encode_class(r, "source").select("doc_id", "source", F.col("class_id").cast("int").alias("class_id"))


# --- X12 / A28: training-set preparation and class weights ------------------------
PREP_SQL = f"""{REC},
d0 AS (SELECT text, arg_min_null(sig, doc_id) AS sig FROM records
       WHERE coalesce(sig IN (0, 1, 2), false) AND text IS NOT NULL AND text <> '' AND length(text) > 10 GROUP BY text),
np AS (SELECT count(*) AS n FROM d0 WHERE sig <> 0),
neg AS (SELECT text, sig, row_number() OVER (ORDER BY {_h(42, 'text')}, text) AS rk FROM d0 WHERE sig = 0),
bal AS (SELECT text, sig FROM neg, np WHERE rk <= np.n UNION ALL SELECT text, sig FROM d0 WHERE sig <> 0),
sp AS (SELECT text, sig, row_number() OVER (PARTITION BY sig ORDER BY {_h(42, 'text')}, text) AS rk,
              count(*) OVER (PARTITION BY sig) AS n FROM bal),
prepared AS (
  SELECT text, sig, CASE WHEN rk <= round_even(0.2 * n, 0) THEN 'test' ELSE 'train' END AS split,
         [CASE WHEN sig = 1 THEN 1.0 ELSE 0.0 END, CASE WHEN sig >= 2 THEN 1.0 ELSE 0.0 END]::DOUBLE[] AS labels
  FROM sp)"""


def _prepared(spark, sf):
    return training.prepare_training(TB.records(spark, sf), "sig", "text", None, "doc_id", 42, 0.2)


@register("prepare_training", f"{PREP_SQL}\nSELECT * FROM prepared")
def q_prepare(spark, sf):
    return _prepared(spark, sf)


@register("class_weights", f"""{PREP_SQL}
SELECT CAST(i - 1 AS INTEGER) AS label_idx,
       round(sum(CASE WHEN v = 0.0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN v = 1.0 THEN 1 ELSE 0 END), 0), 6) AS weight
FROM (SELECT unnest(labels) AS v, unnest(range(1, len(labels) + 1)) AS i FROM prepared) GROUP BY i""")
def q_weights(spark, sf):
    w = training.class_weights(_prepared(spark, sf))
    return w.select(F.col("label_idx").cast("int").alias("label_idx"), F.round("weight", 6).alias("weight"))


@register("label_counts", f"{PREP_SQL}\nSELECT sig, count(*) AS n FROM prepared GROUP BY sig")
def q_label_counts(spark, sf):
    return training.label_counts(_prepared(spark, sf), "sig")


# --- A29 / A30 / P23: evaluation ------------------------------------------------
EVAL_SQL = f"""{SC},
e AS (SELECT doc_id, [sig_conf, pri_conf] AS p,
             [CASE WHEN sig = 1 THEN 1.0 ELSE 0.0 END, CASE WHEN sig >= 2 THEN 1.0 ELSE 0.0 END] AS y
      FROM scored WHERE sig IS NOT NULL),
z AS (SELECT doc_id, unnest(p) AS p, unnest(y) AS y, unnest(range(0, 2)) AS class_idx FROM e),
c AS (SELECT *, CAST(p > 0.5 AS INTEGER) AS pp, CAST(y AS INTEGER) AS yy FROM z)"""


def _metrics_sql(group: str) -> str:
    g = f"GROUP BY {group}" if group else ""
    sel = f"{group}, " if group else ""
    return f"""{EVAL_SQL},
m AS (SELECT {sel}sum(pp * yy) AS tp, sum(pp * (1 - yy)) AS fp, sum((1 - pp) * yy) AS fn, sum((1 - pp) * (1 - yy)) AS tn FROM c {g}),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rec FROM m)
SELECT {sel}round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0), 6) AS f1, round(prec, 6) AS precision, round(rec, 6) AS recall FROM r"""


def _eval_frame(spark, sf):
    s = TB.scored(spark, sf).where(F.col("sig").isNotNull())
    return s.select("doc_id", F.array("sig_conf", "pri_conf").alias("predictions"),
                    M.multi_hot(F.col("sig"), (1, 2)).alias("labels"))


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("metrics_per_class", _metrics_sql("class_idx"))
def q_metrics(spark, sf):
    m = training.metrics_per_class(_eval_frame(spark, sf))
    return _r6(m.withColumn("class_idx", F.col("class_idx").cast("bigint")), ("accuracy", "f1", "precision", "recall"))


@register("metrics_flat", _metrics_sql(""))
def q_metrics_flat(spark, sf):
    return _r6(training.metrics_flat(_eval_frame(spark, sf)), ("accuracy", "f1", "precision", "recall"))


NAMES = ("Significant gender equality objective", "Principal gender equality objective")


@register("unpack_classes", f"""{SC}
SELECT doc_id, sig_conf AS "Predicted {NAMES[0]}", CASE WHEN sig = 1 THEN 1.0 ELSE 0.0 END AS "Label {NAMES[0]}",
       pri_conf AS "Predicted {NAMES[1]}", CASE WHEN sig >= 2 THEN 1.0 ELSE 0.0 END AS "Label {NAMES[1]}"
FROM scored WHERE sig IS NOT NULL""")
def q_unpack(spark, sf):
    u = training.unpack_classes(_eval_frame(spark, sf), NAMES)
    return u.drop("predictions", "labels")


# --- C04 + X14: joint multi-label model, per-class evaluation --------------------
FIT_STEPS, FIT_RATE, FIT_FEATURES = 12, 4.0, 1 << 14


def _fit_sql() -> str:
    """The same fit, its iterations written out one after another."""
    steps = []
    for i in range(FIT_STEPS):
        margin = ", ".join(f"coalesce(sum(v * w{k}), 0) + any_value(b.b{k}) AS m{k}" for k in (0, 1))
        resid = ", ".join(f"(1 / (1 + exp(-m{k})) - y{k}) * CASE WHEN y{k} = 1 THEN s{k} ELSE 1 END / n AS r{k}" for k in (0, 1))
        steps.append(f"""e{i} AS MATERIALIZED (
  SELECT id, {resid} FROM (
    SELECT t.id, any_value(y0) AS y0, any_value(y1) AS y1, {margin}
    FROM train t LEFT JOIN (SELECT v.id, v.v, w.* FROM vec v JOIN w{i} w USING (f)) x ON x.id = t.id, b{i} b GROUP BY t.id), totals)""")
        steps.append(f"""w{i + 1} AS MATERIALIZED (
  SELECT w.f, w0 - {FIT_RATE} * g0 AS w0, w1 - {FIT_RATE} * g1 AS w1 FROM w{i} w
  JOIN (SELECT f, sum(v * r0) AS g0, sum(v * r1) AS g1 FROM vec JOIN e{i} USING (id) GROUP BY f) USING (f))""")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b0 - {FIT_RATE} * (SELECT sum(r0) FROM e{i}) AS b0, b1 - {FIT_RATE} * (SELECT sum(r1) FROM e{i}) AS b1 FROM b{i})")
    return f"""{PREP_SQL},
doc AS MATERIALIZED (SELECT row_number() OVER () AS id, split, labels[1] AS y0, labels[2] AS y1, {S.clean('text')} AS clean FROM prepared),
tf AS MATERIALIZED (
  SELECT id, split, ('0x' || substr(md5(w), 1, 8))::BIGINT % {FIT_FEATURES} AS f, count(*) AS tf
  FROM (SELECT id, split, unnest(string_split(clean, ' ')) AS w FROM doc WHERE clean IS NOT NULL) GROUP BY ALL),
train AS MATERIALIZED (SELECT * FROM doc WHERE split = 'train'),
totals AS MATERIALIZED (
  SELECT count(*) AS n, coalesce(count(*) FILTER (y0 = 0) / nullif(count(*) FILTER (y0 = 1), 0), 1) AS s0,
    coalesce(count(*) FILTER (y1 = 0) / nullif(count(*) FILTER (y1 = 1), 0), 1) AS s1 FROM train),
idf AS (SELECT f, count(*) AS df FROM tf WHERE split = 'train' GROUP BY f),
raw AS (SELECT id, split, f, tf * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS x FROM tf LEFT JOIN idf USING (f), totals),
unit AS MATERIALIZED (SELECT id, split, f, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS v FROM raw),
vec AS MATERIALIZED (SELECT id, f, v FROM unit WHERE split = 'train'),
w0 AS MATERIALIZED (SELECT DISTINCT f, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1 FROM vec),
b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1),
{', '.join(steps)},
scored AS (
  SELECT t.id, any_value(y0) AS y0, any_value(y1) AS y1, 1 / (1 + exp(-(coalesce(sum(v * w0), 0) + any_value(b.b0)))) AS p0,
    1 / (1 + exp(-(coalesce(sum(v * w1), 0) + any_value(b.b1)))) AS p1
  FROM doc t LEFT JOIN (SELECT u.id, u.v, w.* FROM unit u JOIN w{FIT_STEPS} w USING (f)) x ON x.id = t.id, b{FIT_STEPS} b
  WHERE t.split = 'test' GROUP BY t.id)"""


def _fitted(spark, sf):
    p = write_table(_prepared(spark, sf), "prepared")
    model = training.fit_multilabel(p.where(F.col("split") == "train"), num_features=FIT_FEATURES, max_iter=FIT_STEPS, rate=FIT_RATE)
    return model.predict(p.where(F.col("split") == "test"))


@register("fit_evaluate_multilabel", _fit_sql() + """,
z AS (SELECT unnest([p0, p1]) AS p, unnest([y0, y1]) AS y, unnest(range(0, 2)) AS class_idx FROM scored),
c AS (SELECT class_idx, CAST(p > 0.5 AS INTEGER) AS pp, CAST(y AS INTEGER) AS yy FROM z),
m AS (SELECT class_idx, sum(pp * yy) AS tp, sum(pp * (1 - yy)) AS fp, sum((1 - pp) * yy) AS fn, sum((1 - pp) * (1 - yy)) AS tn FROM c GROUP BY class_idx),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rec FROM m)
SELECT class_idx, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0), 6) AS f1, round(prec, 6) AS precision, round(rec, 6) AS recall FROM r""")
def q_fit(spark, sf):
    """C04 + X14: a weighted joint model fitted on the train split, per-class metrics on the test split."""
    m = training.metrics_per_class(_fitted(spark, sf))
    return _r6(m.withColumn("class_idx", F.col("class_idx").cast("bigint")), ("accuracy", "f1", "precision", "recall"))


@register("fit_predictions", _fit_sql() + """
SELECT clean, round(p0, 4) AS significant, round(p1, 4) AS principal FROM scored JOIN doc USING (id)""")
def q_fit_predictions(spark, sf):
    """The fitted probabilities of the test split themselves."""
    x = _fitted(spark, sf)
    return x.select(T.clean_text("text").alias("clean"), F.round(F.col("predictions")[0], 4).alias("significant"), F.round(F.col("predictions")[1], 4).alias("principal"))


# --- X13: publish the curated set -------------------------------------------------
@register("publish_curated", f"""{PRE_X08},
cur AS (SELECT text, CASE WHEN sig = 2 THEN 'Principal gender equality objective' WHEN sig = 1 THEN 'Significant gender equality objective'
                  ELSE 'No gender equality objective' END AS label
  FROM f, q WHERE
  coalesce(pri_conf >= p[5] AND sig_conf <= s[3] AND sig = 2, false)
  OR coalesce(sig_conf >= s[4] AND pri_conf <= p[3] AND sig = 1, false)
  OR coalesce(sig = 1 AND NOT sig_pred = 'True' AND sig_conf <= s[3], false)
  OR coalesce(sig = 2 AND NOT pri_pred = 'True' AND pri_conf <= p[3], false)
  OR coalesce(NOT sig = 1 AND sig_pred = 'True' AND sig_conf >= s[5], false)
  OR coalesce(NOT sig = 2 AND pri_pred = 'True' AND pri_conf >= p[5], false)
  OR coalesce(sig = 0 AND sig_conf <= s[2] AND pri_conf <= p[2], false)),
ids AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS class_label FROM (SELECT DISTINCT label FROM cur)),
sp AS (SELECT text, label, row_number() OVER (PARTITION BY class_label ORDER BY {_h(1337, 'text')}, text) AS rk,
              count(*) OVER (PARTITION BY class_label) AS n FROM cur JOIN ids USING (label))
SELECT text, label, CASE WHEN rk <= round_even(0.2 * n, 0) THEN 'test' ELSE 'train' END AS split FROM sp""")
def q_publish(spark, sf):
    from .q_text import _scored_str
    cur = curate.curate_quantile(_scored_str(spark, sf))
    return training.publish_curated(cur, remove=None).select("text", "label", "split")


# --- X13, climate half: two labels, split by their combination ---------------------
@register("publish_climate", _climate_sql(f"""
, cur AS (SELECT text, {CLIMATE_LABELS_SQL} FROM p3 WHERE NOT (doc_id % 7 = 0)),
sp AS (SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY adaptation_label, mitigation_label) AS n FROM cur
       WINDOW w AS (PARTITION BY adaptation_label, mitigation_label
                    ORDER BY {_h(1337, 'text')}, text))
SELECT text, adaptation_label, mitigation_label, CASE WHEN rk <= round_even(0.2 * n, 0) THEN 'test' ELSE 'train' END AS split FROM sp"""))
def q_publish_climate(spark, sf):
    """Rows whose number divides by seven carry the removal mark."""
    cur = curate.curate_climate(TB.climate_predictions(spark, sf), near_dup=None, order_col="doc_id")
    cur = cur.withColumn("Remove", F.when(F.col("doc_id") % 7 == 0, F.lit("X")))
    return training.publish_curated(cur, ("adaptation_label", "mitigation_label"))


# --- X14: evaluation report, climate (four classes) -------------------------------
CLIMATE_NAMES = ("Significant climate adaptation objective", "Principal climate adaptation objective",
                 "Significant climate mitigation objective", "Principal climate mitigation objective")


def _climate_eval(spark, sf):
    c = TB.climate_predictions(spark, sf)
    preds = F.array("adapt_sig_conf", "adapt_pri_conf", "mitig_sig_conf", "mitig_pri_conf")
    return training.evaluate_per_class(c, preds, training.climate_labels("adapt_sig", "mitig_sig"), CLIMATE_NAMES)


CLIMATE_EVAL_SQL = f"""WITH {TB.CLIMATE_SQL.strip()},
e AS (SELECT doc_id, adapt_sig_conf, adapt_pri_conf, mitig_sig_conf, mitig_pri_conf,
        CAST(coalesce(adapt_sig = 1, false) AS DOUBLE) AS a1, CAST(coalesce(adapt_sig >= 2, false) AS DOUBLE) AS a2,
        CAST(coalesce(mitig_sig = 1, false) AS DOUBLE) AS m1, CAST(coalesce(mitig_sig >= 2, false) AS DOUBLE) AS m2 FROM climate)"""


@register("evaluate_climate_wide", CLIMATE_EVAL_SQL + "\nSELECT doc_id, " + ", ".join(
    f'{p} AS "Predicted {n}", {y} AS "Label {n}"' for n, p, y in zip(
        CLIMATE_NAMES, ("adapt_sig_conf", "adapt_pri_conf", "mitig_sig_conf", "mitig_pri_conf"), ("a1", "a2", "m1", "m2"))) + " FROM e")
def q_climate_wide(spark, sf):
    wide, _ = _climate_eval(spark, sf)
    return wide.select("doc_id", *[f"`{side} {n}`" for n in CLIMATE_NAMES for side in ("Predicted", "Label")])


@register("evaluate_climate", CLIMATE_EVAL_SQL + """,
z AS (SELECT unnest([adapt_sig_conf, adapt_pri_conf, mitig_sig_conf, mitig_pri_conf]) AS p, unnest([a1, a2, m1, m2]) AS y,
             unnest(range(0, 4)) AS class_idx FROM e),
c AS (SELECT class_idx, CAST(p > 0.5 AS INTEGER) AS pp, CAST(y AS INTEGER) AS yy FROM z),
m AS (SELECT class_idx, sum(pp * yy) AS tp, sum(pp * (1 - yy)) AS fp, sum((1 - pp) * yy) AS fn, sum((1 - pp) * (1 - yy)) AS tn FROM c GROUP BY class_idx),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rec FROM m)
SELECT class_idx, [""" + ", ".join(f"'{n}'" for n in CLIMATE_NAMES) + """][class_idx + 1] AS class_name,
       round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0), 6) AS f1, round(prec, 6) AS precision, round(rec, 6) AS recall FROM r""")
def q_climate_eval(spark, sf):
    _, m = _climate_eval(spark, sf)
    return _r6(m.withColumn("class_idx", F.col("class_idx").cast("bigint")), ("accuracy", "f1", "precision", "recall"))


# --- X15 / T17 / A35 / T18: synthetic-data requests ---------------------------------
SYN_SQL = f"""{REC},
d AS (SELECT text, arg_min_null(sig, doc_id) AS sig FROM records
      WHERE coalesce(sig IN (1, 2), false) AND text IS NOT NULL AND text <> '' AND length(text) > 10
        AND {S.match(S.clean('text'), DOC_MATCH)} GROUP BY text),
l AS (SELECT text, CASE WHEN sig = 1 THEN 'Significant' ELSE 'Principal' END AS label FROM d),
sp AS (SELECT text, label, row_number() OVER (PARTITION BY label ORDER BY {_h(42, 'text')}, text) AS rk,
              count(*) OVER (PARTITION BY label) AS n FROM l),
ex AS (SELECT text, label, CASE WHEN rk <= round_even(0.8 * n, 0) THEN 'test' ELSE 'train' END AS split FROM sp)"""


def _examples(spark, sf):
    return synthetic.select_examples(TB.records(spark, sf), "sig", DOC_MATCH, "text", "doc_id", 42, 0.8)


@register("synthetic_examples", f"{SYN_SQL}\nSELECT * FROM ex")
def q_syn(spark, sf):
    return _examples(spark, sf)


def _prompt_sql():
    parts = synthetic.PROMPT_FORMAT.split("{}")
    q = [p.replace("'", "''") for p in parts]
    sem = {k: (a.replace("'", "''"), b.replace("'", "''")) for k, (a, b) in synthetic.SEMANTIC_LABELS.items()}
    sem_case = "CASE label " + " ".join(f"WHEN '{k}' THEN '{a}'" for k, (a, b) in sem.items()) + " END"
    ext_case = "CASE label " + " ".join(f"WHEN '{k}' THEN '{b}'" for k, (a, b) in sem.items()) + " END"
    return f"'{q[0]}' || '{synthetic.MULTIPLIER}' || '{q[1]}' || {sem_case} || '{q[2]}' || {ext_case} || '{q[3]}'"


def _tok_sql(c):
    return f"len(list_filter(regexp_split_to_array(trim({c}), '\\s+'), lambda t: t <> ''))"


@register("synthetic_cost", f"""{SYN_SQL},
pr AS (SELECT text, label, {_prompt_sql()} AS system_prompt FROM ex WHERE split = 'train'),
t AS (SELECT CAST(sum({_tok_sql('system_prompt')} + {synthetic.MULTIPLIER + 1} * {_tok_sql('text')}) AS BIGINT) AS tokens FROM pr)
SELECT tokens, round(tokens / 1e6 * {synthetic.PRICE_PER_MILLION}, 4) AS cost FROM t""")
def q_syn_cost(spark, sf):
    pr = synthetic.prepare_prompts(_examples(spark, sf).where(F.col("split") == "train"))
    return synthetic.estimate_cost(pr)


@register("unpack_responses", """SELECT trim(piece) AS text, role AS label
FROM (SELECT role, unnest(string_split(text, chr(10))) AS piece FROM conversations WHERE role = 'assistant')
WHERE trim(piece) <> ''""")
def q_unpack_resp(spark, sf):
    c = TB.load(spark, sf, "conversations").where(F.col("role") == "assistant")
    return synthetic.unpack_responses(c.select(F.col("text").alias("response"), F.col("role").alias("label")),
                                      sep="\n").select("text", "label")


# --- G03 / G04 / G05: vectors ------------------------------------------------------
@register("mean_pool", """SELECT label, list(m ORDER BY i) AS embedding_mean FROM (
  SELECT label, i, round(avg(CAST(v AS DOUBLE)), 6) AS m
  FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label""")
def q_mean_pool(spark, sf):
    m = vectors.mean_pool(TB.vectors(spark, sf), "embedding", "label")
    return m.select("label", F.transform("embedding_mean", lambda x: F.round(x, 6)).alias("embedding_mean"))


@register("l2_normalize", """SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) /
  sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 6)) AS unit
FROM embeddings""")
def q_l2(spark, sf):
    v = TB.vectors(spark, sf)
    return v.select("vec_id", F.transform(vectors.l2_normalize("embedding"), lambda x: F.round(x, 6)).alias("unit"))


@register("flatten_pool", """SELECT vec_id // 10 AS grp, flatten(list(embedding ORDER BY vec_id)) AS embedding_flat
FROM embeddings GROUP BY vec_id // 10""")
def q_flatten(spark, sf):
    v = TB.vectors(spark, sf).withColumn("grp", (F.col("vec_id") / 10).cast("bigint"))
    return vectors.flatten_pool(v, "embedding", "grp", "vec_id")
