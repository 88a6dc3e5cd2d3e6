"""Driver tables and the domain views built on them.

``flows``   aid-activity lines (lineitem joined out to its dimensions)
``records`` policy-marker texts (documents + labels)
``scored``  records with deterministic model confidences
``sheet``   a stacked sheet whose row order is data (conversations)
``budgets`` flows split into "countries" by region
``vectors`` embeddings

Join strategy for ``flows`` (built for large inputs): lineitem-orders is a
big-big equi-join (sort-merge on the order key).  Customers are joined to the
orders first, so that the lines aren't shuffled for them.  Part, supplier and customer
are joined on their keys and left to the planner: AQE turns a side into a
broadcast only when its measured size is under the broadcast threshold.
Only ``nation`` and ``region`` (fixed 25 / 5 rows) are broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._util import stage
from ..functions import text as T
from ..session import spread, table_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# text tables whose per-row work (regex cleaning, tokenising, scoring) is
# CPU-heavy: spread by their id where the session asks for it
SPREAD_KEYS = {"documents": "doc_id"}


def load(spark: SparkSession, sf_dir: str, name: str, dealt: bool = True) -> DataFrame:
    """Read one driver table.  Text tables are spread by their id where the
    session sets ``spark.thematica.textPartitions`` (``session.spread``);
    ``dealt=False`` leaves that out, where the first heavy step deals rows anyway."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df, SPREAD_KEYS[name]) if dealt and name in SPREAD_KEYS else df


def flows(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """``years=(lo, hi)`` restricts to those ship years with a range on the
    raw date, which reaches the parquet scan (row-group skipping); a
    predicate on the derived ``year`` column cannot be pushed."""
    li = load(spark, sf_dir, "lineitem")
    if years is not None:
        lo, hi = years
        li = li.where((F.col("l_shipdate") >= F.make_timestamp_ntz(F.lit(lo), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
                      & (F.col("l_shipdate") < F.make_timestamp_ntz(F.lit(hi + 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = load(spark, sf_dir, "nation")
    r = load(spark, sf_dir, "region")
    cn = F.broadcast(n.select(F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("recipient_name"),
                              F.col("n_regionkey").alias("cn_region")))
    sn = F.broadcast(n.select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("donor_name")))
    rg = F.broadcast(r.select(F.col("r_regionkey").alias("rg_key"), F.col("r_name").alias("region_name")))
    o = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", "c_nationkey")
    j = (li.join(o, li.l_orderkey == F.col("o_orderkey"))
         .join(p, li.l_partkey == p.p_partkey)
         .join(s, li.l_suppkey == s.s_suppkey)
         .join(cn, F.col("c_nationkey") == F.col("cn_key"))
         .join(rg, F.col("cn_region") == F.col("rg_key"))
         .join(sn, F.col("s_nationkey") == F.col("sn_key")))
    q = F.col("l_quantity").cast("int")
    return j.select(
        "l_orderkey", "l_linenumber",
        F.year("l_shipdate").alias("year"),
        F.year("o_orderdate").alias("commitment_year"),
        "donor_name", "recipient_name", "region_name",
        F.col("p_type").alias("sector_name"),
        F.col("l_returnflag").alias("flow_name"),
        F.col("l_extendedprice").alias("usd_commitment"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("usd_disbursement"),
        F.col("p_name").alias("project_title"),
        F.when(F.col("p_size") % 4 != 3, F.col("p_size") % 4).alias("gender"),
        F.when(F.col("l_linenumber") % 4 != 3, F.col("l_linenumber") % 4).alias("disability"),
        F.when(q % 5 < 3, q % 5).alias("climate_adaptation"),
        F.when(q % 7 < 3, q % 7).alias("climate_mitigation"),
    )


def flow_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text and marker columns of ``flows`` from lineitem and part alone
    (a superset of the flows key tuples; no orders/customer/supplier join)."""
    li = load(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_quantity")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    q = F.col("l_quantity").cast("int")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("p_name").alias("project_title"),
        F.when(F.col("p_size") % 4 != 3, F.col("p_size") % 4).alias("gender"),
        F.when(F.col("l_linenumber") % 4 != 3, F.col("l_linenumber") % 4).alias("disability"),
        F.when(q % 5 < 3, q % 5).alias("climate_adaptation"),
        F.when(q % 7 < 3, q % 7).alias("climate_mitigation"))


FLOWS_SQL = """
flows AS (
  SELECT l_orderkey, l_linenumber,
         CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(year(o_orderdate) AS INTEGER) AS commitment_year,
         sn.n_name AS donor_name, cn.n_name AS recipient_name, r_name AS region_name,
         p_type AS sector_name, l_returnflag AS flow_name,
         l_extendedprice AS usd_commitment,
         l_extendedprice * (1 - l_discount) AS usd_disbursement,
         p_name AS project_title,
         CASE WHEN p_size % 4 <> 3 THEN p_size % 4 END AS gender,
         CASE WHEN l_linenumber % 4 <> 3 THEN l_linenumber % 4 END AS disability,
         CASE WHEN CAST(l_quantity AS INTEGER) % 5 < 3 THEN CAST(l_quantity AS INTEGER) % 5 END AS climate_adaptation,
         CASE WHEN CAST(l_quantity AS INTEGER) % 7 < 3 THEN CAST(l_quantity AS INTEGER) % 7 END AS climate_mitigation
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN region ON cn.n_regionkey = r_regionkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents left-joined to labels; marker ``sig`` = quality + toxic (null if unlabelled)."""
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id", "left")
            .select("doc_id", "text", "lang", "source", "n_chars",
                    (F.col("quality") + F.col("toxic")).alias("sig")))


RECORDS_SQL = """
records AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality + l.toxic AS sig
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

# FIXED VALUES: test lexicons for the driver tables (mid-frequency invented
# words in ``documents``; part-name words in ``flows``).
DOC_MODEL_WORDS = ("thble", "erin", "anea", "thor", "eron", "thly")
DOC_MATCH_WORDS = ("erin", "thor", "anea")
FLOW_LEXICONS = {
    "gender": ("red", "blue"),
    "climate": ("hot", "cold", "large"),
    "disability": ("gizmo", "anvil"),
}
# model confidence = sigmoid(hits - bias) per label
SIG_BIAS, PRI_BIAS = 2.5, 4.5


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records + deterministic confidences from distinct lexicon hits.

    ``hits`` = distinct model words in the cleaned text; sig/pri confidences
    are ``sigmoid(hits - 2.5)`` / ``sigmoid(hits - 4.5)``; ``match`` is a
    lexicon match on a second word list.
    """
    from ..functions.lexicon import Lexicon

    rec = stage(records(spark, sf_dir), {"_clean": T.clean_text(F.col("text"))})
    rec = stage(rec, {"_tok": F.split(F.coalesce(F.col("_clean"), F.lit("")), " ")})
    clean, tok = F.col("_clean"), F.col("_tok")
    model = Lexicon("doc_model", DOC_MODEL_WORDS)
    match = Lexicon("doc_match", DOC_MATCH_WORDS)
    hits = model.hits(tok)
    return rec.select(
        "doc_id", "text", "lang", "source", "sig",
        match.match(clean, tok).alias("match"),
        F.round(T.sigmoid(hits - F.lit(SIG_BIAS)), 6).alias("sig_conf"),
        F.round(T.sigmoid(hits - F.lit(PRI_BIAS)), 6).alias("pri_conf"),
    ).withColumns({"sig_pred": F.col("sig_conf") > 0.5, "pri_pred": F.col("pri_conf") > 0.5})


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


SCORED_SQL = f"""
scored0 AS (
  SELECT r.*, nullif(lower(trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))), '') AS clean
  FROM records r
),
scored1 AS (
  SELECT *, len(list_distinct(list_intersect(string_split(coalesce(clean, ''), ' '), {_sql_list(DOC_MODEL_WORDS)}))) AS hits
  FROM scored0
),
scored AS (
  SELECT doc_id, text, lang, source, sig,
         coalesce(regexp_matches(' ' || coalesce(clean, '') || ' ', ' ({'|'.join(DOC_MATCH_WORDS)}) '), false) AS match,
         round(1 / (1 + exp(-(hits - {SIG_BIAS}))), 6) AS sig_conf,
         round(1 / (1 + exp(-(hits - {PRI_BIAS}))), 6) AS pri_conf,
         round(1 / (1 + exp(-(hits - {SIG_BIAS}))), 6) > 0.5 AS sig_pred,
         round(1 / (1 + exp(-(hits - {PRI_BIAS}))), 6) > 0.5 AS pri_pred
  FROM scored1
)"""


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stacked sheet: one block per conversation, header rows are user turns."""
    c = load(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("block"), F.col("turn").alias("row_ord"), "role",
        F.when(F.col("role") == "user", F.col("text")).alias("header"),
        F.when(F.col("role") == "system", F.col("text")).alias("footer"),
        "text")


SHEET_SQL = """
sheet AS (
  SELECT conv_id AS block, turn AS row_ord, role,
         CASE WHEN role = 'user' THEN text END AS header,
         CASE WHEN role = 'system' THEN text END AS footer,
         text
  FROM conversations
)"""


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows as budget lines: country = region, program = '<orderkey> <title>'."""
    f = flows(spark, sf_dir)
    return f.select(
        F.col("region_name").alias("country"), "year",
        F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.col("project_title")).alias("program"),
        F.col("project_title").alias("text"),
        F.col("usd_commitment").alias("amount"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("usd_disbursement")).alias("approved"),
        "gender", "climate_adaptation", "climate_mitigation", "disability")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings")


# FIXED VALUES: stand-in climate model vocabularies for documents.
CLIMATE_A_WORDS = ("thble", "erin", "anea")
CLIMATE_M_WORDS = ("thor", "eron", "thly")
# steep stand-in model: sig = sigmoid(3h - 5), pri = sigmoid(3h - 8)
CLIMATE_SIG = (3.0, 5.0)
CLIMATE_PRI = (3.0, 8.0)


def climate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climate curation input (the reference's prediction CSV shape):
    text, adapt_sig, mitig_sig, match ('True'/'False'), four confidences."""
    from ..functions.lexicon import Lexicon

    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels")
    x = stage(d.join(lab, "doc_id", "left"), {"_clean": T.clean_text(F.col("text"))})
    x = stage(x, {"_tok": F.split(F.coalesce(F.col("_clean"), F.lit("")), " ")})
    clean, tok = F.col("_clean"), F.col("_tok")
    ha = Lexicon("a", CLIMATE_A_WORDS).hits(tok)
    hm = Lexicon("m", CLIMATE_M_WORDS).hits(tok)
    match = Lexicon("doc_match", DOC_MATCH_WORDS).match(clean, tok)

    def conf(h, p):
        return F.round(T.sigmoid(F.lit(p[0]) * h - F.lit(p[1])), 6)

    return x.select(
        "doc_id", "text",
        (F.col("quality") + F.col("toxic")).alias("adapt_sig"),
        ((F.col("quality") * 2 + F.col("toxic")) % 3).alias("mitig_sig"),
        F.when(match, F.lit("True")).otherwise(F.lit("False")).alias("match"),
        conf(ha, CLIMATE_SIG).alias("adapt_sig_conf"), conf(ha, CLIMATE_PRI).alias("adapt_pri_conf"),
        conf(hm, CLIMATE_SIG).alias("mitig_sig_conf"), conf(hm, CLIMATE_PRI).alias("mitig_pri_conf"))


CLIMATE_SQL = f"""
cl0 AS (
  SELECT d.doc_id, d.text, l.quality + l.toxic AS adapt_sig, (l.quality * 2 + l.toxic) % 3 AS mitig_sig,
         nullif(lower(trim(regexp_replace(d.text, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))), '') AS clean
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
cl1 AS (
  SELECT *, len(list_distinct(list_intersect(string_split(coalesce(clean, ''), ' '), {_sql_list(CLIMATE_A_WORDS)}))) AS ha,
            len(list_distinct(list_intersect(string_split(coalesce(clean, ''), ' '), {_sql_list(CLIMATE_M_WORDS)}))) AS hm
  FROM cl0),
climate AS (
  SELECT doc_id, text, adapt_sig, mitig_sig,
         CASE WHEN coalesce(regexp_matches(' ' || coalesce(clean, '') || ' ', ' ({'|'.join(DOC_MATCH_WORDS)}) '), false) THEN 'True' ELSE 'False' END AS match,
         round(1 / (1 + exp(-({CLIMATE_SIG[0]} * ha - {CLIMATE_SIG[1]}))), 6) AS adapt_sig_conf,
         round(1 / (1 + exp(-({CLIMATE_PRI[0]} * ha - {CLIMATE_PRI[1]}))), 6) AS adapt_pri_conf,
         round(1 / (1 + exp(-({CLIMATE_SIG[0]} * hm - {CLIMATE_SIG[1]}))), 6) AS mitig_sig_conf,
         round(1 / (1 + exp(-({CLIMATE_PRI[0]} * hm - {CLIMATE_PRI[1]}))), 6) AS mitig_pri_conf
  FROM cl1)"""
