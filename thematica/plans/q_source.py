"""Sources, sinks and column construction as queries: what they write is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .._util import money_sum
from ..functions import markers as M
from ..functions import text as T
from ..operators import budgets, columns, curate, filters, selection, training
from ..session import ensure_checkpoint_dir
from ..sources import io
from ..sources import tables as TB
from . import sqlkit as S
from .catalog import register
from .q_text import SC


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/thematica-{uuid.uuid4().hex}/{name}"


def _name(kind: str) -> str:
    return f"thematica_{kind}_{uuid.uuid4().hex}"


# --- S01 / S02 / S07: CSV with quoted multi-line text and a pinned schema -------------
@register("csv_round_trip", """SELECT doc_id, length(text) AS n_chars, md5(text) AS digest, lang, source FROM documents""")
def q_csv(spark, sf):
    path = _folder(spark, "csv")
    io.write_csv(TB.load(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path)
    back = io.read_csv(spark, path, "doc_id long, text string, lang string, source string")
    return back.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "lang", "source")


# --- S03 / P24: a CSV with R's bare NA, columns cast where they can be ----------------
@register("csv_na_columns", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 3 THEN l_linenumber % 4 END AS marker,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS DOUBLE) END AS amount, l_linenumber % 4 = 1 AS flag FROM lineitem""")
def q_csv_na(spark, sf):
    path = _folder(spark, "na")
    li = TB.load(spark, sf, "lineitem")
    m = F.col("l_linenumber") % 4
    x = li.select("l_orderkey", "l_linenumber", F.when(m != 3, m.cast("string")).otherwise("NA").alias("marker"),
                  F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("string")).otherwise("n/a").alias("amount"),
                  F.when(m == 1, "True").otherwise("False").alias("flag"))
    io.write_csv(x, path)
    back = io.read_csv(spark, path, "l_orderkey long, l_linenumber int, marker int, amount string, flag boolean", null_value="NA", multiline=False)
    return columns.cast_cols(back, {"amount": "double"})


# --- S04 / S08: a dataset published by split, one split read back ----------------------
@register("published_split", """WITH r AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '7', CAST(doc_id AS VARCHAR))), doc_id) AS rk,
         count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, 'test' AS split FROM r WHERE rk <= round_even(0.2 * n, 0)""")
def q_published(spark, sf):
    """Only the folder of the split is read."""
    path = _folder(spark, "published")
    d = TB.load(spark, sf, "documents").select("doc_id", "lang")
    io.write_split(training.stratified_split(d, "lang", 0.2, 7, ("doc_id",)), path)
    return io.read_split(spark, path, "test")


# --- S05 / S08 / F01: a warehouse table, partitioned and bucketed -----------------------
CATEGORIES = "(l_linenumber % 3 + 1) * 10"
RECIPIENTS = ("NATION_1", "NATION_13", "NATION_21", "NATION_3", "NATION_5", "NATION_8")


def activities(spark, sf) -> str:
    """The activity lines as a table, of this name: one folder a year, bucketed by order."""
    name = _name("activities")
    f = TB.flows(spark, sf).select("l_orderkey", "l_linenumber", "year", "recipient_name", "usd_disbursement", F.expr(CATEGORIES).alias("category"))
    io.save_table(f, name, _folder(spark, "activities"), ["year"], ["l_orderkey"], 8)
    return name


def sliced(spark, table):
    where = filters.warehouse_slice(10, (1996, 1997), "usd_disbursement", RECIPIENTS, "recipient_name")
    return io.extract(table, where, spark=spark)


@register("warehouse_table_slice", f"""WITH {TB.FLOWS_SQL.strip()}
SELECT recipient_name, CAST(year AS INTEGER) AS year, count(*) AS n, coalesce({S.money_sum('usd_disbursement')}, 0) AS usd_disbursement FROM flows
WHERE {CATEGORIES} = 10 AND year BETWEEN 1996 AND 1997 AND usd_disbursement > 0 AND recipient_name IN {RECIPIENTS}
GROUP BY ALL""")
def q_table_slice(spark, sf):
    """S05 + F01 with the category: only the folders of the two years are read."""
    return sliced(spark, activities(spark, sf)).groupBy("recipient_name", "year").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(money_sum("usd_disbursement"), F.lit(0.0)).alias("usd_disbursement"))


def order_tables(spark, sf):
    li = io.save_table(TB.load(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag"), _name("lines"),
                       _folder(spark, "lines"), (), ["l_orderkey"], 8)
    o = io.save_table(TB.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), _name("orders"), _folder(spark, "orders"), (), ["o_orderkey"], 8)
    return li, o


@register("bucketed_join", """SELECT o_orderstatus, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def q_bucketed(spark, sf):
    """Two tables with the same buckets: the join needs no exchange."""
    li, o = order_tables(spark, sf)
    return li.hint("merge").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


# --- S06 / P25 / X06: Kenyan sheets exported one file a year and read back in order -------
KE_ROWS_SQL = """ke AS (
  SELECT 2018 + conv_id % 5 AS year, conv_id * 1000 + turn AS place,
         CASE WHEN turn % 3 = 2 THEN 'Total Expenditure for Vote ' || t WHEN role = 'user' AND turn = 0 THEN 'Programme' ELSE t || '_x000D_' END AS program,
         CASE WHEN role = 'assistant' THEN CAST(length(t) AS VARCHAR) ELSE 'n/a' END AS value
  FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations))"""


@register("clean_budget_ke_sheets", f"""WITH {KE_ROWS_SQL},
k1 AS (SELECT *, replace(replace(replace(CASE WHEN starts_with(program, 'Total Expenditure for Vote') THEN program END,
                 'Total Expenditure for Vote ', ''), '_x005F', ''), '_x000D_', ' ') AS vote0,
              replace(replace(program, '_x005F', ''), '_x000D_', ' ') AS program1 FROM ke WHERE program <> 'Programme'),
k2 AS (SELECT *, first_value(vote0 IGNORE NULLS) OVER (PARTITION BY year ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vote FROM k1)
SELECT CAST(year AS VARCHAR) AS year, row_number() OVER (PARTITION BY year ORDER BY place) AS row_no, program1 AS program, TRY_CAST(value AS DOUBLE) AS value, vote,
       concat_ws(' ', coalesce(vote, 'NA'), coalesce(program1, 'NA')) AS text
FROM k2 WHERE vote IS NOT NULL AND NOT starts_with(program1, 'Total Expenditure for Vote')""")
def q_ke_sheets(spark, sf):
    """The sheets have no column that orders them: the order is that of their rows in the files."""
    from pyspark.sql import Window

    path = _folder(spark, "sheets")
    c = TB.load(spark, sf, "conversations").withColumn("t", F.trim(F.regexp_replace("text", "\\s+", " ")))
    program = (F.when(F.col("turn") % 3 == 2, F.concat(F.lit("Total Expenditure for Vote "), F.col("t")))
               .when((F.col("role") == "user") & (F.col("turn") == 0), F.lit("Programme")).otherwise(F.concat(F.col("t"), F.lit("_x000D_"))))
    value = F.when(F.col("role") == "assistant", F.length("t").cast("string")).otherwise(F.lit("n/a"))
    sheets = c.select((F.lit(2018) + F.col("conv_id") % 5).alias("sheet"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"),
                      program.alias("program"), value.alias("value"))
    # one file a sheet, as exported workbooks have it
    sheets = sheets.repartition("sheet").sortWithinPartitions("sheet", "place").select("sheet", "program", "value")
    sheets.write.partitionBy("sheet").option("header", True).option("escape", '"').csv(path)
    back = io.read_tagged(spark, path, "program string, value string", r"sheet=(\d{4})/", "year", multiline=False)
    out = budgets.clean_budget_ke(back.drop("sheet"), "year", "row_ord")
    no = F.row_number().over(Window.partitionBy("year").orderBy("row_ord"))  # a sheet
    return out.select("year", no.cast("bigint").alias("row_no"), "program", "value", "vote", "text")


# --- P01 / P02 / P03 / P06: columns by position, renamed, constant ----------------------
@register("reshaped_columns", """SELECT o_orderkey AS id, o_custkey AS customer, 'orders' AS origin, o_orderstatus AS status FROM orders""")
def q_reshaped(spark, sf):
    o = TB.load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    x = columns.rename(columns.keep_only(o, columns.first_columns(o, 3)), ["id", "customer", "o_orderstatus"])
    return columns.rename(columns.constant(x, "origin", "orders"), {"o_orderstatus": "status"})


# --- P18: ordinal labels (principal implies significant) --------------------------------
@register("ordinal_labels", f"""WITH {TB.RECORDS_SQL.strip()}
SELECT doc_id, sig, [CAST(coalesce(sig >= 1, false) AS DOUBLE), CAST(coalesce(sig >= 2, false) AS DOUBLE)] AS labels FROM records""")
def q_ordinal(spark, sf):
    return TB.records(spark, sf).select("doc_id", "sig", M.multi_hot("sig", (1, 2), ordinal=True).alias("labels"))


# --- T19: amounts and shares as text -----------------------------------------------------
@register("formatted_spend", """WITH s AS (SELECT o_orderstatus AS status, CAST(sum(CAST(o_totalprice AS DECIMAL(38,4))) AS DOUBLE) AS total,
  CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1)
SELECT status, '$' || format('{:,}', CAST(round_even(total, 0) AS BIGINT)) AS amount, CAST(CAST(round_even(share * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS share FROM s""")
def q_formatted(spark, sf):
    o = TB.load(spark, sf, "orders")
    s = o.groupBy(F.col("o_orderstatus").alias("status")).agg(money_sum("o_totalprice", 4).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    n = o.agg(F.count(F.lit(1))).scalar()
    return s.select("status", T.fmt_dollar("total").alias("amount"), T.fmt_percent(F.col("n") / n).alias("share"))


# --- C06: a Python function over batches of rows ------------------------------------------
@register("mapped_rows", """SELECT doc_id, lang || ':' || source AS tag, n_chars * 2 AS twice FROM documents""")
def q_mapped(spark, sf):
    def tag(pdf):
        return pdf.assign(tag=pdf.lang + ":" + pdf.source, twice=pdf.n_chars * 2)[["doc_id", "tag", "twice"]]

    return columns.map_rows(TB.load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), tag, "doc_id long, tag string, twice long")


# --- A20: sketches by language, kept, merged over all -------------------------------------
@register("sketched_percentiles", f"""{SC},
o AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM (SELECT sig_conf AS v FROM scored WHERE sig_conf IS NOT NULL)),
q AS (SELECT pri_conf AS v, row_number() OVER (ORDER BY pri_conf) AS k, count(*) OVER () AS n FROM scored WHERE pri_conf IS NOT NULL),
p AS (SELECT unnest(range(0, 5)) AS p_no, unnest([0.01, 0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS prob)
SELECT CAST(p_no AS BIGINT) AS p_no, prob, max(o.v) AS sig_conf, max(q.v) AS pri_conf
FROM p JOIN o ON o.k = greatest(1, ceil(round(prob * o.n, 6))) JOIN q ON q.k = greatest(1, ceil(round(prob * q.n, 6))) GROUP BY ALL""")
def q_sketched(spark, sf):
    """The tables compared hold fewer values than a sketch, so its quantiles are exact ranks."""
    from ..session import write_table

    cols = ["sig_conf", "pri_conf"]
    kept = write_table(selection.quantile_sketches(TB.scored(spark, sf).withColumn("part", F.col("doc_id") % 4), cols, ["part"]), "sketches")
    out = selection.sketch_percentiles(selection.merge_sketches(kept, cols), cols, curate.PROBS)
    return out.withColumn("p_no", F.col("p_no").cast("bigint"))
