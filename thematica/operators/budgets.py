"""National budget sheets: ordered fill (W01, W02), sheet normalisation
and the cross-country comparison (A09-A12, A22, X07).

Row order is data in a sheet, so every ordered operator takes an explicit
order column and a partition (the sheet / block).  A fill is a distributed
scan: rows are range-split on (block, order) so a block holding a third of all
rows is spread over many tasks; each task fills locally and a small
per-segment carry table links the segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._util import fbool, money_sum
from ..functions import markers as M
from ..functions import text as T
from .ranking import cut_segments


def _fills(df: DataFrame, cols: dict, part, ord_col: str, backward: bool, splits: int | None) -> DataFrame:
    """Fills several columns ({column: output name}) over one cut into segments:
    a fill within each segment, and one table with a row per (block, segment)
    that hands the last value of each column on.  A backward fill is a forward
    one in falling order, so no frame looks ahead."""
    part = [part] if isinstance(part, str) else list(part or [])
    x = cut_segments(df, [*part, ord_col], splits)
    seg = part + ["_seg"]
    way = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    w = Window.partitionBy(*seg).orderBy(way(ord_col)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.min_by if backward else F.max_by
    carry = x.groupBy(*seg).agg(*[last(F.col(c), F.when(F.col(c).isNotNull(), F.col(ord_col))).alias(f"_edge_{i}")
                                  for i, c in enumerate(cols)])
    cw = Window.partitionBy(*part).orderBy(way("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*[F.col(c).alias(f"_of_{c}") for c in seg],
                         *[F.last(f"_edge_{i}", ignorenulls=True).over(cw).alias(f"_carry_{i}") for i in range(len(cols))])
    x = x.withColumns({f"_local_{i}": F.last(F.col(c), ignorenulls=True).over(w) for i, c in enumerate(cols)})
    j = x.join(carry, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in seg], "left")
    j = j.withColumns({out: F.coalesce(F.col(f"_local_{i}"), F.col(f"_carry_{i}")) for i, out in enumerate(cols.values())})
    return j.drop("_seg", *[f"_of_{k}" for k in seg], *[f"_{n}_{i}" for i in range(len(cols)) for n in ("local", "carry")])


def fill_down(df: DataFrame, col: str, part, ord_col: str, out: str | None = None, splits: int | None = None) -> DataFrame:
    """Carry the last non-null value forward (zoo ``na.locf``)."""
    return _fills(df, {col: out or col}, part, ord_col, False, splits)


def fill_up(df: DataFrame, col: str, part, ord_col: str, out: str | None = None, splits: int | None = None) -> DataFrame:
    """Carry the next non-null value backward (``na.locf(fromLast=TRUE)``)."""
    return _fills(df, {col: out or col}, part, ord_col, True, splits)


# FIXED VALUES: sheet conventions of the Kenyan budget export.
KE_TOTAL_PREFIX = "Total Expenditure for Vote"
KE_HEADER = "Programme"


def clean_budget_ke(df: DataFrame, block: str = "sheet", ord_col: str = "row_ord",
                    total_prefix: str = KE_TOTAL_PREFIX, header: str = KE_HEADER) -> DataFrame:
    """X06 Kenya: program/value rows; a 'Total ... for Vote X' footer names the
    block of rows above it.  Input: program, value (string), year, block, order."""
    x = df.where(F.col("program").isNotNull() & (F.col("program") != header))
    vote = F.when(F.col("program").startswith(total_prefix), F.col("program"))  # D7: own text
    vote = F.replace(vote, F.lit(total_prefix + " "), F.lit(""))
    x = x.withColumn("vote", T.strip_artifacts(vote)).withColumn("program", T.strip_artifacts(F.col("program")))
    x = fill_up(x, "vote", block, ord_col)
    x = x.where(F.col("vote").isNotNull() & ~F.col("program").startswith(total_prefix))
    x = x.withColumn("value", F.expr("try_cast(value as double)"))
    return x.withColumn("text", T.build_text(["vote", "program"], na="NA"))


# FIXED VALUES: columns of the Ethiopian and Ugandan budget sheets.
ET_LEVELS = (("project_code", "project_name"), ("sub_program_code", "sub_program_name"),
             ("activity_code", "activity_name"), ("program_code", "program_name"),
             ("public_body_code", "public_body_name"))
ET_TEXT = ("public_body_name", "program_name", "activity_name", "sub_program_name", "project_name")
ET_OUT = ("year", "type", "public_body_name", "program_name", "activity_name", "sub_program_name",
          "project_name", "text", "treasury", "retained", "assistance", "loan", "total")


def clean_budget_et(df: DataFrame, ord_col: str = "row_ord", part=("year", "type")) -> DataFrame:
    """X06 Ethiopia: a code column marks the hierarchy level of a row; names are
    carried down to the detail rows.  ``part=None`` fills across sheets (D6)."""
    for c in ("retained", "assistance", "loan", "sub_program_code", "project_code"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    x = df.withColumns({name: F.when(F.col(code).isNotNull(), F.col("description")) for code, name in ET_LEVELS})
    x = _fills(x, {name: name for _, name in ET_LEVELS}, list(part) if part else [], ord_col, False, None)
    x = x.where(((F.col("type") == "recurrent") & F.col("activity_code").isNotNull())
                | ((F.col("type") == "capital") & F.col("project_code").isNotNull()))
    x = x.withColumn("text", T.build_text(ET_TEXT))
    return x.select(*ET_OUT)


UG_TEXT = ("Vote", "Programme", "SubProgramme", "KeyOutputDescription", "Description")


def clean_budget_ug(df: DataFrame) -> DataFrame:
    """X06 Uganda: drop prior flag columns, text = paste of five columns (NA kept)."""
    df = df.drop(*[c for c in ("Gender", "Climate", "Disability") if c in df.columns])
    for c in UG_TEXT:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumn("text", T.build_text(UG_TEXT, na="NA"))


def drop_aggregate_lines(df: DataFrame, program: str = "program", suffix: str = "000") -> DataFrame:
    """Kenyan aggregate lines have a program number ending in 000."""
    return df.where(~fbool(T.first_token(F.col(program)).endswith(suffix)))


FLAGS = ("principal_gender", "principal_climate", "principal_disability")
# FIXED VALUES: group labels, later rule wins (disability > climate > gender, D9).
LABEL_RULES = (("principal_gender", "Gender"), ("principal_climate", "Climate change"),
               ("principal_disability", "Disability"))


def budget_value(df: DataFrame, amounts, country: str = "country", flags=FLAGS) -> DataFrame:
    """Per country and flag combination, null-safe sums of one or more
    alternate amount columns added together (P21)."""
    amounts = [amounts] if isinstance(amounts, str) else list(amounts)
    sums = [F.coalesce(money_sum(a), F.lit(0.0)) for a in amounts]
    v = sums[0]
    for s in sums[1:]:
        v = v + s
    return df.groupBy(country, *flags).agg(v.alias("value"))


def budget_count(df: DataFrame, country: str = "country", flags=FLAGS) -> DataFrame:
    """A10: number of lines per country and flag combination."""
    return df.groupBy(country, *flags).agg(F.count(F.lit(1)).alias("value"))


def share_of_total(df: DataFrame, value: str = "value", part: str = "country") -> DataFrame:
    """Total over all combinations of the country, and the share."""
    tot = F.sum(value).over(Window.partitionBy(part))
    return df.withColumn("total", tot).withColumn("percentage", F.try_divide(F.col(value), F.col("total")))


def label_groups(df: DataFrame, rules=LABEL_RULES) -> DataFrame:
    """P07 + F25: label each combination (last true rule wins), drop unlabelled."""
    lab = M.case_assign([(F.col(f), name) for f, name in rules], default="")
    return df.withColumn("label", lab).where(F.col("label") != "")


def compare_budgets(df: DataFrame, metric: str = "value", amounts=("amount",),
                    country: str = "country", flags=FLAGS) -> DataFrame:
    """Per-country totals by flag combination, shares, labels."""
    agg = budget_value(df, amounts, country, flags) if metric == "value" else budget_count(df, country, flags)
    return label_groups(share_of_total(agg, "value", country))


def max_by_label(df: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """Largest value per label (axis limits in the reference's charts)."""
    return df.groupBy(label).agg(F.max(value).alias("max_value"))
