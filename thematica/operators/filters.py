"""Filters and predicates (F01-F15, F22-F26) as boolean Columns / where().

All predicates are plain column expressions so Catalyst pushes the simple
ones (equality, ranges, IN, IS NOT NULL, prefix) into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import any_of, fbool
from ..functions import markers as M
from ..functions import text as T


def warehouse_slice(category: int | None = 10, years=(2018, 2022), amount: str = "usd_disbursement_deflated",
                    recipients=None, recipient_col: str = "recipient_iso3_code") -> Column:
    """category equality, inclusive year range, positive amount, IN list."""
    c = F.col("year").between(*years) & (F.col(amount) > 0)
    if category is not None:
        c = (F.col("category") == category) & c
    if recipients is not None:
        c = c & F.col(recipient_col).isin(*recipients)
    return c


def exclude_regions(regions, name_patterns, region_col: str = "region_name",
                    name_col: str = "recipient_name") -> Column:
    """NOT IN regions and NOT ILIKE patterns (null -> row dropped)."""
    c = ~F.col(region_col).isin(*regions)
    for p in name_patterns:
        c = c & ~F.col(name_col).ilike(p)
    return c


def declared(flag: str | None, sig_cols, domain=(0, 1, 2)) -> Column:
    """theme declared (boolean flag column) and marker(s) in the domain
    (several marker columns are OR-ed)."""
    sig_cols = [sig_cols] if isinstance(sig_cols, str) else list(sig_cols)
    c = any_of([fbool(F.col(s).isin(*domain)) for s in sig_cols])
    return c if flag is None else fbool(F.col(flag)) & c


def usable_text(text: str = "text", min_len: int = 10) -> Column:
    """non-null, non-empty, longer than ``min_len`` characters."""
    t = F.col(text)
    return t.isNotNull() & (t != "") & (F.length(t) > min_len)


def fits_context(text: str = "text", min_len: int = 10, max_spaces: int = 500) -> Column:
    """length > min_len and fewer than ``max_spaces`` spaces."""
    t = F.col(text)
    return fbool((F.length(t) > min_len) & (T.space_count(t) < max_spaces))


def drop_unmatched_positive(match: str = "match", sig: str = "sig") -> Column:
    """keep lexicon matches, and non-matches only when the marker is 0."""
    return (F.col(match) == "True") | (F.col(sig) == 0)


def drop_matched_negative(match: str = "match", sig: str = "sig") -> Column:
    """drop lexicon matches whose marker is 0 (three-valued: null drops)."""
    return ~((F.col(match) == "True") & (F.col(sig) == 0))


def partition_screened(df: DataFrame, strict: bool = False):
    """(fully screened, needs scoring) as two filtered frames."""
    needs = M.unscreened_strict() if strict else ~M.all_screened()
    return df.where(M.all_screened()), df.where(needs)


def principal_declared() -> Column:
    """either climate marker is 2."""
    return (F.col("climate_adaptation") == 2) | (F.col("climate_mitigation") == 2)


def drop_blank(text_cols, blanks=("", "-", " ")) -> Column:
    """not every text column blank."""
    return ~M.all_blank(text_cols, blanks)


def any_theme(flags=("principal_gender", "principal_climate", "principal_disability")) -> Column:
    """at least one flag."""
    return any_of([fbool(f) for f in flags])


def removal_not_flagged(col: str = "Remove") -> Column:
    """curation removal mark is null."""
    return F.col(col).isNull()


def commitment_window(years=(2018, 2022), col: str = "commitment_year") -> Column:
    """commitment year inside an inclusive window."""
    return F.col(col).between(*years)


def labelled_year(marker: str = "gender", year: int = 2022) -> Column:
    """marker present and a given year."""
    return F.col(marker).isNotNull() & (F.col("year") == year)
