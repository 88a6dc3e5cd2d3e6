"""Text, string and math scalars (T01-T19) as JVM-side column expressions.

Every function takes and returns a ``Column`` so that it stays inside
whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import col_of

# Letters, digits and underscore are word characters (Unicode-aware, unlike
# Java/RE2 ``\w`` which are ASCII-only); any run of other characters becomes
# one space.
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"
# R's [[:punct:]] under ICU: Unicode punctuation (symbols such as € survive,
# the connector ``_`` does not).
PUNCT = r"\p{P}"
WS_RUN = r"[\s\p{Z}]+"


def clean_text(c) -> Column:
    """Non-word runs -> one space, trim, lower; empty -> null."""
    c = col_of(c)
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, NON_WORD_RUN, " "))), F.lit(""))


def clean_text_r(c) -> Column:
    """Lower -> punctuation to space -> collapse whitespace -> trim.

    Unlike T01 an all-blank input stays ``''`` (not null), as in R.
    """
    c = col_of(c)
    s = F.regexp_replace(F.lower(c), PUNCT, " ")
    s = F.regexp_replace(s, WS_RUN, " ")
    return F.trim(s)


def build_text(cols, na: str | None = None) -> Column:
    """Join text columns with one space.

    ``na=None`` skips nulls (python ``' '.join`` of non-None, tidyr
    ``unite(na.rm=TRUE)``); ``na='NA'`` writes the text NA like R ``paste``.
    """
    cs = [col_of(c).cast("string") for c in cols]
    if na is not None:
        cs = [F.coalesce(c, F.lit(na)) for c in cs]
    return F.concat_ws(" ", *cs)


def tokens(clean, min_len: int = 1) -> Column:
    """Split a cleaned text into word tokens (optionally >= min_len chars)."""
    t = F.split(F.coalesce(col_of(clean), F.lit("")), " ")
    return F.filter(t, lambda x: F.length(x) >= F.lit(max(min_len, 1)))


def first_token(c) -> Column:
    """First space-separated token."""
    return F.element_at(F.split(col_of(c), " "), 1)


def strip_artifacts(c) -> Column:
    """Spreadsheet XML escapes left in exported text."""
    c = col_of(c)
    return F.replace(F.replace(c, F.lit("_x005F"), F.lit("")), F.lit("_x000D_"), F.lit(" "))


def year_prefix(c) -> Column:
    """Year from the first four characters of a date text (junk -> null)."""
    return F.expr(f"try_cast(substr({_sql(c)}, 1, 4) as int)")


def char_length(c) -> Column:
    return F.length(col_of(c))


def space_count(c) -> Column:
    """Number of spaces, the reference's token estimate."""
    c = col_of(c)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def chunk_tokens(tok, max_tokens: int = 512) -> Column:
    """Balanced chunks of a token array.

    n = ceil(L/max) chunks of ceil(L/n) tokens; L <= max gives one chunk;
    an empty or null token array gives an empty chunk list.  Pass a column
    reference: the array is used inside a lambda, where an expression would
    be re-evaluated for every chunk.
    """
    tok = col_of(tok)
    L = F.size(tok)
    n = F.ceil(L / F.lit(max_tokens))
    sz = F.ceil(L / n).cast("int")
    return F.when(
        tok.isNull() | (L <= 0), F.array().cast("array<array<string>>")
    ).otherwise(
        F.transform(F.sequence(F.lit(0), L - 1, sz), lambda i: F.slice(tok, i + 1, sz))
    )


def levenshtein_ratio(a, b, max_ratio: float | None = None) -> Column:
    """Edit distance / length(a).

    With ``max_ratio`` the banded (early-exit) distance is used; a pair that
    is provably farther than the ratio gets the ratio ``+inf``-like value 1e9
    instead of its exact distance.  The length difference is a lower bound
    of the distance, so such pairs are rejected before any DP work.
    """
    a, b = col_of(a), col_of(b)
    la = F.length(a)
    if max_ratio is None:
        return F.try_divide(F.levenshtein(a, b).cast("double"), la.cast("double"))
    thr = F.ceil(la * F.lit(max_ratio)).cast("int")
    far = F.abs(la - F.length(b)) > thr
    d = F.call_function("levenshtein", a, b, thr)
    return F.when(la == 0, F.lit(None).cast("double")).when(
        far | (d < 0), F.lit(1e9)
    ).otherwise(d.cast("double") / la.cast("double"))


def sigmoid(x) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(x)))


def fmt_dollar(x, scale: float = 1.0) -> Column:
    """Currency text, whole dollars (``$1,234``)."""
    return F.concat(F.lit("$"), F.format_number(col_of(x) * F.lit(scale), 0))


def fmt_percent(x) -> Column:
    """Percent text, whole percent, half-even (``45%``)."""
    return F.concat(F.bround(col_of(x) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("year_prefix needs a column name")
