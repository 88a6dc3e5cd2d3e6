"""Marker, flag and label column builders.

Internal names are snake_case; ``reference_names`` maps them to the
reference's column titles at the sink.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import any_of, col_of, fbool

SCREENED_DIGITS = (0, 1, 2)
LEVELS = ("sig", "pri")


@dataclass(frozen=True)
class Theme:
    key: str          # internal prefix: gender / adaptation / mitigation / disability
    marker: str       # declared marker column
    lexicon: str      # keyword-match group: gender / climate / disability
    group: str        # scoring model group: gender / climate / disability
    title: str        # reference title


# FIXED VALUES: the four themes, their marker columns and titles.
THEMES = (
    Theme("gender", "gender", "gender", "gender", "Gender equality"),
    Theme("adaptation", "climate_adaptation", "climate", "climate", "Climate adaptation"),
    Theme("mitigation", "climate_mitigation", "climate", "climate", "Climate mitigation"),
    Theme("disability", "disability", "disability", "disability", "Disability"),
)
THEME = {t.key: t for t in THEMES}
GROUPS = ("gender", "climate", "disability")
MARKERS = tuple(t.marker for t in THEMES)
FLAG_TITLES = {
    "principal_gender": "Principal gender equality",
    "principal_climate": "Principal all climate",
    "principal_disability": "Principal disability",
}


def pred_col(theme: str, level: str) -> str:
    return f"{theme}_{level}_pred"


def conf_col(theme: str, level: str) -> str:
    return f"{theme}_{level}_conf"


def kw_col(group: str) -> str:
    return f"{group}_kw"


def group_labels(group: str) -> list:
    """(theme, level) pairs scored by one model group, in model output order."""
    return [(t.key, lv) for t in THEMES if t.group == group for lv in LEVELS]


def prediction_columns() -> list:
    out = []
    for t in THEMES:
        for lv in LEVELS:
            out += [pred_col(t.key, lv), conf_col(t.key, lv)]
    return out + [kw_col(g) for g in GROUPS]


def reference_names() -> dict:
    """Internal -> reference column titles."""
    m = {}
    for t in THEMES:
        for lv, word in (("sig", "significant"), ("pri", "principal")):
            m[pred_col(t.key, lv)] = f"{t.title} - {word} objective predicted"
            m[conf_col(t.key, lv)] = f"{t.title} - {word} objective confidence"
    m.update({"gender_kw": "Gender keyword match", "climate_kw": "Climate keyword match",
              "disability_kw": "Disability keyword match"})
    m.update(FLAG_TITLES)
    return m


def screened(theme_or_group: str) -> Column:
    """Marker in {0,1,2}; climate is screened when either marker is."""
    if theme_or_group == "climate":
        return fbool(F.col("climate_adaptation").isin(*SCREENED_DIGITS)) | fbool(
            F.col("climate_mitigation").isin(*SCREENED_DIGITS))
    m = THEME[theme_or_group].marker if theme_or_group in THEME else theme_or_group
    return fbool(F.col(m).isin(*SCREENED_DIGITS))


def unscreened_strict() -> Column:
    """The reference's needs-scoring predicate: some theme's marker is null."""
    return (F.col("gender").isNull()
            | (F.col("climate_adaptation").isNull() & F.col("climate_mitigation").isNull())
            | F.col("disability").isNull())


def all_screened() -> Column:
    return screened("gender") & screened("climate") & screened("disability")


def seed_pred(theme: str, level: str) -> Column:
    """Declared marker as the starting prediction (null marker -> FALSE)."""
    k = 1 if level == "sig" else 2
    return fbool(F.col(THEME[theme].marker) == k)


def seed_conf(theme: str, level: str) -> Column:
    return F.when(seed_pred(theme, level), F.lit(1.0)).otherwise(F.lit(0.0))


def binarize(conf, threshold: float = 0.5) -> Column:
    """P10: strictly greater than the threshold."""
    return col_of(conf) > F.lit(threshold)


def cap_marker(c, cap: int = 2) -> Column:
    """Values above ``cap`` become ``cap``; null stays null."""
    c = col_of(c)
    return F.when(c > cap, F.lit(cap)).otherwise(c)


def case_assign(rules, default=None) -> Column:
    """``[(cond, value), ...]`` where the LAST true rule wins (R overwrites)."""
    expr = None
    for cond, val in reversed(rules):
        v = val if isinstance(val, Column) else F.lit(val)
        c = fbool(cond)
        expr = F.when(c, v) if expr is None else expr.when(c, v)
    if expr is None:
        return F.lit(default)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def marker_label(c, no: str, sig: str, pri: str) -> Column:
    """0/1/2 code -> label text; anything else keeps the ``no`` label."""
    c = col_of(c)
    return case_assign([(c == 1, sig), (c == 2, pri)], default=no)


def theme_flag(theme: str, level: str, marker: bool = True) -> Column:
    """Declared marker OR (prediction AND lexicon match), null-as-false."""
    t = THEME[theme]
    k = 2 if level == "pri" else 1
    by_model = fbool(F.col(pred_col(theme, level)) & F.col(kw_col(t.lexicon)))
    if not marker:
        return by_model
    return fbool(F.col(t.marker) == k) | by_model


def any_flag(cols) -> Column:
    """Union theme (e.g. climate = adaptation OR mitigation)."""
    return fbool(any_of(cols))


def in_set(c, values) -> Column:
    """Membership flag (null -> FALSE)."""
    return fbool(col_of(c).isin(*values))


def coalesce_sum(cols) -> Column:
    """Row-wise null-safe sum of alternates."""
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(col_of(c).cast("double"), F.lit(0.0))
    return out


def multi_hot(c, classes, ordinal: bool = False) -> Column:
    """Fixed-order multi-hot label vector from a 0/1/2 marker.

    ``classes`` are the marker values of each position (e.g. ``(1, 2)``);
    values at or above the last class count as it.  ``ordinal`` makes a
    higher class imply the lower ones.
    """
    c = col_of(c)
    top = classes[-1]
    items = []
    for v in classes:
        hit = (c >= v) if (ordinal or v == top) else (c == v)
        items.append(fbool(hit).cast("double"))
    return F.array(*items)


def concat_label(*cols) -> Column:
    """Composite stratification label ``"{a} {b}"``."""
    return F.concat_ws(" ", *[col_of(c) for c in cols])


def mask_blank(df, text_cols, blanks=("", "-")):
    """All text columns blank -> every confidence 0 and prediction FALSE."""
    blank = all_blank(text_cols, blanks)
    upd = {}
    for t in THEMES:
        for lv in LEVELS:
            if conf_col(t.key, lv) in df.columns:
                upd[conf_col(t.key, lv)] = F.when(blank, F.lit(0.0)).otherwise(F.col(conf_col(t.key, lv)))
                upd[pred_col(t.key, lv)] = F.when(blank, F.lit(False)).otherwise(F.col(pred_col(t.key, lv)))
    return df.withColumns(upd)


def all_blank(text_cols, blanks=("", "-")) -> Column:
    """blank = null or in ``blanks`` for every text column."""
    conds = [F.coalesce(col_of(c).cast("string"), F.lit("")).isin(*blanks) for c in text_cols]
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out
