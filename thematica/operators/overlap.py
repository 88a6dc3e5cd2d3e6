"""Money by overlapping theme flags (A01-A08), replication (G01), element
ranges (G02), intersections (U05) and zero-fill (U06).

All aggregates are one ``groupBy`` with map-side partial aggregation: the
shuffle carries one row per (task, group), so a hot group (a flag
combination holding a third of the rows) costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._util import MONEY_SCALE, any_of, fbool, money_sum
from .ranking import cut_segments

FLAGS = ("principal_gender", "principal_climate", "principal_disability")


def overlap_by(df: DataFrame, keys=("year",), flags=FLAGS, amount: str = "usd_disbursement",
               out: str | None = None, any_only: bool = False, digits: int | None = None,
               exact_scale: int | None = MONEY_SCALE) -> DataFrame:
    """Amount by keys x flag combination; all-null group sums to 0.

    ``any_only`` keeps rows with at least one flag (A05).  Sums are exact
    decimals (``money_sum``) unless ``exact_scale=None``.
    """
    if any_only:
        df = df.where(any_of([fbool(f) for f in flags]))
    s = F.coalesce(money_sum(amount, exact_scale), F.lit(0.0))
    if digits is not None:
        s = F.round(s, digits)
    return df.groupBy(*keys, *flags).agg(s.alias(out or amount))


def overlap_rollup(df: DataFrame, keys=("year",), flags=FLAGS, amount: str = "usd_disbursement",
                   digits: int | None = None, exact_scale: int | None = MONEY_SCALE) -> DataFrame:
    """Keys x flags and flags-only (any-flag rows) in one pass.

    ``GROUPING SETS`` share the scan and the partial aggregation; the
    flags-only level keeps only combinations with a flag set, like A05.
    """
    s = F.coalesce(money_sum(amount, exact_scale), F.lit(0.0))
    if digits is not None:
        s = F.round(s, digits)
    cols = [F.col(c) for c in (*keys, *flags)]
    g = df.groupingSets([cols, [F.col(f) for f in flags]], *cols).agg(
        s.alias(amount), F.grouping(F.col(keys[0])).alias("is_total"))
    return g.where((F.col("is_total") == 0) | any_of([fbool(f) for f in flags])).withColumn(
        "is_total", F.col("is_total").cast("boolean"))


def set_sizes(venn: DataFrame, g: str = "Gender", c: str = "Climate", d: str = "Disability",
              amount: str = "usd_disbursement", rounded: bool = True) -> DataFrame:
    """Single, pairwise and triple set sizes from a flag-combination table.

    R ``round`` is half-to-even (``bround``).
    """
    def s(cond):
        v = F.coalesce(F.sum(F.when(cond, F.col(amount))), F.lit(0.0))
        return F.bround(v, 0) if rounded else v

    G, C, D = fbool(F.col(g)), fbool(F.col(c)), fbool(F.col(d))
    return venn.agg(
        s(C).alias("c"), s(G).alias("g"), s(D).alias("d"),
        s(C & G).alias("cg"), s(C & D).alias("cd"), s(G & D).alias("gd"),
        s(G & D & C).alias("cgd"))


def venn_regions(sizes: DataFrame) -> DataFrame:
    """Disjoint region sizes from set sizes (inclusion-exclusion)."""
    c, g, d, cg, cd, gd, cgd = (F.col(x) for x in ("c", "g", "d", "cg", "cd", "gd", "cgd"))
    return sizes.select(
        (c - cg - cd + cgd).alias("only_c"), (g - cg - gd + cgd).alias("only_g"),
        (d - cd - gd + cgd).alias("only_d"), (cg - cgd).alias("cg_only"),
        (cd - cgd).alias("cd_only"), (gd - cgd).alias("gd_only"), cgd.alias("cgd"),
        (c + g + d - cg - cd - gd + cgd).alias("union_size"))


def element_ranges(sizes: DataFrame) -> DataFrame:
    """The integer element sets that encode the overlaps, as ranges.

    Climate is 1..c; gender is 1..cg plus a fresh block; disability is
    1..cgd, the gender-only overlap block, the climate-only overlap block and
    a fresh block.  Ranges (set, lo, hi) stay compact; ``explode_ranges``
    materialises elements only if asked.
    """
    c, g, d, cg, cd, gd, cgd = (F.col(x) for x in ("c", "g", "d", "cg", "cd", "gd", "cgd"))
    g0 = c + 1
    g_rem = (g - cg) - 1
    d0 = g0 + g_rem + 1
    rows = [
        ("climate", F.lit(1), c),
        ("gender", F.lit(1), cg),
        ("gender", g0, g0 + g_rem),
        ("disability", F.lit(1), cgd),
        ("disability", g0, g0 + (gd - cgd) - 1),
        ("disability", cg + 1, cg + 1 + (cd - cgd) - 1),
        ("disability", d0, d0 + (((d - cd) - gd) + cgd) - 1),
    ]
    parts = F.array(*[F.struct(F.lit(n).alias("set_name"), lo.cast("long").alias("lo"),
                               hi.cast("long").alias("hi")) for n, lo, hi in rows])
    return sizes.select(F.inline(parts)).where(F.col("hi") >= F.col("lo"))


def intersect_sizes(ranges: DataFrame, pairs, splits: int | None = None) -> DataFrame:
    """|A n B| of each pair of sets (a, b, size) from range lists (set_name, lo, hi), by one sweep.

    The bounds of all ranges are sorted positions at which a set's count of open ranges rises or falls;
    between two positions a pair's sets overlap where both counts are above zero.  Ranges of a set may
    overlap each other.  The order is cut into segments, with counts and next positions handed on
    by a table of one row a segment, so no task holds all bounds and no pair of ranges is formed.
    """
    names = sorted({n for p in pairs for n in p})
    at = {n: f"_c{i}" for i, n in enumerate(names)}
    x = ranges.where(F.col("set_name").isin(*names) & (F.col("hi") >= F.col("lo")))
    ends = F.array(F.struct(F.col("lo").cast("long").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).cast("long").alias("pos"), F.lit(-1).alias("d")))
    x = x.select("set_name", F.inline(ends)).groupBy("pos").agg(
        *[F.sum(F.when(F.col("set_name") == n, F.col("d")).otherwise(0)).alias(c) for n, c in at.items()])
    x = cut_segments(x, ["pos"], splits)
    w = Window.partitionBy("_seg").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    local = x.select("_seg", "pos", F.lead("pos").over(w).alias("_next"), *[F.sum(c).over(so_far).alias(c) for c in at.values()])
    each = Window.orderBy("_of")  # one row a segment
    before = each.rowsBetween(Window.unboundedPreceding, -1)
    seg = x.groupBy(F.col("_seg").alias("_of")).agg(F.min("pos").alias("_first"), *[F.sum(c).alias(f"_t{c}") for c in at.values()])
    seg = seg.select("_of", F.lead("_first").over(each).alias("_then"), *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_t{c}") for c in at.values()])
    j = local.join(F.broadcast(seg), F.col("_seg") == F.col("_of"))  # at most as many rows as segments
    width = F.coalesce("_next", "_then") - F.col("pos")

    def is_open(n):
        return F.col(at[n]) + F.col(f"_t{at[n]}") > 0

    sums = j.agg(*[F.coalesce(F.sum(F.when(is_open(a) & is_open(b), width)), F.lit(0)).cast("long").alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{i}").alias("size")) for i, (a, b) in enumerate(pairs)])))


def intersect_size(ranges: DataFrame, a: str, b: str) -> DataFrame:
    """U05 for one pair of sets: one row (size)."""
    return intersect_sizes(ranges, [(a, b)]).select("size")


BLOCK = 100_000


def replicate(df: DataFrame, count_col: str, block: int = BLOCK, spread: int | None = None) -> DataFrame:
    """Each row repeated ceil(count) times (count <= 0 or null: dropped).

    Rows are generated in blocks of at most ``block`` copies so that no single
    array is unbounded; ``spread`` repartitions the blocks over that many
    tasks before the final explode, so one huge count is split across tasks.
    """
    n = F.ceil(F.col(count_col)).cast("long")
    nb = F.ceil(n / F.lit(block)).cast("long")
    x = df.where(n > 0).withColumn("_n", n).withColumn(
        "_blk", F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)))
    if spread:
        x = x.repartition(spread)
    lo = F.col("_blk") * block + 1
    hi = F.least(F.col("_n"), (F.col("_blk") + 1) * block)
    return x.withColumn("copy_no", F.explode(F.sequence(lo, hi))).drop("_n", "_blk", count_col)


def complete(df: DataFrame, row_key: str, col_key: str, col_values, value: str, fill=0) -> DataFrame:
    """Zero-fill the (row_key x col_values) grid without a cross join.

    A pivot over the declared ``col_values`` puts every value on every row
    key (missing -> fill), then ``unpivot`` returns to long form.
    """
    vals = list(col_values)
    wide = df.groupBy(row_key).pivot(col_key, vals).agg(F.first(value))
    wide = wide.fillna({v: fill for v in vals}) if fill is not None else wide
    return wide.unpivot([row_key], vals, col_key, value)
