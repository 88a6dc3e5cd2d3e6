"""Selecting by rank without ranking rows: exact percentiles (A20), stored
quantile sketches, and the first rows of each stratum in a hash order (W06, O04, O06).

No operator here sorts a table or numbers its rows.  Values are bracketed and
counted, hashes are counted by their leading digits; what is counted collapses
within each task, so a value that half of all rows hold costs one row a task.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, write_table
from .ranking import rank_within

#: accuracy parameter of the sketches: rank error about 1.4 / SKETCH_K (two-sided, 99 %), exact below SKETCH_K values
SKETCH_K = 4096
#: distinct values that may be counted one by one (they go to the driver)
VALUES = 100_000
MOST_ROUNDS = 30


# ---------------------------------------------------------------------------
# A20, approximate: sketches that are stored and merged
# ---------------------------------------------------------------------------

def quantile_sketches(df: DataFrame, cols, by=(), k: int = SKETCH_K) -> DataFrame:
    """One row a group with a sketch (binary, ``<col>_sketch``) of each column and the
    number of its values (``<col>_n``): all columns in one scan.  Rows of
    a table of sketches can be kept and merged later (``merge_sketches``)."""
    by, cols = list(by), list(cols)
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.kll_sketch_agg_double(v, F.lit(k)).alias(f"{c}_sketch"), F.count(v).alias(f"{c}_n")]
    return df.groupBy(*by).agg(*aggs)


def merge_sketches(sketches: DataFrame, cols, by=()) -> DataFrame:
    """Sketches of fewer, larger groups, from the sketches alone."""
    aggs = []
    for c in cols:
        aggs += [F.kll_merge_agg_double(F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sketch"))).alias(f"{c}_sketch"), F.sum(f"{c}_n").alias(f"{c}_n")]
    return sketches.groupBy(*by).agg(*aggs)


def sketch_percentiles(sketches: DataFrame, cols, probs, by=()) -> DataFrame:
    """(by, p_no, prob, one column a sketched column): null where a group has no value."""
    ps = F.array(*[F.lit(float(p)) for p in probs])
    vals = [F.when(F.col(f"{c}_n") > 0, F.kll_sketch_get_quantile_double(f"{c}_sketch", ps)).alias(c) for c in cols]
    x = sketches.select(*by, *vals)
    x = x.select(*by, *cols, F.posexplode(ps).alias("p_no", "prob"))
    return x.select(*by, "p_no", "prob", *[F.element_at(F.col(c), F.col("p_no") + 1).alias(c) for c in cols])


# ---------------------------------------------------------------------------
# A20, exact: the values at given ranks
# ---------------------------------------------------------------------------

class _Search:
    """Looks for the values at some neighbouring ranks (from 0) of one column."""

    def __init__(self, col: str, ranks):
        self.col, self.ranks = col, sorted(set(ranks))
        self.lo = self.hi = None   # the bracket, both ends included; None: open
        self.found: dict[int, float] = {}

    def inside(self) -> Column:
        c = F.lit(True)
        if self.lo is not None:
            c = c & (F.col(self.col) >= self.lo)
        if self.hi is not None:
            c = c & (F.col(self.col) <= self.hi)
        return F.col(self.col).isNotNull() & c


def _count_by_value(vals: DataFrame, searches: list[_Search], below: list[int]) -> None:
    """Reads the ranks off the counts of the values within each bracket, at most ``VALUES`` in all."""
    pairs = F.array(*[F.when(s.inside(), F.struct(F.lit(i).alias("j"), F.col(s.col).alias("v"))) for i, s in enumerate(searches)])
    got = vals.select(F.inline(F.filter(pairs, lambda p: p.isNotNull()))).groupBy("j", "v").agg(F.count(F.lit(1)).alias("n")).collect()
    by = {}
    for r in got:
        by.setdefault(r["j"], []).append((r["v"], r["n"]))
    for i, s in enumerate(searches):
        rows = sorted(by.get(i, ()))
        ends = list(accumulate((n for _, n in rows), initial=below[i]))[1:]  # ranks before the next value
        for r in s.ranks:
            at = bisect_left(ends, r + 1)
            if r >= below[i] and at < len(rows):
                s.found[r] = rows[at][0]


def _narrow(vals: DataFrame, searches: list[_Search], below: list[int], inside: list[int], k: int) -> None:
    """A narrower bracket for each search, from a sketch of what its bracket holds."""
    aggs = [F.kll_sketch_agg_double(F.when(s.inside(), F.col(s.col)), F.lit(k)).alias(f"k{i}") for i, s in enumerate(searches)]
    margin = 3.0 / k  # over twice the sketch's rank error
    quantiles = []
    for i, s in enumerate(searches):
        lo, hi = ((r - below[i]) / max(inside[i], 1) for r in (s.ranks[0], s.ranks[-1] + 1))
        quantiles.append(F.kll_sketch_get_quantile_double(f"k{i}", F.array(F.lit(max(lo - margin, 0.0)), F.lit(min(hi + margin, 1.0)))).alias(f"q{i}"))
    row = vals.agg(*aggs).select(*quantiles).head()
    for i, s in enumerate(searches):
        lo, hi = row[f"q{i}"]
        # ends that the sketch gives as its least or greatest value stay as they are
        s.lo = lo if s.lo is None or lo > s.lo else s.lo
        s.hi = hi if s.hi is None or hi < s.hi else s.hi


def values_at_ranks(df: DataFrame, ranks: dict, counts: dict | None = None, k: int = SKETCH_K, most: int = VALUES) -> dict:
    """``{col: {rank: value}}`` for ``{col: [ranks from 0]}`` over the values of each column that
    are neither null nor NaN, in ascending order.  Exact.

    Each pass brackets every wanted rank by a sketch of what its bracket still holds, and counts the
    rows below and inside.  A bracket that holds too many values shrinks to about 6/k of them a pass;
    one that misses its rank (a sketch errs beyond its bound once in a hundred times) is
    opened again.  When ``most`` rows are left, or only one value, they are counted by value.
    """
    cols = list(ranks)
    vals = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    if counts is None:
        row = vals.agg(*[F.count(c).alias(c) for c in cols]).head()
        counts = {c: row[c] for c in cols}
    out: dict = {c: {} for c in cols}
    todo = []
    for c in cols:
        rs = sorted({r for r in ranks[c] if 0 <= r < counts[c]})
        if sum(counts.values()) <= most:
            todo += [_Search(c, rs)] if rs else []
        else:  # neighbours share a bracket
            for r in rs:
                if todo and todo[-1].col == c and r - todo[-1].ranks[-1] <= 1:
                    todo[-1].ranks.append(r)
                else:
                    todo.append(_Search(c, [r]))
    rounds = 0
    while todo:
        below, inside = [0] * len(todo), [counts[s.col] for s in todo]
        for _ in range(MOST_ROUNDS):
            rounds += 1
            small = [i for i, s in enumerate(todo) if inside[i] <= most // len(todo) or s.lo is not None and s.lo == s.hi]
            if len(small) == len(todo):
                break
            large = [i for i in range(len(todo)) if i not in small]
            old = [(todo[i].lo, todo[i].hi) for i in large]
            _narrow(vals, [todo[i] for i in large], [below[i] for i in large], [inside[i] for i in large], k)
            aggs = []
            for i in large:
                s = todo[i]
                aggs += [F.sum(F.when(F.col(s.col) < s.lo, 1).otherwise(0)).alias(f"b{i}"), F.sum(F.when(s.inside(), 1).otherwise(0)).alias(f"i{i}")]
            row = vals.agg(*aggs).head()
            for i, ends in zip(large, old, strict=True):
                s, b, n = todo[i], row[f"b{i}"], row[f"i{i}"]
                if b <= s.ranks[0] and s.ranks[-1] < b + n:
                    below[i], inside[i] = b, n
                else:
                    s.lo, s.hi = ends
        _count_by_value(vals, todo, below)
        for s in todo:
            out[s.col] |= s.found
        todo = [s for s in todo if len(s.found) < len(s.ranks)]
        if rounds > 4 * MOST_ROUNDS:
            raise RuntimeError("ranks were not found")
        for s in todo:
            s.lo = s.hi = None
    return out


def exact_percentiles(df: DataFrame, cols, probs, k: int = SKETCH_K, most: int = VALUES) -> DataFrame:
    """Percentiles with linear interpolation, one row per probability and one column per input column.

    NaN sorts after all numbers, as in Spark.  The columns are written once; each pass over them returns a few
    numbers a column, or at most ``most`` counted values."""
    spark = df.sparkSession
    vals = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    row = vals.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(f"n_{c}") for c in cols], *[F.count(c).alias(f"a_{c}") for c in cols]).head()
    at, ranks = {}, {}
    for c in cols:
        pos = [(row[f"a_{c}"] - 1) * float(p) for p in probs]
        at[c] = pos
        ranks[c] = [r for p in pos if row[f"a_{c}"] for r in (int(p), -int(-p // 1))]
    found = values_at_ranks(vals, ranks, {c: row[f"n_{c}"] for c in cols}, k, most)

    def value(c, i):
        if not row[f"a_{c}"]:
            return None
        pos = at[c][i]
        lo, hi = int(pos), -int(-pos // 1)
        a, b = (found[c].get(r, float("nan")) for r in (lo, hi))
        return a + (pos - lo) * (b - a)

    rows = [(i, float(p), *[value(c, i) for c in cols]) for i, p in enumerate(probs)]
    schema = "p_no int, prob double, " + ", ".join(f"`{c}` double" for c in cols)
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# The first rows of each stratum in a hash order
# ---------------------------------------------------------------------------
#: hex digits of a hash that one pass counts by, at most
DIGITS = 4
#: rows of one stratum that share a hash's leading digits and are put in order
TIED = 10_000


def first_of_each(df: DataFrame, hashed: str, keys, wanted, part: str | None = None, out: str = "chosen", tied: int = TIED) -> DataFrame:
    """Marks the first rows of each stratum in the order of (``hashed``, ``keys``): exactly as many as ``wanted`` says.

    ``wanted`` is a table (part, k), one row a stratum (null strata are equal), or a function from the column of a stratum's
    row count to the number wanted, which needs no pass of its own.

    ``hashed`` is a hex hash, so its leading digits cut a stratum into even parts.  A pass counts rows by (stratum, digits);
    the part in which the wanted number falls is cut again while it holds more than ``tied`` rows.  Rows before it are chosen and
    rows after it are not, by comparing digits; only the part itself is put in order.  ``df`` is read once a pass, without its
    other columns, and twice at the end.
    """
    keys = list(keys)
    rows = df.withColumn("_p", F.col(part) if part else F.lit(0))
    step = DIGITS
    w = Window.partitionBy("_p").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)  # at most 16^DIGITS rows a stratum
    counts = rows.groupBy("_p", F.substring(hashed, 1, step).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_to", F.sum("_n").over(w))
    every, most = None, None
    if callable(wanted):
        counts = counts.withColumn("_k", wanted(F.sum("_n").over(Window.partitionBy("_p"))).cast("long"))
    elif part is None:  # one stratum: one number
        most = int(wanted.head()["k"])
        counts = counts.withColumn("_k", F.lit(most).cast("long"))
    else:  # a small table with a known size: joining it does not deal rows by stratum
        every = write_table(wanted.select(F.col(part).alias("_q"), F.col("k").cast("long").alias("_k")), "wanted")
        counts = counts.join(every, F.col("_p").eqNullSafe(F.col("_q")))
    counts = counts.withColumn("_open", F.lit(""))

    def with_state(state: DataFrame, how: str) -> DataFrame:
        """``rows`` with their stratum's cut: for one stratum the values themselves, no join."""
        if part is not None:
            return rows.join(state, F.col("_p").eqNullSafe(F.col("_q")), how)
        r = state.head()
        kind = {"_q": "int", "_k": "long", "_open": "string"}
        x = rows.withColumns({c: F.lit(r[c] if r else None).cast(t) for c, t in kind.items()})
        return x if r or how == "left" else x.where(F.lit(False))

    depth = 0
    while True:
        cut = counts.where((F.col("_to") >= F.col("_k")) & (F.col("_to") - F.col("_n") < F.col("_k")))
        state = write_table(cut.select(F.col("_p").alias("_q"), (F.col("_k") - F.col("_to") + F.col("_n")).alias("_k"), F.concat("_open", "_d").alias("_open"),
                                       "_n"), "cuts")
        depth += step
        largest = state.agg(F.max("_n")).head()[0] or 0
        state = state.drop("_n")
        if largest <= tied or depth >= 32:
            break
        inside = with_state(state, "inner").where(F.col(hashed).startswith(F.col("_open")))
        counts = inside.groupBy("_p", "_k", "_open", F.substring(hashed, depth + 1, step).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_to", F.sum("_n").over(w))
    marked = with_state(state, "left")
    open_ = F.substring(hashed, 1, depth)
    at_cut = F.coalesce(open_ == F.col("_open"), F.lit(False))
    # a stratum without a cut wants none of its rows, or more than it has
    whole = F.lit(bool(most))
    if every is not None:
        marked = marked.join(every.select(F.col("_q").alias("_r"), F.col("_k").alias("_all")), F.col("_p").eqNullSafe(F.col("_r")), "left")
        whole = F.coalesce(F.col("_all") > 0, F.lit(False))
    clear = marked.where(~at_cut).withColumn(out, F.when(F.col("_open").isNotNull(), open_ < F.col("_open")).otherwise(whole))
    cols = df.columns
    tie = marked.where(at_cut).select(*cols, "_q", "_k")
    if largest <= tied:  # so a window holds at most that many rows
        tie = tie.withColumn("_rank", F.row_number().over(Window.partitionBy("_q").orderBy(hashed, *keys)))
    else:  # rows with one and the same hash: numbered as they are written
        tie = write_table(tie.withColumn("_i", F.monotonically_increasing_id()), "tied")
        tie = rank_within(tie, ["_q"], [hashed, *keys, "_i"], "_rank", cut=[hashed, "_i"])
    return clear.select(*cols, out).unionByName(tie.select(*cols, (F.col("_rank") <= F.col("_k")).alias(out)))
