"""Exact ranks inside (possibly huge) groups without a single-task sort.

``row_number().over(Window.partitionBy(g).orderBy(o))`` sorts every row of a
group in one task; a group holding a third of the data then stalls the job.
``rank_within`` range-partitions on (group, order) so a hot group is cut into
many segments, numbers rows inside each segment, and adds the count of the
group's earlier segments from a small (group x segment) count table.

The segment of a row is written down with the row (``cut_segments``).  Range
partitioning samples its input, so an exchange planned a second time, with
other columns, may cut elsewhere; the rows and the table of segments must come
from one and the same cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table

#: sampled rows a segment, and characters of text sampled in all (they go to the driver)
OVERSAMPLE = 16
SAMPLE_CHARS = 1 << 25
LONGEST_SAMPLE = 1 << 14


def cut_segments(df: DataFrame, keys, splits: int | None = None, out: str = "_seg") -> DataFrame:
    """Rows with the number of their segment in the order of ``keys`` (columns
    of bounded width: they are sampled to the driver).  Written once, so that
    every reader sees the same segments."""
    n = splits or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    return write_table(df.repartitionByRange(n, *keys).withColumn(out, F.spark_partition_id()), "segments")


def _apart(text: str, before: str) -> str:
    """The shortest opening of ``text`` that sorts after ``before``, a lesser text."""
    lo, hi = 0, min(len(text), len(before))
    while lo < hi:  # length of the common opening
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if text[:mid] == before[:mid] else (lo, mid - 1)
    return text[:lo + 1]


def text_splitters(df: DataFrame, col: str, tiebreak: str | None = None, splits: int | None = None) -> list[tuple]:
    """Where to cut the order of (col, tiebreak) into ``splits`` segments of like size.

    Splitters (text, tiebreak) come from a hash sample of the rows.  Each is the shortest
    opening that sets its sampled text apart from the sampled one before, however long
    the opening that both share; where sampled texts are equal, the tiebreak
    cuts between them.  Splitters only decide how rows are dealt: texts are sampled to a
    length that holds ``SAMPLE_CHARS`` for the whole sample, and openings
    that agree beyond it share a segment."""
    n = splits or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count()
    if n < 2 or not rows:
        return []
    of = [F.col(col), *([F.col(tiebreak)] if tiebreak else [])]
    every = max(1, rows // (OVERSAMPLE * n))
    longest = max(64, min(LONGEST_SAMPLE, SAMPLE_CHARS // (2 * OVERSAMPLE * n)))
    picked = df.where(F.col(col).isNotNull() & (F.pmod(F.xxhash64(*of), F.lit(every)) == 0))
    tie = F.col(tiebreak) if tiebreak else F.lit(None).cast("int")
    got = picked.select(F.substring(F.col(col), 1, longest).alias("t"), (F.length(col) <= longest).alias("whole"), tie.alias("i")).collect()
    # null tiebreaks sort first
    got = sorted(((r["t"], r["i"] if r["whole"] else None) for r in got), key=lambda r: (r[0], r[1] is not None, r[1]))
    out: list[tuple] = []
    for k in sorted({len(got) * j // n for j in range(1, n)}):
        if k and got[k] != got[k - 1]:
            (before, _), (text, i) = got[k - 1], got[k]
            cut = (text, i) if text == before else (_apart(text, before), None)
            if not out or cut != out[-1]:
                out.append(cut)
    return out


def segment_of(cuts: list[tuple], col: str, tiebreak: str | None = None) -> Column:
    """The number of a row's segment: how many ``cuts`` are at or before it.  A function of
    the row alone, by binary search, so each reader of a table finds the same segments."""
    if not cuts:
        return F.lit(0)
    text = F.col(col)
    cut = F.array(*[F.struct(F.lit(t).alias("t"), (F.lit(i) if i is not None or not tiebreak else F.lit(None)).alias("i")) for t, i in cuts])

    def reached(at: Column) -> Column:
        c = F.element_at(cut, at)
        same = (F.lit(True) if not tiebreak else c["i"].isNull() | (c["i"] <= F.col(tiebreak)))
        return F.coalesce((c["t"] < text) | ((c["t"] == text) & same), F.lit(False))

    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda lo, s: F.when(lo + s > len(cuts), lo).when(reached(F.least(lo + s, F.lit(len(cuts)))), lo + s).otherwise(lo))


def rank_within(df: DataFrame, part, order, out: str = "rank", splits: int | None = None, cut=None) -> DataFrame:
    """1-based row number of each row inside ``part`` in ``order`` (exact).

    ``order`` must make rows unique within a group for a deterministic result.
    ``cut`` names the leading columns of the order by which segments are cut,
    where later ones are long texts (default: all of them).
    """
    part = [part] if isinstance(part, str) else list(part or [])
    order = [order] if isinstance(order, str) else list(order)
    x = cut_segments(df, part + list(cut or order), splits)
    seg = part + ["_seg"]
    x = x.withColumn("_local", F.row_number().over(Window.partitionBy(*seg).orderBy(*[F.col(c) for c in order])))
    cnt = x.groupBy(*seg).agg(F.count(F.lit(1)).alias("_cnt"))
    ow = Window.partitionBy(*part).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("_off", F.coalesce(F.sum("_cnt").over(ow), F.lit(0))).drop("_cnt")
    j = x.join(cnt, [x[c].eqNullSafe(cnt[c]) for c in seg], "left")
    for c in seg:
        j = j.drop(cnt[c])
    return j.withColumn(out, F.col("_off") + F.col("_local")).drop("_off", "_local", "_seg")


def hash_order(seed, *cols):
    """Deterministic pseudo-random order key: md5 of seed || columns (the same
    hex in Spark and DuckDB, so an oracle can reproduce the order)."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))
