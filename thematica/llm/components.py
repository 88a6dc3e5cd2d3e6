"""Connected components of a link table, in rounds of joins.

Large-star / small-star: in each round every vertex links its greater
neighbours, then its smaller ones, to the least vertex it knows.  The rounds
end when the links are stars; their number grows with the logarithm of the
longest chain.  Links stay in tables; the driver sees one row a round.  The
least neighbour is a partial aggregate, and the join back is a sort-merge join
that AQE splits where a vertex is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

MAX_ROUNDS = 60


def _both_ways(e: DataFrame) -> DataFrame:
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return e.select(F.inline(ways)).where("u <> v")


def _least(e: DataFrame) -> DataFrame:
    """Of links (u, v): the least of u and its neighbours, by u."""
    return e.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_u", "_m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both_ways(e)
    x = both.join(_least(both), F.col("u") == F.col("_u")).where("v > u")
    return x.select(F.col("v").alias("u"), F.col("_m").alias("v"))  # v > u >= _m


def _small_star(e: DataFrame) -> DataFrame:
    """``e`` has u > v."""
    x = e.join(_least(e), F.col("u") == F.col("_u"))
    ways = F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct(F.col("u"), F.col("_m").alias("v")))
    return x.select(F.inline(ways)).where("u <> v").distinct()


def _settled(e: DataFrame) -> bool:
    """Whether the links are stars: no centre has a link of its own, no vertex two centres."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("x"), F.lit(0).alias("leaf")))
    bad = (e.select(F.inline(ends)).groupBy("x").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least"))
           .where("leaf > 1 or (leaf = 1 and least = 0)"))
    return not bad.limit(1).count()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``links`` (u, v) other than the least
    of its component, which names it.  Self-links and repeats don't matter.
    ``links`` is read several times: it should be a written table."""
    e = links.select("u", "v")
    for _ in range(MAX_ROUNDS):
        e = materialise(_small_star(_large_star(e)), "links")
        if _settled(e):
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")
