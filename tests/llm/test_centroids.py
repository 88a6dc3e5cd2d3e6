"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thematica.llm import centroids, shared


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        of = assign()
        for c in range(len(cents)):
            own = [v for (_, v), (a, _) in zip(kept, of, strict=True) if a == c]
            if own:
                cents[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = assign()
    inertia = [sum(d for a, d in of if a == c) for c in range(len(cents))]
    return sorted(((i, a, d, inertia[a], sum(inertia), hashlib.sha256(",".join(map(str, cents[a])).encode()).hexdigest())
                   for (i, _), (a, d) in zip(kept, of, strict=True)), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, own string, cluster int")
    out = centroids.cluster_vectors(df.repartition(3), **kw)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(n, seed=1, spread=1.0):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(rnd.choice([-1, 0, 1]), spread) for _ in range(64)]) for i in range(n)]


def test_matches_plain_integers(spark):
    rows = vectors(120)
    rows += [(1000 + i, rows[i][1]) for i in range(20)]  # equal vectors, ties of distance
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (None, None)]  # ids that repeat, null ids
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] + [0.0] * 63),
             (2005, [float("-inf")] + [0.0] * 63), (2006, [0.0] * 65), (2007, [-0.001] * 64), (2008, [0.0] * 64)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("spread", [0.0001, 3000.0])
def test_other_ranges(spark, spread):
    rows = vectors(60, 2, spread)
    assert got(spark, rows) == brute(rows)


def test_fewer_vectors_than_centroids_and_equal_ones(spark):
    rows = [(i, [0.5] * 64) for i in range(5)]
    out = got(spark, rows)
    assert out == brute(rows) and {r[1] for r in out} == {0}
    assert got(spark, [(1, None)]) == [] and got(spark, []) == []


def test_too_wide(spark):
    with pytest.raises(ValueError, match="bits"):
        got(spark, [(1, [1e30] * 64)])


def test_other_parameters(spark):
    rows = vectors(50, 4)
    assert got(spark, rows, k=3, rounds=1) == brute(rows, 3, 1)


def test_planes_round_trip():
    v = np.random.default_rng(2).integers(-500, 500, (40, 64))
    planes = centroids.to_planes(v, 10)
    assert (centroids.from_planes(planes) == v).all()
    assert (centroids.products(planes, planes[:7]) == v @ v[:7].T).all()


def test_given_table(spark):
    df = shared.table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in centroids.cluster_vectors(df).collect()), key=str) == brute(rows)
    assert centroids.cluster_vectors(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
