"""Centroid clustering on bit planes: exact distances from AND and popcount.

A vector of 64 integers is kept as bit planes in two's complement: plane p is one
64-bit word with bit i set where component i has bit p, and weighs 2^p, the top
plane -2^p.  A dot product is the sum over pairs of planes of the weights' product
times the popcount of their AND, so distances to all centroids are a few hundred
AND-popcounts a vector, and exact.  The number of planes follows from the largest
component of the table.

The planes are written once.  Each round is one pass over them: a task assigns
its vectors and returns one row a cluster, component sums and a count, so the exchange and
the driver hold centroids * tasks rows, however many vectors equal each other.
Centroids (``K`` rows of 64 integers) travel with the tasks.

Defined results: null vectors, those of another length and those with a null or
non-finite component are left out; a null id is hashed like an empty one; rows that
repeat an id are vectors of their own, and ties of their hash go by the
components; with fewer vectors than centroids all are centroids; an empty table
gives an empty result; other columns are not read.  Integers of more than ``BITS`` bits
would give distances beyond 64 bits: that raises a ValueError before any round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, pick

WIDTH = 64
K = 16
ROUNDS = 3
SEED = "1"
SCALE = 64.0
#: two's complement bits of a component: squared distances stay below 2^62
BITS = 27


def quantised(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(vec_id, v): the integers floor(scale * x) of the vectors that are kept."""
    x = pick(df, vec_id=vec_id, v=vec).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = x.where(F.size("v") == WIDTH).where(sound)
    return x.select("vec_id", F.transform("v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(2.0 ** 60)), F.lit(-(2.0 ** 60))))).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> list[list[int]]:
    """The vectors of the k smallest hashes: k rows on the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in rows]


def to_planes(v: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) planes of (rows, 64) integers."""
    out = np.empty((len(v), n), np.uint64)
    for p in range(n):
        bits = ((v >> p) & 1).astype(np.uint8)
        out[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The integers of planes."""
    w = weights(planes.shape[1])
    out = np.zeros((len(planes), WIDTH), np.int64)
    for p in range(planes.shape[1]):
        words = np.ascontiguousarray(planes[:, p]).astype("<u8").view(np.uint8).reshape(-1, 8)
        out += w[p] * np.unpackbits(words, axis=1, bitorder="little").astype(np.int64)
    return out


def weights(n: int) -> np.ndarray:
    w = np.int64(1) << np.arange(n, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of each row of planes ``a`` with each of ``b``."""
    wa, wb = weights(a.shape[1]), weights(b.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for p in range(a.shape[1]):
        for q in range(b.shape[1]):
            out += wa[p] * wb[q] * np.bitwise_count(a[:, p, None] & b[None, :, q]).astype(np.int64)
    return out


def nearest(planes: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row; of equally near centroids the first."""
    c = to_planes(centroids, planes.shape[1])
    d = own[:, None] - 2 * products(planes, c) + (centroids * centroids).sum(axis=1)[None, :]
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


def pack(vectors: DataFrame, n: int) -> DataFrame:
    """(vec_id, own, p0, p1, ...): squared length and planes of (vec_id, v)."""
    def run(batches):
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            planes = to_planes(v, n).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array((v * v).sum(axis=1)), *[pa.array(np.ascontiguousarray(planes[:, p])) for p in range(n)]],
                ["vec_id", "own", *[f"p{p}" for p in range(n)]])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, own long, " + ", ".join(f"p{p} long" for p in range(n)))


def _read(b: pa.RecordBatch, skip: int) -> tuple[np.ndarray, np.ndarray]:
    cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(skip, b.num_columns)]
    return cols[0], np.stack([c.view(np.uint64) for c in cols[1:]], axis=1)


def _one_round(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean, or as before where a cluster is empty."""
    k = len(centroids)

    def run(batches):
        total, count = np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                own, planes = _read(b, 0)
                cluster, _ = nearest(planes, own, centroids)
                v = from_planes(planes)
                for c in np.unique(cluster):
                    total[c] += v[cluster == c].sum(axis=0)
                count += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), WIDTH).cast(pa.list_(pa.int64()))],
            ["cluster", "n", "total"])

    part = packed.drop("vec_id").mapInArrow(run, "cluster int, n long, total array<long>")
    sums = [F.sum(F.element_at("total", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(WIDTH)]
    out = centroids.copy()
    for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows
        if r["n"]:
            out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(WIDTH)]
    return out


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", k: int = K, rounds: int = ROUNDS,
                    seed: str = SEED, scale: float = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept."""
    spark = df.sparkSession
    vectors = quantised(df, vec_id, vec, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    ends = vectors.select(F.max(F.array_max("v")).alias("hi"), F.min(F.array_min("v")).alias("lo")).head()
    if ends["hi"] is None:
        return spark.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    n = 1 + max(int(ends["hi"]).bit_length(), (~int(ends["lo"])).bit_length() if ends["lo"] < 0 else 0)
    if n > BITS:
        raise ValueError(f"components of {n} bits; squared distances of more than {BITS} bits a component don't fit in 64")
    packed = materialise(pack(vectors, n), "planes")
    centroids = np.array(first_centroids(vectors, k, seed), np.int64)
    for _ in range(rounds):
        centroids = _one_round(packed, centroids)
    fixed = centroids  # the task function below must not see a later value

    def run(batches):
        for b in batches:
            if b.num_rows:
                cluster, distance = nearest(*_read(b, 1)[::-1], fixed)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = materialise(packed.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "assigned")
    parts = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(c, d, sum(parts.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(parts.items())]
    of = spark.createDataFrame(rows, "_c int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return assigned.join(F.broadcast(of), F.col("cluster") == F.col("_c")).drop("_c")
