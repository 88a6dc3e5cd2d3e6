"""Helpers shared by the operators: intermediate tables, word hashing, text access."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thematica.session import ensure_checkpoint_dir

MASK = (1 << 64) - 1
#: bound of the per-worker word caches (entries); a full cache is emptied
CACHE_ENTRIES = 400_000
#: rows are sent to Python workers in batches of about this size, or one row if it is larger
BATCH_BYTES = 4 << 20


def workdir(spark: SparkSession) -> str:
    """A fresh folder under the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "t", compression: str | None = None, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs at most a re-read.  Unlike a
    checkpoint the file is columnar, so later steps read only what they use.
    Tables of whole texts take less disk with ``compression="zstd"``; rows of
    many MB are neither written nor read several at once with ``file_rows=1``.
    """
    path = f"{workdir(df.sparkSession)}/{name}"
    options = {"maxRecordsPerFile": file_rows} if file_rows else {}
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession):
    """While it lasts, what runs is sent to Python workers in batches of about ``BATCH_BYTES``, as the JVM holds a batch
    outside its heap twice, with room to grow; Spark's own limit is many times that.  A limit that the session has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed but lies
    at the same place on each machine, as in local runs."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (vectorised, wraps modulo 2^64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int = 1) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


class WordHasher:
    """Words of a text as 64-bit hashes; a word is a run of bytes other than
    0x20 and 0x09-0x0D, with A-Z lower-cased.  The cache is bounded."""

    def __init__(self, lower: bool = True):
        import xxhash

        self.h = xxhash.xxh3_64_intdigest
        self.lower = lower
        self.cache: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        b = text.encode("utf-8", "surrogatepass")
        return (b.lower() if self.lower else b).split()

    def __call__(self, text: str | None) -> np.ndarray:
        return self.hash_words(self.words(text))

    def hash_words(self, ws: list[bytes]) -> np.ndarray:
        c = self.cache
        if len(c) > CACHE_ENTRIES:
            c.clear()
        try:
            return np.fromiter(map(c.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            h = self.h
            for w in ws:
                if w not in c:
                    c[w] = h(w)
            return np.fromiter(map(c.__getitem__, ws), np.uint64, len(ws))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted hashes of the k-word shingles; with fewer than k words
    the whole sequence is the one shingle; no words, no shingles."""
    n = len(words)
    if n == 0:
        return words
    m = min(n, k)
    mult = seeds(k, 77)
    out = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        out += mix64(words[j:n - m + 1 + j] + np.uint64(j + 1)) * mult[j]
    return np.unique(mix64(out + np.uint64(m)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts(batch: pa.RecordBatch, name: str):
    """The texts of a batch, one Python string at a time."""
    col = batch.column(batch.schema.get_field_index(name))
    for i in range(len(col)):
        yield col[i].as_py()


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under internal names: ``pick(df, k="doc_id")``.
    Other columns of ``df``, whatever they are called, can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in cols.items()])


SLOTS = 1 << 20
BITS = 1 << 25
MOST_BITS = 1 << 28


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    while name in df.columns:
        name += "_"
    return name


def _bit(df: DataFrame, key: str, few: DataFrame, few_key: str) -> tuple[DataFrame, Column, Column]:
    """(filled, meets, own): the ``BITS`` bits that the keys of ``few`` set, 4 MB at most, to be broadcast; whether a row
    of ``df`` meets their bucket, and whether its own bit is set.  Keys are compared as longs."""
    bit = lambda c: F.pmod(F.xxhash64(F.col(f"`{c}`").cast("long")), F.lit(BITS))
    bucket, bits = fresh(df, "_bucket"), fresh(df, "_bits")
    # keys travel to their bucket: a partial bitmap of every task could be as large as the whole
    filled = (few.select(F.bitmap_bucket_number(bit(few_key)).alias(bucket), F.bitmap_bit_position(bit(few_key)).alias("b"))
              .repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg("b").alias(bits)))
    at = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return F.broadcast(filled), F.bitmap_bucket_number(bit(key)) == F.col(bucket), own


def only(df: DataFrame, key: str, ids: DataFrame, id_name: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``ids``.

    Before the join, rows are dropped whose hashed key meets none of the ``BITS`` bits that the ids set.  Of the
    others, a row comes through by chance with probability ids / ``BITS`` at most, 1 in 33 for a million ids.  With far
    more ids than bits nothing is dropped and the join does all the work."""
    filled, meets, own = _bit(df, key, ids, id_name)
    x = df.join(filled, meets & own, "left_semi")
    return x.join(ids.select(F.col(id_name).alias(fresh(df, "_wanted"))), F.col(f"`{key}`") == F.col(fresh(df, "_wanted")), "left_semi")


def parted(df: DataFrame, key: str, few: DataFrame, few_key: str) -> tuple[DataFrame, DataFrame]:
    """(stay, go): rows of ``df`` that no row of ``few`` matches, and the others with ``few`` joined from the left.

    A left join would send every text through an exchange.  Here only rows travel whose hashed key meets one of the
    ``BITS`` bits that the keys of ``few`` set; the bits are broadcast, 4 MB at most, whatever the size of either side.
    Keys are compared as longs.  ``df`` is read twice, ``few`` too: both should be written tables."""
    filled, meets, own = _bit(df, key, few, few_key)
    x = df.join(filled, meets, "left")
    names = [F.col(f"`{c}`") for c in df.columns]
    stay = x.where(~F.coalesce(own, F.lit(False))).select(*names)
    go = x.where(own).select(*names).join(few, F.col(f"`{key}`") == F.col(few_key), "left")
    return stay, go


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """Bits as bytes, in which those of the keys (longs, evenly spread) are set: bit ``key mod n``, bit i of a byte of
    value 2^i.  n is a power of two, 32 times the number of keys or more, so that another key meets a bit with probability
    1/32 at most; it ends at ``MOST_BITS`` (32 MB), beyond which more meet one by chance.  ``keys`` is read twice: it should be a written table."""
    n = min(MOST_BITS, 1 << max(15, (32 * keys.count() - 1).bit_length()))
    place = F.pmod(F.col(key), F.lit(n)) + 1  # a bucket's numbers begin with 1
    rows = (keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("b"))
            .repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("b").alias("bits")).collect())
    out = np.zeros((n >> 15, 1 << 12), np.uint8)
    for r in rows:
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    at = keys & np.int64(8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1
