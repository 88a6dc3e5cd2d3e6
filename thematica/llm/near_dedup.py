"""Near-duplicate documents: MinHash with tensored banding, every link verified.

Two collections of ``BANDS`` half keys are computed, each half key from
``HALF`` minhashes.  A table key combines one half key of each collection, so
BANDS^2 tables come from 2 * BANDS * HALF minhashes, about the square root of
what as many independent tables would take.  Two documents of similarity s
share a table with probability (1 - (1 - s^HALF)^BANDS)^2: 0.9986 at s = 0.8 and
0.99998 at s = 0.85 for 10 bands of 3.

Documents with equal shingle sets are one class from the start; only class
representatives take part in the rest.  Within a table, pairs are not
enumerated: each member is compared, on the full sets, with the table's head,
its most central member, and similar ones make first components.  Then members
of different components that met one head are compared, where they share a
shingle that the head lacks, or where the set sizes, and what both share with the
head, allow a link without one; no similar pair of a table is left out, see
``link_rows``.  Links within one component can't change the result and are skipped.

Defined results: null and empty texts have no shingles, are linked with nothing
and kept; a null id has no component and is kept; rows that repeat an id are one
vertex, linked if any of them is; ties in size are ordered by id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import connected_components
from .shared import WordHasher, materialise, mix64, only, pick, seeds, shingles, signed, texts

BANDS = 10
HALF = 3
PERCENT = 80


def _half_keys(s: np.ndarray, bands: int, half: int) -> np.ndarray:
    """2 * bands keys of a shingle set."""
    mult = seeds(2 * bands * half, 5)
    least = np.empty(len(mult), np.uint64)
    for a in range(len(mult)):
        least[a] = ((s ^ (s >> np.uint64(29))) * mult[a]).min()  # odd multiplier: a bijection, ordered by high bits
    least = mix64(least).reshape(2 * bands, half)
    out = np.zeros(2 * bands, np.uint64)
    for j in range(half):
        out = mix64(out * np.uint64(31) + least[:, j] + np.uint64(j + 1))
    return out


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 2, bands: int = BANDS, half: int = HALF) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, half_keys): set_a and set_b name the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                        ("half_keys", pa.list_(pa.int64()))])

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            n, a1, a2, keys = [], [], [], []
            for t in texts(b, "_text"):
                s = shingles(hasher(t), k)
                n.append(len(s))
                a1.append(int(signed(np.array([s.sum(dtype=np.uint64)]))[0]))
                a2.append(int(signed(np.array([mix64(s + np.uint64(9)).sum(dtype=np.uint64)]))[0]))
                keys.append(signed(_half_keys(s, bands, half)).tolist() if len(s) else [])
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a1, pa.int64()), pa.array(a2, pa.int64()),
                                   pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return pick(df, doc_id=doc_id, _text=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, half_keys array<long>")


def tensored_keys(bands: int = BANDS) -> Column:
    """The BANDS^2 table keys of a row's half keys."""
    return F.expr(f"""flatten(transform(sequence(0, {bands - 1}), i -> transform(sequence({bands}, {2 * bands - 1}),
        j -> xxhash64(half_keys[i], half_keys[j], i * {bands} + j))))""")


def sharing(reps: DataFrame, keys: Column) -> DataFrame:
    """A row (key, n, id, head, head_n, m) for each table of each representative
    whose key others share; m have it.  The head of a key is its most central member: the
    one that meets most others over all tables, such as the text that near
    copies were made from.  ``reps`` is (rep, n_shingles, ...)."""
    x = reps.select(F.explode(keys).alias("key"), F.col("n_shingles").cast("int").alias("n"), F.col("rep").alias("id"))
    x = materialise(x.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("key"))).where("m > 1"), "shared")
    central = x.groupBy(F.col("id").alias("_id")).agg(F.sum("m").alias("c"))
    x = x.join(central, F.col("id") == F.col("_id")).select("key", "n", "id", "m", "c")
    heads = x.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("c", -F.col("id"), "id", "n")).alias("h"))
    return x.join(heads, F.col("key") == F.col("_key")).select("key", "n", "id", F.col("h.id").alias("head"), F.col("h.n").alias("head_n"), "m")


def _near_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verify(pairs: DataFrame, docs: DataFrame, k: int = 2, percent: int = PERCENT) -> DataFrame:
    """(u, v, common, similar, n, own) of the pairs (u, v, wide) of document ids:
    the size of the intersection of their full shingle sets, whether they are
    similar, the size of v's set, and of wide pairs the shingles of v that u lacks.
    ``docs`` is (id, text)."""
    one = pairs.join(docs.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
    both = one.join(docs.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("common", pa.int64()), ("similar", pa.bool_()), ("n", pa.int64()),
                        ("own", pa.list_(pa.int64()))])

    def run(batches):
        hasher = WordHasher()
        last: tuple = (None, None)
        for batch in batches:
            common, similar, size, own = [], [], [], []
            for u, wide, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts(batch, "a"), texts(batch, "b")):
                if last[0] != u or last[2] != a:  # rows come sorted by u
                    last = (u, shingles(hasher(a), k), a)
                s, t = last[1], shingles(hasher(b), k)
                n = len(np.intersect1d(s, t, assume_unique=True))
                common.append(n)
                similar.append(n > 0 and 100 * n >= percent * (len(s) + len(t) - n))
                size.append(len(t))
                own.append(signed(np.setdiff1d(t, s, assume_unique=True)).tolist() if wide else [])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(similar, pa.bool_()),
                                   pa.array(size, pa.int64()), pa.array(own, pa.list_(pa.int64()))], schema=schema)

    return both.select("u", "v", "wide", "a", "b").mapInArrow(
        run, "u long, v long, common long, similar boolean, n long, own array<long>")


def _rarest(met: DataFrame, percent: int) -> DataFrame:
    """(key, n, id, c): the shingles that members (v, n, c, own) of a head u have
    and it lacks, the rarest n - ceil(n * percent / 100) + 1 of each member, where
    members of other components have them too.  A similar set lacks fewer, so if
    two similar members share any such shingle, the rarest they share is here for
    both (prefix filter; the order is one for all members of a head)."""
    x = met.select("n", F.col("v").alias("id"), "c", F.xxhash64("own").alias("set"), "u", F.explode("own").alias("x"))
    x = materialise(x.withColumn("key", F.xxhash64("u", "x")), "lacked")
    have = x.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    x = x.join(have, F.col("key") == F.col("_key"))
    most = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    w = W.partitionBy("u", "id", "set").orderBy("df", "key")  # shingles of one member
    return x.withColumn("r", F.row_number().over(w)).where((F.col("r") <= most) & (F.col("c0") < F.col("c1"))).select("key", "n", "id", "c")


def link_rows(rows: DataFrame, docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """(u, v): verified links that make up the components.  ``rows`` are those
    of ``sharing``, ``docs`` is (id, text) with at least their ids."""
    ids = rows.select("id").distinct()
    docs = materialise(only(docs, "id", ids, "id"), "candidates")  # texts that share a table with another
    # also where the sizes alone exclude a link: what is shared with the head bounds what members share with each other
    to_head = (rows.where(F.col("id") != F.col("head")).groupBy(F.col("head").alias("u"), F.col("id").alias("v"))
               .agg((F.max("m") > 2).alias("wide")))
    met = materialise(verify(to_head, docs, k, percent), "met")
    stars = connected_components(met.where("similar")).select(F.col("id").alias("u"), F.col("component").alias("v"))
    # members of a table that aren't in one component yet; in a table of two the head has met all
    lab = (rows.where("m > 2").select("key", "n", "id", "head").join(stars, F.col("id") == F.col("u"), "left")
           .select("key", "n", "id", "head", F.coalesce("v", "id").alias("c")))
    mixed = lab.groupBy(F.col("key").alias("_key")).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("_key")
    lab = lab.join(mixed, F.col("key") == F.col("_key"), "left_semi")
    common = met.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "common").distinct()
    lab = lab.join(common, (F.col("head") == F.col("_u")) & (F.col("id") == F.col("_v")), "left")
    lab = materialise(lab.select("key", "n", "id", "head", "c", F.when(F.col("id") == F.col("head"), F.col("n").cast("long")).otherwise(F.col("common")).alias("w")), "mixed")
    # What two members share of the head is at most the smaller of what each shares with it.  If that is too little for a
    # link, they are similar only through shingles that the head lacks, and share one of ``_rarest``.
    bound = F.least("w1", "w2")
    can = F.col("w1").isNull() | F.col("w2").isNull() | (100 * bound >= percent * (F.col("n1") + F.col("n2") - bound))
    other = (F.col("c1") < F.col("c2")) & _near_size("n1", "n2", percent)
    ends = [F.least("id1", "id2").alias("u"), F.greatest("id1", "id2").alias("v")]

    def twice(x, key, *cols):
        return (x.select(key, *[F.col(c).alias(f"{c}{i}") for c in cols]) for i in (1, 2))

    a, b = twice(lab, "key", "n", "id", "c", "w")
    within = a.join(b, "key").where(other & can).select(*ends)
    # members by (head, shingle that it lacks), whichever of the head's tables they are in
    of = lab.select(F.col("head").alias("_u"), F.col("id").alias("_v"), "c").distinct()
    own = materialise(_rarest(met.join(of, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v"))), percent), "own")
    a, b = twice(own, "key", "n", "id", "c")
    beside = a.join(b, "key").where(other).select(*ends)
    tested = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = within.union(beside).distinct().join(tested, ["u", "v"], "left_anti").withColumn("wide", F.lit(False))
    new = materialise(verify(materialise(more, "pairs"), docs, k, percent), "more")
    return stars.select("u", "v").union(new.where("similar").select("u", "v"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 2, bands: int = BANDS,
                    half: int = HALF, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    sig = materialise(signatures(df, doc_id, text, k, bands, half), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    reps = (full.groupBy("set_a", "set_b", "n_shingles")
            .agg(F.min("doc_id").alias("rep"), F.first("half_keys").alias("half_keys")))  # equal sets have equal keys
    reps = materialise(reps, "classes")
    # a repeated id may stand for several sets; they are one vertex
    docs = pick(df, id=doc_id, text=text).withColumn("id", F.col("id").cast("long"))
    rows = materialise(sharing(reps, tensored_keys(bands)), "tables")
    links = link_rows(rows, docs, k, percent)
    same = full.join(reps.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.col("n_shingles").alias("_n"), "rep"),
                     (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")) & (F.col("n_shingles") == F.col("_n")))
    same = materialise(same.select("doc_id", "rep"), "members")
    comp = connected_components(links.union(same.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))
    out = sig.select("doc_id", "n_shingles").join(comp, F.col("doc_id") == F.col("id"), "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, **kw) -> DataFrame:
    """One document of each group stays, all columns unchanged."""
    gone = near_duplicates(df, doc_id, text, k, **kw).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, F.col(f"`{doc_id}`") == F.col("_gone"), "left_anti")
