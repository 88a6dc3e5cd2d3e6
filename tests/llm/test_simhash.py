"""SimHash fingerprints and their links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from thematica.llm import shared, simhash


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


def fingerprint(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """Least id reachable, by row, over all pairs."""
    least = [i for i, _ in rows]
    while True:
        new = [min((least[j] for j, (_, g) in enumerate(rows) if (f ^ g).bit_count() <= 3 and least[j] is not None), default=None) for _, f in rows]
        if new == least:
            return least
        least = new


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def found(spark, fps, group):
    """The components that links make of fingerprints."""
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(5)
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    rows = simhash.links(df, group).collect()
    for r in rows:
        u, v = r.u % (1 << 64), r.v % (1 << 64)
        assert 0 < (u ^ v).bit_count() <= 3
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in fps}, len(rows)


def expected(fps):
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 3):
            p, q = root(fps[i]), root(fps[j])
            up[max(p, q)] = min(p, q)
    return {x: root(x) for x in fps}


def test_matches_brute_force(spark, corpus):
    docs = [*corpus, (None, "a b c d"), (500, "a b c d"), (3, "another text of the id three")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, fp string, u int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    rows = [(i, fingerprint(t)) for i, t in docs]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(rows, components(rows), strict=True)), key=str)
    assert got == want
    assert {f for i, f, _ in got if i in dict(corpus) and not (dict(corpus)[i] or "").strip()} == {"0" * 16}


def test_blocks_of_a_long_text(spark, monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice(["a", "bc", "Déf"]) + rnd.choice([" ", "\n", "\t ", "  "]) for _ in range(3000))
    whole = [x for a in simhash._shingle_hashes(text, 3) for x in a.tolist()]
    monkeypatch.setattr(simhash, "TEXT_BLOCK", 7)
    assert [x for a in simhash._shingle_hashes(text, 3) for x in a.tolist()] == whole
    assert [len(a) for a in simhash._shingle_hashes("one  two", 3)] == [1]


@pytest.mark.parametrize("group", [256, 3])
def test_links_of_clusters(spark, group):
    rnd = random.Random(7)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(rnd.choice([3, 30])):  # around one text, and copies of copies
            x = rnd.choice([base, *list(fps)[-5:]])
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
        x = base
        for _ in range(8):  # a chain within one block
            x ^= 7 << rnd.randrange(13)
            fps.add(x)
    fps = sorted(fps)
    got, _ = found(spark, fps, group)
    assert got == expected(fps)


@pytest.mark.parametrize("bits", [(1, 2, 3), (0, 17, 40), (15, 16, 63), (47, 48, 49), (5, 6, 60), (31, 32), (9,)])
@pytest.mark.parametrize("group", [256, 1])
def test_every_way_of_three_bits(spark, bits, group):
    a = 0x0123456789ABCDEF
    b = a
    for p in bits:
        b ^= 1 << p
    got, _ = found(spark, sorted([a, b, a ^ 0xF << 8 ^ 0xF << 50]), group)
    assert got[a] == got[b] and len(set(got.values())) == 2


def test_a_large_group_has_few_links(spark):
    # all within 3 bits of one another in one block: every remainder is shared
    base = 0xFFFF0000FFFF0000
    fps = sorted({base ^ (1 << p) ^ (1 << q) for p in range(48) for q in range(p)})
    got, n = found(spark, fps, 64)
    assert set(got.values()) == {fps[0]}
    assert n < 100 * len(fps)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_bit_counts():
    rnd = np.random.default_rng(1)
    sizes = [1, 254, 255, 256, 1000, 3]
    h = rnd.integers(0, 1 << 63, sum(sizes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at = np.cumsum(sizes) - sizes
    got = simhash._bit_counts(h, at)
    for i, s in enumerate(at):
        part = h[s:s + sizes[i]]
        assert got[i].tolist() == [int(((part >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


def test_links_of_the_given_table(spark):
    df = shared.table(spark, "/root/testdata/sf0.001", "documents").withColumn("doc_id", F.col("doc_id"))
    docs = [(r.doc_id, fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == dict(zip([i for i, _ in docs], components(docs), strict=True))
