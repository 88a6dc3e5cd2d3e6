"""Exact substring removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from thematica.llm import shared, substrings


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        cov = bytearray(len(b))
        for a in range(len(b) - length + 1):
            w = b[a:a + length]
            if w in seen:
                cov[a:a + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cov) if not c)
        spans = sum(1 for k, c in enumerate(cov) if c and (k == 0 or not cov[k - 1]))
        out[i] = (len(b), sum(cov), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gram string").repartition(5)
    got = substrings.remove_repeats(df, **kw).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None}, got


def test_mixed_texts(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh é\n") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rnd.randint(0, 6)):
            b, k = rnd.choice(base), rnd.random()
            if k < 0.5:
                a = rnd.randint(0, 300)
                t += b[a:a + rnd.randint(60, 200)]
            elif k < 0.6:
                t += b
            elif k < 0.7:
                t += "ab" * rnd.randint(10, 200)
            else:
                t += "".join(rnd.choice("xyz ") for _ in range(rnd.randint(1, 80)))
        rows.append((i * 3 - 40, t))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (503, base[0]), (504, base[0]), (505, "x" * 5000), (506, "short"), (507, "short")]
    got, _ = run(spark, rows)
    assert got == brute(rows, 100)


def test_documents(spark, corpus):
    got, _ = run(spark, corpus)
    assert got == brute(corpus, 100)


def test_batch_borders(spark):
    """A gram whose rows fill several batches, with more and fewer contexts than one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_mixed_texts(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_ids_repeats_empty(spark):
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(100))
    _, rows = run(spark, [(None, t), (1, t), (1, t), (2, t)])
    assert sorted(((r.doc_id, r.n_removed) for r in rows), key=str) == sorted([(None, 0), (1, 0), (1, 0), (2, len(t))], key=str)
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_text(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (2, "head " + t + " tail")], "doc_id long, text string")
    got = {r.doc_id: r.kept.decode() for r in substrings.remove_repeats(df, with_text_left=True).collect()}
    assert got == {1: t, 2: "head  tail"}


def test_long_text_in_chunks(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    rnd = np.random.default_rng(1)
    b = rnd.integers(97, 100, 2000).astype(np.uint8)
    g, c, p, lo, hi = substrings.samples(b, substrings._Hashes(1000))
    windows = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi)])
    assert windows.tolist() == list(range(2000 - 99))
    assert (p >= lo).all() and (p >= hi - 0).all() and (p <= lo + 76).all()
