import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from thematica.llm import packing, shared


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_encoder_equals_the_library(tok):
    enc = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    for t in ["Hello, World. It's 3 o'clock!", "ÀÉÎ été Straße ÿ", "áb é", "x\x1cy\x85z", "Σας ΣΑΣ", " \t\n ", "日本語 text",
              "<|endoftext|> a<|startoftext|>b", "a b c", "İstanbul ŒUVRE ǅ", "word," * 40, "z" * 500, "...", "a.b.c, d.,", "don't 'S 's"]:
        assert np.frombuffer(enc(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def check_layout(rows, capacity):
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def best_fit(lengths, capacity):
    """Sequences that best fit opens when it takes the pieces one by one, longest first."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(capacity - n)
    return len(left)


def test_documents(spark, corpus, tok):
    df = spark.createDataFrame([(i, t, 7) for i, t in corpus], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack_documents(df, capacity=256).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    total = 0
    for i, t in corpus:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        assert sorted(by[i]) == [(p, a, len(ids[a:a + 256]), zlib.crc32(ids[a:a + 256].tobytes())) for p, a in enumerate(range(0, len(ids), 256))]
    assert math.ceil(total / 256) <= check_layout(rows, 256) <= best_fit([r.length for r in rows], 256)


def test_sequences_hold_their_pieces(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    packed = packing.pack_documents(df, capacity=512, with_ids=True).cache()
    ids = {(r.doc_id, r.piece): r.ids for r in packed.collect()}
    for s in packing.sequences(packed).collect():
        assert bytes(s.ids) == b"".join(bytes(ids[(p.doc_id, p.piece)]) for p in s.pieces)
    packed.unpersist()


def test_plan_is_a_packing():
    rnd = random.Random(2)
    for _ in range(200):
        cap = rnd.choice([1, 7, 64])
        hist = {n: rnd.randint(1, 400) for n in rnd.sample(range(1, cap + 1), rnd.randint(1, cap))}
        room, seen = collections.Counter(), collections.Counter()
        for length, first, items, per, seq, at in packing.plan(hist, cap):
            assert first == seen[length]
            seen[length] += items
            for i in range(items):
                assert room[seq + i // per] == at + (i % per) * length
                room[seq + i // per] += length
        assert seen == hist and max(room.values()) <= cap
        assert sorted(room) == list(range(len(room)))
        assert len(room) <= best_fit([n for n, k in hist.items() for _ in range(k)], cap) if cap < 64 else True


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    assert sorted(((r.doc_id, r.length) for r in rows), key=str) == sorted([(None, 3), (1, 1), (1, 1), (2, 1), (3, 3)], key=str)
    assert check_layout(rows, 4096) == 1
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_length_for_all_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 100)
    df = spark.range(3000).selectExpr("id AS doc_id", "'same words here' AS text").repartition(4)
    rows = packing.pack_documents(df, capacity=10).collect()
    assert len(rows) == 3000 and check_layout(rows, 10) == 1500
