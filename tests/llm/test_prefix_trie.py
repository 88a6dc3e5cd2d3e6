"""The conversation trie against a plain one."""

import hashlib
import random
import zlib

import pytest

from thematica.llm import prefix_trie, shared


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


def name(role, text):
    r, t = role or "", text or ""
    return hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]


def rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, name(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        family = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(family, [])[:h] + own[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = own + sum(saved[k] for k in kids.get(p, []))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def key(r):
    return tuple(-1 if x is None else x for x in r)


def check(spark, rows, **kw):
    schema = "conv_id long, turn long, role string, text string, path string, depth int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(4)
    out = prefix_trie.conversation_trie(df, **kw)
    assert tuple(out.columns) == prefix_trie.COLUMNS
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute(rows), key=key)


def conversations(n, seed=1, texts=3, most=6):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]), f"text é {rnd.randrange(texts)}") for c in range(n) for t in range(rnd.randint(1, most))]


@pytest.mark.parametrize("shards", [1, 3, 16, 200])
def test_matches_a_plain_trie(spark, shards):
    check(spark, conversations(150), shards=shards)


def test_nulls_ties_and_repeats(spark):
    rows = conversations(30, 5)
    rows += [(None, 1, "user", "lost"), (4, None, None, None), (4, None, "user", None), (7, 0, "", "a" * 50_000), (8, 2, "b", ""),
             (8, 2, "", "b"), (-3, 0, "user", "x"), (-5, 0, "user", "y"), (-7, 1, "user", "z"), (-7, 1, "user", "z"), (1 << 40, 0, None, "w")]
    rows += [(c, 0, "user", "only") for c in range(1000, 1010) if c % 5]  # families without a first conversation: some are turnless
    check(spark, rows, shards=5)


def test_hot_path_is_cut_and_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)  # in this process; workers keep theirs
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(2)] + conversations(40, 9)
    check(spark, rows, shards=12)


def test_long_conversation_and_cut_splitters(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t}" if t < 250 + c % 7 else f"own {c}") for c in range(20) for t in range(270)]
    check(spark, rows, shards=6)
    monkeypatch.setattr(prefix_trie, "SKELETON", 40)
    check(spark, rows, shards=6)


def test_skeleton_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SKELETON", 64)
    paths = spark.createDataFrame([(i, bytes([i]) * 16 * 100, b"") for i in range(100)], "conv_id long, path binary, sizes binary")
    cuts = prefix_trie.splitters(paths, 20)
    assert 1 < len(cuts) < 20 and sum(len(p) for p, _ in cuts) <= 16 * 64


def test_empty(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])


def test_given_table(spark):
    df = shared.table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in prefix_trie.conversation_trie(df).collect()), key=key) == sorted(brute(rows), key=key)
