"""Top-k search against brute force, adaptive rules against their SQL and by hand."""

import collections
import math
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from thematica.llm import queries, rules, search, shared


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


def words(t):
    return (t or "").encode().lower().split()


def brute(docs, asked, k):
    bags = [(i, collections.Counter(words(t))) for i, t in docs]
    n = len(bags)
    total = sum(sum(c.values()) for _, c in bags)
    mean = total / n if total else 1.0
    out = {}
    for q, t in asked:
        terms = set(words(t))
        df = {w: sum(w in c for _, c in bags) for w in terms}
        hits = []
        for i, c in bags:
            size = sum(c.values())
            v = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (search.K1 + 1)
                 / (c[w] + search.K1 * (1 - search.B + search.B * size / mean)) for w in terms if c[w]]
            if v:
                hits.append((-round(math.fsum(v), search.DIGITS), i is None, i or 0))
        out[q] = [(None if none else i, -s) for s, none, i in sorted(hits)[:k]]
    return out


@pytest.mark.parametrize("shard_bytes,block", [(1, 64), (3000, 2), (10**9, 4)])
def test_search_is_exact(spark, monkeypatch, shard_bytes, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(rnd.choices(vocab, weights, k=rnd.choice([0, 3, 20, 300])))) for i in range(250)]
    docs += [(300, docs[9][1]), (301, None), (None, docs[9][1]), (5, "w1 w1 w2")]
    asked = [(q, " ".join(rnd.choices(vocab, k=rnd.choice([1, 4, 30])))) for q in range(25)] + [(90, "unknown words"), (91, ""), (92, docs[9][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(4)
    index = shared.materialise(search.build_index(df, shard_bytes=shard_bytes))
    got = collections.defaultdict(list)
    for r in sorted(search.search(index, spark.createDataFrame(asked, "query_id long, text string"), k=7).collect(),
                    key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.doc_id, r.score))
    want = brute(docs, asked, 7)
    for q, _ in asked:
        assert got[q] == want[q], q


def _local(rows, mean=2.0):
    hasher = shared.WordHasher()
    row = dict(zip([n for n, _ in search._INDEX], search._shard([i for i, _ in rows], [hasher(t) for _, t in rows])))
    return search.Shard(row, mean), hasher


def test_a_shard_takes_little_memory_beside_its_row():
    rnd = random.Random(2)
    hasher = shared.WordHasher()
    texts = [hasher(" ".join(f"w{rnd.randrange(5000)}" for _ in range(300))) for _ in range(2000)]
    batch = pa.record_batch([pa.array([v], t) for v, (_, t) in zip(search._shard(list(range(2000)), texts), search._INDEX)], schema=pa.schema(search._INDEX))
    postings = len(batch.column(7)[0].as_py()) // 4
    tracemalloc.start()
    row = next(search._rows(batch))
    assert tracemalloc.get_traced_memory()[1] < 1e5  # the batch's own memory
    shard = search.Shard(row, 300.0)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert postings > 500_000 and held < 28 * postings and peak < 42 * postings
    docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32)
    assert (shard.part == search.weight(1.0, tfs.astype(np.float64), np.frombuffer(row["lengths"], np.int32)[docs], 300.0)).all()
    assert (shard.own_starts == np.searchsorted(np.sort(docs), np.arange(2001))).all()


def test_a_stored_row_has_numbers_of_few_bytes():
    """What is written and sent to workers takes little over half of a row's bytes, and is the same shard."""
    rnd = random.Random(6)
    hasher = shared.WordHasher()
    docs = [hasher(" ".join(f"w{int(rnd.paretovariate(0.4)) % 90_000}" for _ in range(200))) for _ in range(1000)] + [hasher("w1 " * 700), hasher("")]
    names = [n for n, _ in search._INDEX]
    size = lambda r: sum(len(v) for v in r.values() if isinstance(v, bytes))
    for most, docs in ((0.65, docs), (1.0, [*docs, hasher("w1 " * 70_000)])):  # the second has a frequency of more than two bytes
        row = dict(zip(names, search._shard(list(range(len(docs))), docs)))
        packed = dict(zip(names, search._packed(tuple(row.values()))))
        assert size(packed) < most * size(row) and len(packed["docs"]) * 2 == len(row["docs"])
        a, b = search.Shard(row, 270.0), search.Shard(packed, 270.0)
        a.by_document()
        b.by_document()
        for name in ("terms", "starts", "at", "tfs", "own_lengths", "part", "block_starts", "block_part", "block_first", "block_last", "own_terms", "own_tfs"):
            x, y = getattr(a, name), getattr(b, name)
            assert (x.dtype == y.dtype or name in ("at", "tfs", "own_tfs")) and (x == y).all(), name
        terms, idf = a.terms[::7], np.linspace(0.1, 5.0, len(a.terms))[::7]
        assert all(a.whole_score(d, terms, idf) == b.whole_score(d, terms, idf) for d in range(0, len(docs), 50))
    for docs in ([], [hasher("")]):
        row = search._shard(list(range(len(docs))), docs)
        assert search.Shard(dict(zip(names, search._packed(row))), 1.0).size == len(docs)


def test_a_long_text_is_added_in_parts(monkeypatch):
    """A query of all words takes little memory beside the shard's postings, and gives the same sums."""
    rnd = random.Random(9)
    shard, hasher = _local([(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(400))) for i in range(1500)], 400.0)
    found, idf = np.arange(len(shard.terms)), np.linspace(0.1, 5.0, len(shard.terms))
    want = np.bincount(shard.at, shard.part * idf.repeat(np.diff(shard.starts)), shard.size)
    monkeypatch.setattr(search, "PART", 1 << 13)
    scores = np.zeros(shard.size)
    tracemalloc.start()
    shard.add(found, idf, scores)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(shard.at) > 500_000 and peak < 2 * len(shard.at) and np.allclose(scores, want, rtol=1e-13) and shard.read == len(shard.at)


def test_rows_of_an_index_travel_one_by_one(spark, monkeypatch):
    """Each index row is a file, and the index and the hits are made and searched in small batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    written, build, write = {}, search.build_index, search.materialise

    def keep(df, to, *rest, **more):
        batch = spark.conf.get(name, None)
        written[to] = write(df, to, *rest, **more), batch
        return written[to][0]

    monkeypatch.setattr(search, "build_index", lambda df, doc_id, text: build(df, doc_id, text, shard_bytes=3000))
    monkeypatch.setattr(search, "materialise", keep)
    docs = [(i, f"common w{i} " * 20) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    got = search.search_documents(df, df.where("doc_id = 7"), query_id="doc_id").collect()
    assert sorted((r.rank, r.doc_id) for r in got)[0] == (1, 7) and len(got) == search.K
    index, batch = written["index"]
    assert index.count() > 4 and len(index.inputFiles()) == index.count()
    assert int(batch) == int(written["hits"][1]) == shared.BATCH_BYTES and spark.conf.get(name, None) is None

    def rows(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    large = spark.range(3, numPartitions=1).select(F.repeat(F.lit("x"), shared.BATCH_BYTES + 1).alias("t"))
    with shared.small_batches(spark):
        assert [r.n for r in large.mapInArrow(rows, "n long").collect()] == [1, 1, 1]
    assert [r.n for r in large.mapInArrow(rows, "n long").collect()] == [3]
    spark.conf.set(name, 1 << 24)  # a limit of the session's own
    try:
        with shared.small_batches(spark):
            assert spark.conf.get(name) == str(1 << 24)
        assert spark.conf.get(name) == str(1 << 24)
    finally:
        spark.conf.unset(name)


def test_blocks_are_skipped():
    """A rare term's documents reach a floor that a common term's blocks can't: its postings aren't read."""
    shard, hasher = _local([(i, "common " * (1 + i % 3) + ("rare " * 5 if i % 500 == 7 else "")) for i in range(4000)])
    found = shard.places(hasher.hash_words([b"common", b"rare"]))
    best = search.block_max_wand(shard, found, np.array([0.01, 5.0]), 3)
    assert [d % 500 for _, d in best] == [7, 7, 7] and shard.read < 2000


def test_block_maxima_pass_over_blocks():
    """Documents that only their list's maximum would save are passed over by their block's."""
    rows = [(i, "common " * (40 if i == 3000 else 1) + ("rare" if i < 500 else "")) for i in range(4000)]
    shard, hasher = _local(rows, 1.2)
    found = shard.places(hasher.hash_words([b"common", b"rare"]))
    bounds = shard.block_bounds(found[:1], np.array([1.0]))
    assert bounds[100] < bounds[3000] and (bounds + 1e-9 >= shard.part[slice(*shard.starts[found[0]:found[0] + 2])]).all()


@pytest.mark.parametrize("seed", range(4))
def test_floors_lose_nothing(seed):
    """With any floor that k documents reach, the documents at or above it are the same as without one."""
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rnd.choices([f"w{j}" for j in range(400)], weights, k=rnd.choice([5, 60, 400])))) for i in range(900)]
    rows += [(900 + i, rows[5][1]) for i in range(20)]  # ties
    shard, hasher = _local(rows, 150.0)
    for _, text in rows[:30]:
        terms = np.unique(hasher(text))
        found = shard.places(terms)
        idf = np.log(1 + 920 / (1.0 + np.diff(shard.starts)[found]))
        whole = np.zeros(shard.size)
        shard.add(found, idf, whole)
        want = sorted((-round(float(v), search.DIGITS), i) for i, v in enumerate(whole) if v > 0)
        top = search.block_max_wand(shard, found, idf, 10)
        assert [(-s, d) for s, d in top] == want[:10]
        for floor in (top[-1][0], top[-1][0] * 0.7, top[-1][0] * 0.2):
            assert search.block_max_wand(shard, found, idf, 10, floor) == top


def _zipf(rnd, n, size):
    return [(i, " ".join(rnd.choices([f"w{j}" for j in range(500)], [1 / (j + 1) for j in range(500)], k=rnd.choice(size)))) for i in range(n)]


def test_common_words_are_multiplied_not_read():
    """Lists of many documents are taken for all queries in one product; few documents are left, none of the best is lost."""
    rows = _zipf(random.Random(5), 1500, [30, 200, 600])
    shard, hasher = _local(rows, 250.0)
    asked = [np.unique(hasher(t)) for _, t in rows[:60]]
    every, places = np.unique(np.concatenate(asked), return_inverse=True)
    idf = np.log(1 + 1500 / (1.0 + np.diff(shard.starts)[shard.places(every)]))
    ends, floors = np.cumsum([len(t) for t in asked]), np.full(60, -math.inf)
    got = collections.defaultdict(list)
    for query, place, low, high in search.candidates_of_shard(shard, shard.places(every), idf, places, ends, 10, floors):
        for q, d, a, b in zip(query.tolist(), place.tolist(), low.tolist(), high.tolist()):
            got[q].append(d)
            terms = places[ends[q - 1] if q else 0:ends[q]]
            assert a - 1e-6 <= shard.whole_score(d, every[terms], idf[terms]) <= b + 1e-6
    postings = sum(int((np.diff(shard.starts)[shard.places(t)]).sum()) for t in asked)
    assert len(shard.matrix) > 100 and shard.read < postings / 4
    for q in range(60):
        terms = places[ends[q - 1] if q else 0:ends[q]]
        best = sorted(((-shard.whole_score(d, every[terms], idf[terms]), d) for d in range(1500)))[:10]
        assert {d for _, d in best} <= set(got[q]) and len(got[q]) < 40 and floors[q] <= -best[-1][0] + 1e-6


def test_copies_leave_no_more_than_k_candidates(spark):
    """A large group of copies over many shards: the smallest ids are found, and each shard offers k of them at most."""
    docs = [(i, "one text over and over") for i in range(400)] + [(None, "one text over and over")] * 3 + [(1000 + i, f"other text {i}") for i in range(40)]
    shard, hasher = _local(docs, 4.0)
    terms = np.unique(hasher(docs[0][1]))
    _, place, _, _, _ = search.candidates(shard, [shard.places(terms)], [np.ones(len(terms))], 10, [-math.inf])
    assert sorted(place.tolist()) == list(range(10))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    index = shared.materialise(search.build_index(df, shard_bytes=1500))
    assert index.count() > 7
    got = search.search(index, spark.createDataFrame([docs[3], docs[-1]], "query_id long, text string"), k=10).collect()
    for q, t in (docs[3], docs[-1]):
        assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == brute(docs, [(q, t)], 10)[q]


def test_ties_of_different_documents_are_settled_in_their_shard(spark):
    """Every document has a word of its own and a common one: a query ties with all others, and no shard offers all of them."""
    docs = [(i, f"common w{i}") for i in range(900)] + [(None, "common none")]
    shard, hasher = _local(docs)
    terms = np.unique(hasher(docs[500][1]))
    _, place, low, high, _ = search.candidates(shard, [shard.places(terms)], [np.array([1.0, 1.0])], 10, [-math.inf])
    assert len(place) == 10 and set(place.tolist()) == {500, *range(9)} and (low == high).all()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = shared.materialise(search.build_index(df, shard_bytes=4000))
    asked = [docs[500], docs[3], (1000, "common")]
    got = search.search(index, spark.createDataFrame(asked, "query_id long, text string"), k=10).collect()
    want = brute(docs, asked, 10)
    for q, _ in asked:
        assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want[q]


def test_small_rests_are_no_shards(spark):
    df = spark.createDataFrame([(i, "x" * 68) for i in range(11)], "doc_id long, text string").coalesce(1)
    sizes = lambda n: [r.n_docs for r in search.build_index(df, shard_bytes=n).select("n_docs").collect()]
    assert sizes(1000) == [11] and sizes(500) == [5, 6]


def test_search_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert search.search(search.build_index(none), asked).count() == 0
    assert search.search(search.build_index(spark.createDataFrame([(1, "a")], "doc_id long, text string")), asked.limit(0)).count() == 0
    with pytest.raises(ValueError, match="parts"):
        search.search(search.build_index(none), asked, max_query_bytes=0)


def test_queries_are_searched_in_blocks(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choices([f"w{j}" for j in range(80)], k=40))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = shared.materialise(search.build_index(df, shard_bytes=2000))
    asked = docs[::10]
    got = search.search(index, spark.createDataFrame(asked + asked[:1], "query_id long, text string"), k=5, block_bytes=400).collect()
    want = brute(docs, asked, 5)
    for q, _ in asked:
        assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want[q]


def test_registered_query_asks_every_twentieth_document(spark):
    docs = shared.table(spark, SF001, "documents").collect()
    asked = [(r.doc_id, r.text) for r in docs if r.doc_id % 20 == 0]
    got = collections.defaultdict(list)
    for r in sorted(queries.op6_search(spark, SF001).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.doc_id, r.score))
    assert len(asked) > 2 and dict(got) == brute([(r.doc_id, r.text) for r in docs], asked, search.K)


# ---- rules

def hand_counts(t):
    t = t or ""
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = collections.Counter(grams)
    hit = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(hit))


def test_counts_by_hand(spark, corpus):
    odd = [(900 + i, t) for i, t in enumerate(["a b c a b c", "a b a b a", "x\n\nx\n x\nx", "é 日本 # $", "a b c", "\x0bA\x0c B\r\nC", "1 2"])]
    rows = corpus + odd
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in rules.apply_rules(df).collect()}
    for i, t in rows:
        r = got[i]
        c = hand_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c, t
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (r.kept and r.base_failed)


def test_fences_follow_group_then_language_then_all(spark):
    rnd = random.Random(1)
    text = lambda n: " ".join(f"word{rnd.randrange(5000)}" for _ in range(80)) + " #" * n
    rows = [(i, text(i % 3), "en", "big") for i in range(150)] + [(200 + i, text(0), "en", "small") for i in range(5)]
    rows += [(300, text(60), "en", "big"), (301, text(60), "xx", "other"), (302, text(0), None, None), (303, text(0), None, None)]
    got = {r.doc_id: r for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept and got[i].level == "source" for i in range(150))
    assert got[200].level == "lang" and got[302].level == "all" and got[302].kept
    assert not got[300].kept and not got[300].base_failed and not got[301].kept


def test_rules_match_sql(spark, tmp_path, corpus):
    rnd = random.Random(2)
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])) for i, t in corpus * 3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    cur = con.execute(queries.oracle_sql()["op8_adaptive_rules"])
    names = [d[0] for d in cur.description]
    got = rules.apply_rules(df).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cur.fetchall(), key=str)


def test_rules_without_rows_and_without_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    out = rules.apply_rules(df)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
