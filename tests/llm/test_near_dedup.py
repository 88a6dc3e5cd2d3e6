"""MinHash near-dedup, paragraphs and components against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from thematica.llm import near_dedup, paragraphs, shared
from thematica.llm.components import connected_components


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


def words(t):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def shingle_set(t, k):
    w = words(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


class Union:
    def __init__(self, items):
        self.p = {x: x for x in items}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def brute(sets, percent=80):
    u = Union(sets)
    items = sorted(sets)
    for i, a in enumerate(items):
        for b in items[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                u.join(a, b)
    return {x: u.find(x) for x in sets}


def test_matches_brute_force(spark, corpus):
    # extra columns with names that the operator uses itself
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], "doc_id long, text string, n_shingles string, rep int")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    sets = {i: shingle_set(t, 2) for i, t in corpus}
    want = brute(sets)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(30):  # neighbours are similar, ends are not
        base = base[:3 * i] + [f"x{i}a", f"x{i}b", f"x{i}c"] + base[3 * i + 3:]
        docs.append((100 - i, " ".join(base)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute({i: shingle_set(t, 2) for i, t in docs})


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[:i % 200] + [f"new{i}"] + base[i % 200 + 1:])) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = near_dedup.near_duplicates(df).groupBy("component_id").count().collect()
    assert [(r.component_id, r["count"]) for r in got] == [(0, 600)]


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A B  c"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_drop_keeps_all_columns(spark, corpus):
    df = spark.createDataFrame([(i, t, i * 2) for i, t in corpus], "doc_id long, text string, component_id long")
    out = near_dedup.drop_near_duplicates(df)
    assert out.columns == df.columns
    want = brute({i: shingle_set(t, 5) for i, t in corpus})
    assert {r.doc_id for r in out.collect()} == {i for i in want if want[i] == i}


def test_components(spark):
    links = [(i, i + 1) for i in range(40, 80)] + [(5, 90), (90, 7), (7, 7), (5, 90), (200, 100)] + [(300, i) for i in range(301, 340)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    u = Union({x for p in links for x in p})
    for a, b in links:
        u.join(a, b)
    assert got == {x: u.find(x) for x in u.p if u.find(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def paragraphs_brute(docs, least):
    sets = {}
    for i, t in docs:
        for place, line in enumerate((t or "").split("\n")):
            if i is not None and len(words(line)) >= least:
                sets[(i, place)] = shingle_set(line, 5)
    comp = brute(sets)
    return {p for p in comp if comp[p] != p}


def test_paragraphs_match_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t, "keep") for i, t in corpus], "doc_id long, text string, place string")
    out = paragraphs.remove_repeated(df, removed="removed")
    got = {r.doc_id: r for r in out.collect()}
    gone = paragraphs_brute(corpus, paragraphs.MIN_WORDS)
    assert gone
    for i, t in corpus:
        drop = sorted(p for d, p in gone if d == i)
        assert got[i].removed == drop and got[i].place == "keep"
        assert got[i].text == (t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop))


def test_paragraphs_edge_rows(spark):
    line = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, line), (2, line + "\n" + line), (2, line + "\n" + line), (1, "x\n" + line), (3, None), (4, "")],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in paragraphs.remove_repeated(df).collect()), key=str)
    assert got == sorted([(None, line), (2, ""), (2, ""), (1, "x\n" + line), (3, None), (4, "")], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.remove_repeated(empty).count() == 0


def test_paragraph_number_too_large_is_refused(spark):
    df = spark.createDataFrame([(1 << 60, " ".join(f"w{i}" for i in range(50)))], "doc_id long, text string")
    with pytest.raises(Exception, match="too large"):
        paragraphs.remove_repeated(df).collect()


def test_recall_formula():
    """The bands give the recall that the docstrings state."""
    tensored = lambda s: (1 - (1 - s ** near_dedup.HALF) ** near_dedup.BANDS) ** 2
    assert tensored(0.8) > 0.998 and tensored(0.85) > 0.9998
    assert 1 - (1 - 0.8 ** paragraphs.ROWS) ** paragraphs.BANDS > 0.9997


def test_no_query_pairs_all_members(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    plan = near_dedup.near_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def generations(words, edits, copies, last):
    """A text, ``copies`` of it with the edits of each generation, and of each copy copies of copies."""
    rnd = random.Random(3)

    def edit(w, n):
        w = list(w)
        for p in rnd.sample(range(5, len(w) - 5), n):
            w[p] = f"e{rnd.randrange(10**9)}"
        return w

    hot = [f"w{i}" for i in range(words)]
    out = [hot]
    for _ in range(copies):
        w = hot
        for n in edits:
            w = edit(w, n)
            out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out + [edit(hot, last) for _ in range(20)])]


def test_copies_of_copies_of_a_hot_paragraph(spark):
    docs = generations(50, [1, 1, 1], 60, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in paragraphs.remove_repeated(df, removed="removed").where("size(removed) > 0").collect()}
    assert got == {i for i, _ in paragraphs_brute(docs, paragraphs.MIN_WORDS)}


def test_copies_of_copies_of_a_hot_document(spark):
    docs = generations(50, [2, 2, 2], 100, 7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute({i: shingle_set(t, 2) for i, t in docs})


def test_members_of_one_table_are_linked_without_their_head(spark):
    """Two members that are similar to each other and not to the head meet in no other table."""
    hot = [f"w{i}" for i in range(50)]
    a = hot[:10] + ["x1", "x2", "x3", "x4", "x5", "x6"] + hot[16:]
    docs = [(1, hot), (2, a), (3, a[:30] + ["y"] + a[31:]), (4, hot[:5] + ["z"] + hot[6:])]
    rows = [(7, len(shingle_set(" ".join(w), 2)), i, 1, 49, 4) for i, w in docs]
    links = near_dedup.link_rows(spark.createDataFrame(rows, "key long, n int, id long, head long, head_n int, m long"),
                                 spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "id long, text string"), 2)
    assert {tuple(sorted(r)) for r in links.collect()} == {(1, 4), (2, 3)}


def test_copies_of_paragraphs_are_no_vertices(spark, monkeypatch):
    """Copies follow their class: the components' rounds see none of them, but those of ids that repeat."""
    rnd = random.Random(4)
    line = lambda: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(300)) for _ in range(40))
    lines = [line() for _ in range(40)]
    near = lines[0].split(" ")
    near = " ".join([*near[:-1], "other"])
    rows = [(i, lines[i % 40]) for i in range(400)] + [(500, near), (501, near)]
    seen, real = [], paragraphs.connected_components

    def counted(links):
        seen.append(links.count())
        return real(links)

    monkeypatch.setattr(paragraphs, "connected_components", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.place, r.first_doc, r.first_place) for r in paragraphs.repeated(df).collect()}
    assert got == {i: (0, i % 40, 0) for i in range(40, 400)} | {500: (0, 0, 0), 501: (0, 0, 0)}
    assert seen == [1]
    # row 7 stands for two texts: its classes are one, as are their copies
    rows = [(1, lines[1]), (7, lines[1]), (7, lines[2]), (9, lines[2]), (3, lines[3]), (9, lines[4])]
    got = sorted(tuple(r) for r in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, 0, 1, 0), (9, 0, 1, 0)]
    assert seen[1] == 2


def test_lines_of_ids_too_large_to_name_are_no_candidates(spark):
    """Short-worded lines of ids beyond the range take no paragraph's place."""
    text = " ".join(f"w{i}" for i in range(40))
    far = 5 + (1 << 43)  # its shifted id is that of 5
    df = spark.createDataFrame([(5, text), (6, text + " x"), (far, "a" * 100)], "doc_id long, text string")
    got = [tuple(r) for r in paragraphs.repeated(df).collect()]
    assert got == [(6, 0, 5, 0)]
