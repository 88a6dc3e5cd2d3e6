"""Repeated passages inside and across lines, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from thematica.llm import passages, shared

rnd = random.Random(21)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(500)]


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


def sentence(n=None):
    return " ".join(rnd.choice(VOCAB) for _ in range(n or rnd.randint(2, 18))).capitalize() + rnd.choice([".", ".", "!", "?"])


def brute(rows):
    """Texts in order of id and row, each judged by what stands earlier."""
    seen, out = set(), {}
    for at in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        t = rows[at][1]
        if t is None:
            out[at] = None
            continue
        w, marked = [x.lower() for x in re.findall(r"[^ \t\n\x0b\x0c\r]+", t)], []
        _, _, starts, stops, _ = passages.stretches([t])
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if tuple(w[a:b]) in seen:
                marked.append((a, b))
            seen.add(tuple(w[a:b]))
        covered = sorted({p for a, b in marked for p in range(a, b)})
        gone, group = [], []
        for p in [*covered, 1 << 60]:
            if group and p != group[-1] + 1:
                if len(group) >= 30:
                    gone.append((group[0], group[-1] + 1))
                group = []
            group.append(p)
        out[at] = passages.without_words(t, gone)
    return [out[i] for i in range(len(rows))]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row long").coalesce(1)
    got = sorted(passages.remove_passages(df, removed="cut").collect(), key=lambda r: r.row)
    return [r.text for r in got], [r.cut for r in got]


PASSAGE = " ".join(sentence(9) for _ in range(7))


def test_passage_inside_lines_and_over_short_lines(spark):
    before, after = sentence(12), sentence(12)
    above, below = sentence(12), sentence(12)
    rows = [(1, f"{sentence()} {PASSAGE} {sentence()}"), (2, f"{before} {PASSAGE} {after}"),
            (3, f"{above}x\n" + PASSAGE.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n") + f"\n{below}x"), (4, f"{PASSAGE}"), (5, sentence(40))]
    got, cut = run(spark, rows)
    assert got == [rows[0][1], f"{before} {after}", f"{above}x\n{below}x", "", rows[4][1]]
    assert cut == [0, 63, 63, 63, 0]


def test_sentences_that_repeat_on_their_own_stay(spark):
    line = "This work is licensed under the public license, version 3."
    rows = [(i, f"{sentence(20)}\n{line}\n{sentence(20)}") for i in range(30)]
    assert run(spark, rows)[0] == [t for _, t in rows]


def test_matches_brute_force(spark):
    shared_parts = [" ".join(sentence() for _ in range(8)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [sentence() for _ in range(rnd.randint(1, 12))]
        for _ in range(rnd.randint(0, 2)):
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(shared_parts))
        rows.append((rnd.choice([i, i, -i, 5, None, 1 << 60]), rnd.choice([" ", "\n", "  "]).join(parts)))
    rows += [(7, None), (None, None), (8, ""), (9, "3.14 is. not ... a! sentence"), (10, rows[0][1]), (10, rows[0][1]), (11, sentence(5000) * 3)]
    got, _ = run(spark, rows)
    assert got == brute(rows)


def test_all_rows_and_columns_stay(spark):
    df = spark.createDataFrame([(1, PASSAGE, 5, "a"), (1, PASSAGE, 6, None)], "doc_id long, text string, _row int, places string")
    out = passages.remove_passages(df)
    assert out.columns == df.columns and sorted(r["_row"] for r in out.collect()) == [5, 6]
    assert sorted(len(r["text"]) for r in out.collect()) == [0, len(PASSAGE)]
    assert passages.remove_passages(df.limit(0)).count() == 0


def words(t):
    return (t or "").split()


def test_long_shared_runs_go_wherever_they_begin(spark):
    """Runs of 60 words and more, cut out of the middle of sentences: what is left of any two texts shares no 60 words."""
    prose = [sentence(rnd.randint(2, 40)) for _ in range(300)]
    flat = " ".join(prose).split()
    rows = []
    for i in range(80):
        own = [rnd.choice(VOCAB) + str(i) for _ in range(rnd.randint(0, 90))]
        at = rnd.randrange(len(flat) // 300) * 300 + rnd.randint(0, 40)
        k = rnd.randint(0, len(own))
        rows.append((i, " ".join(own[:k] + flat[at:at + rnd.randint(60, 250)] + own[k:])))
    got, cut = run(spark, rows)
    assert sum(1 for n in cut if n) > 30
    seen = {}
    for i, t in enumerate(got):
        w = words(t)
        for p in range(len(w) - 59):
            assert seen.setdefault(tuple(w[p:p + 60]), i) == i
    # nothing but shared words goes: each text keeps its own words, in order
    for (i, t), left in zip(rows, got, strict=True):
        mine = re.compile(rf"[a-j]+{i}$")
        assert [w for w in words(t) if mine.match(w)] == [w for w in words(left) if mine.match(w)]


def test_each_word_cut_stands_earlier(spark):
    """Texts of few distinct words: of every 12 words that lose one, all stand in an earlier text or place."""
    few = VOCAB[:6]
    rows = [(i, " ".join(rnd.choice(few) + rnd.choice(["", "", "."]) for _ in range(rnd.randint(0, 200)))) for i in range(60)]
    rows += [(100, "na " * 300), (101, "na " * 300), (102, "da du " * 80 + "x"), (103, "y " + "da du " * 80)]
    got, _ = run(spark, rows)
    assert got == brute(rows)


def test_one_passage_in_a_third_of_the_rows(spark):
    rows = [(i, f"{sentence(15)} {PASSAGE if i % 3 == 0 else sentence(20)} {sentence(15)}") for i in range(600)]
    got, cut = run(spark, rows)
    assert got == brute(rows)
    assert [i for i, n in enumerate(cut) if n] == [i for i in range(3, 600, 3)]


def test_cutting_is_lossless_elsewhere():
    t = "A b c. D e!  f g? \n\n 3.14 h... i.j k.\n"
    assert passages.without_words(t, []) == t
    assert passages.without_words(t, [(0, 3)]) == "D e!  f g? \n\n 3.14 h... i.j k.\n"
    assert passages.without_words(t, [(3, 5)]) == "A b c. f g? \n\n 3.14 h... i.j k.\n"
    assert passages.without_words("a b\nc d\ne f", [(2, 4)]) == "a b\ne f"
    assert passages.without_words("a b\nc d\ne f", [(1, 3)]) == "a\nd\ne f"
    assert passages.without_words("a b\nc d\ne f", [(4, 6)]) == "a b\nc d"
    assert passages.without_words("a b\nc d\ne f", [(0, 1), (2, 3), (5, 6)]) == "b\nd\ne"
    assert passages.without_words("a b", [(0, 2)]) == ""
    assert passages.runs([(0, 12), (40, 60), (12, 31), (50, 69)]) == [(0, 31)]


def test_stretches_of_a_block_are_those_of_its_texts(monkeypatch):
    block = [" ".join(sentence() for _ in range(rnd.randint(0, 30))) for _ in range(50)] + ["", " \n ", "\u00c9t\u00e9 " * 50, "a" * 5000 + " b" * 40]
    one = [passages.stretches([t]) for t in block]
    for size in (passages.BLOCK_BYTES, 100):
        monkeypatch.setattr(passages, "BLOCK_BYTES", size)
        h, of, starts, stops, first = passages.stretches(block)
        for i, (h1, _, s1, e1, f1) in enumerate(one):
            assert (h[first[i]:first[i + 1]] == h1).all() and len(h1) == f1[1] == len(block[i].split())
            assert (starts[of == i] - first[i] == s1).all() and (stops[of == i] - first[i] == e1).all()
    assert len(set(h.tolist())) == len({w.encode().lower() for t in block for w in t.split()})


def test_only_what_repeats_is_written_and_only_rows_with_cuts_travel(spark, monkeypatch):
    rows = [(i, " ".join(sentence() for _ in range(12))) for i in range(300)]
    rows += [(300, f"{sentence(12)} {PASSAGE}"), (301, f"{PASSAGE} {sentence(12)}")]
    written, sent = {}, []
    real, part = passages.materialise, passages.parted

    def counted(df, name="t", *a):
        out = real(df, name, *a)
        written[name] = out.count()
        return out

    def watched(*a):
        out = part(*a)
        sent.append(out[1].count())
        return out

    monkeypatch.setattr(passages, "materialise", counted)
    monkeypatch.setattr(passages, "parted", watched)
    got, cut = run(spark, rows)
    assert got == brute(rows) and [i for i, n in enumerate(cut) if n] == [301]
    assert written.pop("rows") == 302 and max(written.values()) < 100 and sum(sent) < 10


def test_parted_is_a_left_join_on_any_keys(spark):
    keys = [None, 0, -1, 1, 5, 5, 1 << 40, -(1 << 40), 32767, 32768, *range(100, 400)]
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "`a b` long, _bits long")
    few = spark.createDataFrame([(k, str(k)) for k in (0, -1, 5, 1 << 40, -(1 << 40), 32768, 9999, 150)], "k long, v string")
    stay, go = shared.parted(df, "a b", few, "k")
    assert stay.columns == df.columns and go.columns == [*df.columns, "k", "v"]
    known = {0, -1, 5, 1 << 40, -(1 << 40), 32768, 150}
    got = {r["_bits"]: r.v for r in go.collect()} | {r["_bits"]: None for r in stay.collect()}
    assert got == {n: str(k) if k in known else None for n, k in enumerate(keys)}
    assert stay.count() + go.count() == len(keys) and go.count() < 15
    stay, go = shared.parted(df, "a b", few.limit(0), "k")
    assert stay.count() == len(keys) and go.count() == 0


def test_no_join_lets_stretches_through_by_chance(spark, monkeypatch):
    """Of 20,000 stretches 10,000 repeat: the others meet a slot by chance, the more of them the more repeat."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(400)) + f" {PASSAGE} x") for i in range(300)]
    rows += [(i + 300, t) for i, t in rows[:150]]
    written, real = {}, passages.materialise

    def counted(df, name="t", *a):
        out = real(df, name, *a)
        written[name] = out.count()
        plans.append(df._jdf.queryExecution().toString())
        return out

    plans = []
    monkeypatch.setattr(passages, "materialise", counted)
    got, cut = run(spark, rows)
    assert got == brute(rows) and sum(1 for n in cut if n) == 449
    every = passages.keyed(spark.createDataFrame(rows, "doc_id long, text string").withColumn("r", F.col("doc_id")), "r", "doc_id", "text").groupBy("a", "b").count()
    twice = every.where("count > 1").agg(F.sum("count")).first()[0]
    once = every.where("count = 1").count()
    assert twice <= written["repeated"] <= twice + once / 16
    assert not any("Semi" in p for p in plans)


def test_bitmap_has_the_bits_of_its_keys(spark):
    for keys in ([], [0], [-1, 0, 1, 32767, 32768, -(1 << 39), (1 << 39) - 1], [rnd.getrandbits(40) - (1 << 39) for _ in range(3000)]):
        bits = shared.bitmap(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
        n = 8 * len(bits)
        assert n >= 32 * len(keys) and sum(int(b).bit_count() for b in bits) == len({k % n for k in keys})
        assert shared.in_bitmap(bits, np.array(keys, np.int64)).all()
        others = np.array([rnd.getrandbits(40) for _ in range(4000)], np.int64)
        assert shared.in_bitmap(bits, others).tolist() == [k % n in {k % n for k in keys} for k in others.tolist()]


def test_only_keeps_the_wanted_and_few_others_meet_the_join(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 1000 > 0, F.col("id") - 100_000).alias("k"), F.col("id").alias("_wanted"))
    ids = spark.range(60_000).select((F.col("id") * 2 - 100_000).alias("i"))
    got = shared.only(df, "k", ids, "i")
    assert got.columns == ["k", "_wanted"]
    assert sorted(r.k for r in got.collect()) == [k for k in range(-100_000, 20_000, 2) if k % 1000]
    assert shared.only(df, "k", ids.limit(0), "i").count() == 0
