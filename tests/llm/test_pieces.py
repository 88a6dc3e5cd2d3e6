import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from thematica.llm import pieces, shared

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = ["", " ", "  a  b ", "a\n\nb\t c\r", "é😀 日本 ▁x ▁▁y", " x　y", "a\x00b", " \n ", "aaaaaaaaaaaaa", "<s> </s> <unk> <0x0A>",
       "ab" * 300, "Ünïcödé — “quotes” …", "1234567890 12.5%", "CamelCaseWordsAndTHEREST", "́ combining é"]


def test_ids_equal_the_library(spark, corpus, sp):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in pieces.round_trip(df).collect()}
    for i, t in rows:
        if t is None:
            assert got[i].ids is None and got[i].restored
        else:
            assert got[i].ids == sp.encode(t)
            assert got[i].restored == (sp.decode(got[i].ids) == t)
            assert got[i].restored or pieces.MARK in t


def test_random_strings_equal_the_library(sp):
    p = pieces.Pieces.load(PATH)
    codec = pieces.Codec(p)
    rnd = random.Random(9)
    common = "the of and tion ing er in on a b c th sh aa aaa . , ' é ü 日".split()
    texts = ["".join(rnd.choice([*common, " ", "  ", "\n"]) for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    for t, ids in zip(texts, codec.encode(texts)):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == sp.encode(t), t
        assert p.decode(ids) == t == sp.decode(ids)


def test_unigram_viterbi_is_the_best_path():
    rnd = random.Random(1)
    vocab = [("<unk>", 0.0)] + [("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))), -rnd.random() * 5) for _ in range(40)]
    vocab = list(dict(vocab).items())
    p = pieces.Pieces(vocab, True, 0, None)

    def best(w):
        if not w:
            return 0.0
        out = []
        for n in range(1, len(w) + 1):
            if w[:n] in p.id:
                out.append(p.score[p.id[w[:n]]] + best(w[n:]))
        out.append(min(p.score) - 10.0 + best(w[1:]))
        return max(out)

    words = sorted({"".join(rnd.choice("abcz") for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    for w, ids in p.walk(words):
        ids = np.frombuffer(ids, "<u4").tolist()
        text = [p.text[i] for i in ids]
        if 0 not in ids:
            assert "".join(text) == w and abs(sum(p.score[i] for i in ids) - best(w)) < 1e-9


def test_prefix_states_do_not_depend_on_the_word_before():
    p = pieces.Pieces.load(PATH)
    words = sorted({"▁the", "▁them", "▁theme", "▁thesis", "▁thes", "▁other", "other", "▁theory", "▁thé"})
    together = dict(p.walk(words))
    assert together == {w: dict(p.walk([w]))[w] for w in words}


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", [5]), (1, "a b", [6]), (None, None, None)], "doc_id long, text string, c0 array<int>")
    out = pieces.encode(df)
    assert out.columns == ["doc_id", "text", "c0", "ids"]
    assert sorted((r.c0 for r in out.collect() if r.c0)) == [[5], [6]]
    assert pieces.round_trip(df.limit(0)).count() == 0


def test_decoding_looks_only_at_special_ids_one_by_one():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    vocab = [("<unk>", 0.0), ("<s>", 0.0), ("▁a", -1.0), ("b", -2.0), ("<0xC3>", 0.0), ("<0xA9>", 0.0)]
    p = pieces.Pieces(vocab, False, 0, {0xC3: 4, 0xA9: 5}, {1})
    p.byte_of = Counted(p.byte_of)
    assert p.decode([2, 3] * 500) == ("ab " * 500)[:-1] and Counted.asked == 0
    assert p.decode([1, 2, 4, 5, 3, 4, 0, 3, 5, 1, 5]) == "aéb� ⁇ b��" and Counted.asked == 8
    assert p.decode([]) == ""


def test_lists_are_decoded_together(monkeypatch):
    import pyarrow as pa

    vocab = [("<unk>", 0.0), ("<s>", 0.0), ("▁a", -1.0), ("b", -2.0), *[(f"<0x{b:02X}>", 0.0) for b in (0xC3, 0xA9, 0xE2, 0x96, 0x81, 0x0A)], ("é▁", -3.0)]
    p = pieces.Pieces(vocab, False, 0, {0xC3: 4, 0xA9: 5, 0xE2: 6, 0x96: 7, 0x81: 8, 0x0A: 9}, {1})
    rnd = random.Random(3)
    lists = [[], None, [4, 1, 5], [4, 5], [6, 7, 8], [2, 9, 9, 3], [1], [0, 10], [4, 3, 5]]
    lists += [[rnd.randrange(len(vocab)) for _ in range(rnd.randint(0, 12))] for _ in range(2000)]
    arr = pa.array([[2], *lists, [3]], pa.list_(pa.int32())).slice(1, len(lists))
    assert p.decode_lists(arr) == [None if x is None else p.decode(x) for x in lists]
    monkeypatch.setattr(p, "decode", None)  # ordinary texts aren't decoded one by one
    assert p.decode_lists(pa.array([[2, 3, 9, 2], [4, 5, 3]], pa.list_(pa.int32()))) == ["ab\n a", "éb"]
    assert p.decode_lists(pa.array([], pa.list_(pa.int32()))) == []
