"""Language identification and the quality classifier."""

import binascii
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from thematica.llm import langid, quality, shared


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


# ---- quality

def test_held_out_accuracy(spark):
    docs, labels = shared.table(spark, SF01, "documents"), shared.table(spark, SF01, "labels")
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if binascii.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held) and sum(r.held_out for r in got) == len(held)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = shared.table(spark, SF01, "documents"), shared.table(spark, SF01, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, flipped)


def test_pairwise_fit_finds_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    s = x @ np.array([2.0, -1.0, 0.0, 0.5])
    y = (s > np.quantile(s, 0.3)).astype(int)
    m = quality.fit_pairs(x, y, pairs=20_000)
    assert ((m.scores(x) >= quality.CUT_SCORE) == (y == 1)).mean() > 0.98
    # strengths agree with a plain gradient descent on the same loss
    assert np.corrcoef(m.strengths(x), s)[0, 1] > 0.98


def test_scores_of_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "x " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == 5 and all(abs(r.score - quality.CUT_SCORE) < 1e-9 for r in got)
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (2, None), (2, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.score_documents(docs, model).collect())
    assert quality.score_documents(docs.limit(0), model).count() == 0
    assert quality.filter_documents(docs, labels).columns == docs.columns


def test_features_are_bounded_and_finite():
    h = shared.WordHasher()
    for t in [None, "", "\n", "a", "a a a", "#" * 1000, "x" * 100_000, "日本 語", "\ud800 lone"]:
        v = quality.features(t, h)
        assert len(v) == len(quality.FEATURES) and all(math.isfinite(x) for x in v)


# ---- language

def test_documents_are_kept_in_their_language(spark):
    docs = shared.table(spark, SF01, "documents")
    got = langid.identify(docs, shared.table(spark, SF01, "pages"), langid.train(docs)).collect()
    assert len(got) == docs.count() + shared.table(spark, SF01, "pages").count()
    assert np.mean([r.kept and r.language == r.declared for r in got]) > 0.99


def test_other_scripts_are_rejected_and_wrong_declarations_overruled(spark):
    docs = shared.table(spark, SF01, "documents")
    model = langid.train(docs)
    en = docs.where("lang = 'en' and n_chars > 800").orderBy("doc_id").first().text
    extra = spark.createDataFrame([(10**6, "Это совершенно другой язык, которого нет в таблице. " * 20, "en", "src0", 1),
                                   (10**6 + 1, en, "de", "src0", 1), (10**6 + 2, "", None, None, 0), (10**6 + 3, None, None, None, None),
                                   (None, en, None, None, 5)], docs.schema)
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(extra), None, model).collect() if r.doc_id is None or r.doc_id >= 10**6}
    assert got[10**6].language == "und" and not got[10**6].kept
    assert got[10**6 + 1].language == "en" and got[10**6 + 1].kept
    assert not got[10**6 + 2].kept and not got[10**6 + 3].kept
    assert got[None].language == "en" and got[None].kept


def test_every_declared_language_is_modelled(spark):
    docs = shared.table(spark, SF001, "documents")
    model = langid.train(docs)
    assert set(model.languages) == {r.lang for r in docs.where("lang is not null and length(text) > 0").select("lang").distinct().collect()}
    got = [r for r in langid.identify(docs, None, model).collect() if r.declared == "es"]
    assert got and np.mean([r.language == "es" for r in got]) > 0.9


def test_rare_language_beside_many_rows_and_many_languages(spark, monkeypatch):
    """The sample is taken in each language; a full task hands its counts on."""
    monkeypatch.setattr(langid, "LANGUAGES_HELD", 8)
    rows = [(i, f"common words {i % 50} of the first language", "aa") for i in range(3000)]
    rows += [(10_000 + i, f"zxq{chr(97 + i % 20)} vrk{chr(97 + i % 20)} " * 5, f"l{i % 150}") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    assert len(model.languages) == 151


def test_repeated_ids_train_once(spark):
    rows = [(i, f"some words number {chr(97 + i)}", "aa") for i in range(20)]
    one = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    many = langid.train(spark.createDataFrame(rows + rows[3:4] * 500, "doc_id long, text string, lang string"))
    assert one == many


def brute_posterior(rows, languages):
    """Plain Python version of the fusion; rows: (ll, n, host, domain, suffix, declared)."""
    n = len(languages)
    own = []
    for ll, k, *_ in rows:
        top = max(ll)
        own.append(next(i for i in range(n) if ll[i] == top) if k > 0 and ll[n] < top else None)
    votes = {}
    for r, o in zip(rows, own):
        for place, v in enumerate(r[2:]):
            if v is not None:
                c = votes.setdefault((place, v), [0] * n)
                if o is not None:
                    c[o] += 1
    g = [own.count(i) + 1.0 for i in range(n)]
    share = [x / sum(g) for x in g]
    out = []
    for r, o in zip(rows, own):
        ll, k = r[0], r[1]
        c = {}
        for place, v in enumerate(r[2:]):
            c[place] = votes.get((place, v)) if v is not None else None
        less = lambda place: [x - (i == o) for i, x in enumerate(c[place])] if c[place] else [0] * n
        smooth = lambda place, parent: [(x + langid.KAPPA * q) / (sum(less(place)) + langid.KAPPA) for x, q in zip(less(place), parent)]
        prior = smooth(0, smooth(1, share))
        s = []
        for i in range(n + 1):
            v = ll[i] * langid.GRAMS / max(k, langid.GRAMS)
            v += math.log(prior[i]) + math.log(1 - langid.UNKNOWN_PRIOR) if i < n else math.log(langid.UNKNOWN_PRIOR)
            for place in (2, 3):
                if c[place]:
                    among = (sum(c[place]) + 1) / (sum(g) + 1)
                    v += math.log((less(place)[i] + langid.KAPPA * among) / (g[i] + langid.KAPPA)) if i < n else math.log(among)
            s.append(v)
        top = max(s)
        best = s.index(top)
        out.append((languages[best] if best < n else langid.UNKNOWN, 1 / sum(math.exp(x - top) for x in s)))
    return out


def test_fusion_matches_plain_python(spark):
    rnd = random.Random(3)
    langs = ("aa", "bb", "cc")
    rows = []
    for i in range(300):
        host = rnd.choice(["a.x.org", "b.x.org", "c.y.com", "x.org", None])
        n = rnd.choice([1, 10, 500])
        rows.append(([-rnd.random() * 2 * n - n for _ in range(4)], n, host, ".".join(host.split(".")[-2:]) if host else None,
                     host.split(".")[-1] if host else None, rnd.choice(["aa", "bb", "zz", None])))
    df = spark.createDataFrame([(i, [float(np.float32(x)) for x in r[0]], *r[1:]) for i, r in enumerate(rows)],
                               "id int, ll array<float>, n_grams long, host string, domain string, suffix string, declared string")
    rows = [([float(np.float32(x)) for x in r[0]], *r[1:]) for r in rows]
    got = {r.id: (r.language, r.posterior) for r in langid.fuse(df, langs).collect()}
    for i, (lang, p) in enumerate(brute_posterior(rows, langs)):
        assert got[i][0] == lang and abs(got[i][1] - p) < 1e-6


def test_markup_and_addresses(spark):
    df = spark.createDataFrame([("<HTML class=x lang='pt-BR'>", "https://u:p@News.Example.CO.uk:80/a"), ("<p lang=de>", "mailto:x"), (None, None)], "html string, url string")
    got = [tuple(r) for r in df.select(langid.markup_language(F.col("html")), langid.host_of(F.col("url"))).collect()]
    assert got == [("pt", "news.example.co.uk"), (None, None), (None, None)]
    assert b"<" not in langid.TAGS.sub(" ", "<script>var a='<p>'</script>x<!-- <b> --><p class='a'>y").encode()


def test_empty_tables_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", "k")], "doc_id long, text string, lang string, source string, kept string")
    model = langid.train(docs.limit(0))
    assert model.languages == ()
    assert [r.kept for r in langid.identify(docs, None, model).collect()] == [False]
    big = shared.table(spark, SF01, "documents")
    model = langid.train(big)
    assert langid.identify(big.limit(0), None, model).count() == 0
    out = langid.filter_documents(big.withColumn("kept", F.lit(1)), model)
    assert out.columns == [*big.columns, "kept"] and out.count() >= 0.99 * big.count()
