"""Roll-ups of published result tables, training and evaluation on hand-made rows."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_aggregates import VENN
from thematica.functions.lexicon import Lexicon
from thematica.operators import budgets, overlap, training
from thematica.session import write_table

# FIXED VALUES: published amounts by year and flag combination (gender, climate, disability).
BY_YEAR = [
    (2018, False, True, False, 4710.69763500001),
    (2018, True, False, False, 2037.703235),
    (2018, False, False, False, 54084.0664440003),
    (2018, True, True, False, 91.971397),
    (2018, False, False, True, 97.156301),
    (2018, True, False, True, 34.281575),
    (2018, False, True, True, 0.137558),
    (2018, True, True, True, 0.704297),
    (2019, False, False, False, 56139.2537019993),
    (2019, True, False, False, 2451.60314399999),
    (2019, False, False, True, 133.963751),
    (2019, False, True, False, 5344.330131),
    (2019, True, True, False, 102.107867),
    (2019, True, False, True, 47.99243),
    (2019, False, True, True, 2.889656),
    (2019, True, True, True, 0.434474),
    (2020, False, False, False, 69406.0966060004),
    (2020, False, True, False, 6298.350645),
    (2020, True, False, False, 3132.002019),
    (2020, False, False, True, 264.13924),
    (2020, True, False, True, 35.675157),
    (2020, True, True, False, 74.943632),
    (2020, True, True, True, 0.221708),
    (2020, False, True, True, 1.167252),
    (2021, False, False, True, 279.928951),
    (2021, True, False, False, 2386.20729699999),
    (2021, False, False, False, 68040.6116870028),
    (2021, False, True, False, 6162.21409899999),
    (2021, True, True, False, 102.830855),
    (2021, True, False, True, 46.784675),
    (2021, True, True, True, 1.445483),
    (2021, False, True, True, 0.517311),
    (2022, True, False, False, 2420.150022),
    (2022, False, False, False, 62944.2999600001),
    (2022, False, True, False, 8097.89796400001),
    (2022, False, False, True, 223.129636),
    (2022, True, False, True, 25.171087),
    (2022, True, True, False, 231.749102),
    (2022, False, True, True, 0.424928),
    (2022, True, True, True, 0.892379)]

# FIXED VALUES: published budget shares (flags, value, country's total, country, share, label).
BUDGETS = [
    (False, True, False, 113038382103.0, 1651599978567.0, 'Ethiopia', 0.0684417435032162, 'Climate change'),
    (False, False, True, 113842647.0, 1651599978567.0, 'Ethiopia', 6.89287045757744e-05, 'Disability'),
    (True, False, False, 18043675.0, 1651599978567.0, 'Ethiopia', 1.09249668407331e-05, 'Gender'),
    (False, True, False, 433196090894.0, 9383760187375.0, 'Kenya', 0.046164446047633, 'Climate change'),
    (True, False, False, 9755889455.0, 9383760187375.0, 'Kenya', 0.00103965673250321, 'Gender'),
    (False, True, False, 998090776960.375, 131056488747645.0, 'Uganda', 0.00761572957201869, 'Climate change'),
    (False, False, True, 23726000.0, 131056488747645.0, 'Uganda', 1.81036438765618e-07, 'Disability'),
    (True, False, False, 40000000.0, 131056488747645.0, 'Uganda', 3.05211900473099e-07, 'Gender')]


def test_years_roll_up_to_the_combinations(spark):
    df = spark.createDataFrame(BY_YEAR, "year int, principal_gender boolean, principal_climate boolean, "
                                        "principal_disability boolean, usd_disbursement double")
    got = {tuple(r)[:3]: r.usd_disbursement for r in overlap.overlap_by(df, [], any_only=True).collect()}
    assert set(got) == {v[:3] for v in VENN}
    for *flags, amount in VENN:
        assert got[tuple(flags)] == pytest.approx(amount, abs=1e-6)
    # the roll-up keeps all digits: small rows aren't rounded away
    per_year = {tuple(r)[:4]: r.usd_disbursement for r in overlap.overlap_by(df, ["year"]).collect()}
    assert all(per_year[row[:4]] == pytest.approx(row[4], abs=1e-10) for row in BY_YEAR)


def test_small_amounts_are_not_rounded(spark):
    df = spark.createDataFrame([(2020, True, False, False, 0.00000123)] * 1000, "year int, principal_gender boolean, "
                               "principal_climate boolean, principal_disability boolean, usd_disbursement double")
    assert overlap.overlap_by(df, ["year"]).first().usd_disbursement == pytest.approx(0.00123, rel=1e-9)


def test_budget_shares_and_labels(spark):
    df = spark.createDataFrame([r[:4] + (r[5],) for r in BUDGETS], "principal_gender boolean, principal_climate boolean, "
                               "principal_disability boolean, value double, country string")
    rest = {}
    for r in BUDGETS:
        rest[r[5]] = rest.get(r[5], r[4]) - r[3]
    other = spark.createDataFrame([(False, False, False, v, c) for c, v in rest.items()], df.schema)
    out = budgets.label_groups(budgets.share_of_total(df.unionByName(other)))
    got = {(r.country, r.label): (r.value, r.percentage) for r in out.collect()}
    assert got.keys() == {(r[5], r[7]) for r in BUDGETS}
    for *_, value, total, country, share, label in BUDGETS:
        assert got[(country, label)] == (value, pytest.approx(share, rel=1e-9))


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("# a comment\nChangement climatique\n\nCO2\nC# code\nénergie\nCO2\n", encoding="utf-8")
    lex = Lexicon.from_file("climate", str(path))
    assert lex.words == ("Changement climatique", "CO2", "C# code", "énergie", "CO2")
    assert lex.entries[:2] == ("changement climatique", "co2") and "énergie" in lex.entries and len(lex.entries) == 4
    df = spark.createDataFrame([("le changement climatique ici",), ("changement",), ("plus de énergie",)], "t string")
    assert [r[0] for r in df.select(lex.match(F.col("t"))).collect()] == [True, False, True]


def test_multilabel_fit_learns_labels_that_words_decide(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        a, b = bool(rng.random() < 0.3), bool(rng.random() < 0.4)
        words = [f"w{j}" for j in rng.integers(0, 30, 8)] + ["women"] * a + ["river"] * b
        rows.append((" ".join(rng.permutation(words)), [float(a), float(b)], i % 4 == 0))
    df = spark.createDataFrame(rows, "text string, labels array<double>, test boolean").repartition(4).cache()
    model = training.fit_multilabel(df.where("not test"))
    m = {r.class_idx: r for r in training.metrics_per_class(model.predict(df.where("test"))).collect()}
    assert all(m[i].accuracy >= 0.97 and m[i].f1 >= 0.95 for i in (0, 1))
    again = training.fit_multilabel(df.where("not test"))
    assert [x.coefficients.toArray().tolist() for x in model.models] == [x.coefficients.toArray().tolist() for x in again.models]


def test_evaluation_report_is_wide_and_named(spark):
    df = spark.createDataFrame([(1, 1, 2, [0.9, 0.1, 0.2, 0.8]), (2, 0, None, [0.6, 0.1, 0.1, 0.1])],
                               "id int, adapt int, mitig int, p array<double>")
    names = ("a1", "a2", "m1", "m2")
    wide, metrics = training.evaluate_per_class(df, F.col("p"), training.climate_labels("adapt", "mitig"), names)
    r = {x.id: x for x in wide.collect()}
    assert [r[1][f"Label {n}"] for n in names] == [1.0, 0.0, 0.0, 1.0] and [r[2][f"Label {n}"] for n in names] == [0.0] * 4
    assert [r[1][f"Predicted {n}"] for n in names] == [0.9, 0.1, 0.2, 0.8]
    m = {x.class_name: x for x in metrics.collect()}
    assert (m["a1"].accuracy, m["a1"].precision, m["a1"].recall) == (0.5, 0.5, 1.0) and m["m2"].f1 == 1.0


def test_climate_publication(spark):
    rows = [(f"text {i}", f"a{i % 2}", f"m{i % 3}", "X" if i % 10 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "text string, adaptation_label string, mitigation_label string, Remove string")
    out = training.publish_curated(df, ("adaptation_label", "mitigation_label"))
    assert out.columns == ["text", "adaptation_label", "mitigation_label", "split"]
    n = {}
    for r in out.collect():
        k = (r.adaptation_label, r.mitigation_label)
        n.setdefault(k, [0, 0])[r.split == "test"] += 1
    assert sum(map(sum, n.values())) == 540 and len(n) == 6
    assert all(t == round(0.2 * (t + k)) for k, t in n.values())


def test_multilabel_fit_takes_blocks_of_rows_and_steps_by_the_mean_gradient(spark, monkeypatch):
    """One written row a block of rows; probabilities as of the same steps taken row by row."""
    rows = [(["x y", "y z z", None, "", "x x w v", "z"][i % 6], [float(i % 2), float(i % 5 == 0)]) for i in range(240)]
    df = spark.createDataFrame(rows, "text string, labels array<double>").repartition(2)
    wrote = {}

    def write(x, name):
        t = write_table(x, name)
        wrote[name] = t.count()
        return t

    monkeypatch.setattr(training, "write_table", write)
    model = training.fit_multilabel(df, num_features=64, max_iter=5)
    assert max(wrote.values()) < 60  # not a row a text
    buckets = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64 for w in "vwxyz"}
    tf = np.zeros((240, 64))
    for i, (t, _) in enumerate(rows):
        for w in (t or "").split():
            tf[i, buckets[w]] += 1
    v = tf * (np.log(241 / (1 + (tf > 0).sum(axis=0))) + 1)
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
    y = np.array([r[1] for r in rows])
    scale = np.where(y == 1, (y == 0).sum(axis=0) / (y == 1).sum(axis=0), 1)
    w, b = np.zeros((64, 2)), np.zeros(2)
    for _ in range(5):
        r = (1 / (1 + np.exp(-(v @ w + b))) - y) * scale
        w, b = w - 4 * v.T @ r / 240, b - 4 * r.sum(axis=0) / 240
    want = {t: p for (t, _), p in zip(rows, 1 / (1 + np.exp(-(v @ w + b))))}
    got = model.predict(df).collect()
    assert len(got) == 240 and all(np.allclose(r.predictions, want[r.text], atol=1e-9) for r in got)


def test_words_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(training, "HELD_WORDS", 4)
    rows = [[1, 1, 2], None, [], [3], [5] * 9, [], [2, 1], [1]]
    got = []
    for at, sizes, f, n in training._counted(pa.array([None, *rows], pa.list_(pa.int32())).slice(1), 8):
        assert at == len(got)
        first = np.r_[0, np.cumsum(sizes)]
        got += [dict(zip(f[a:b].tolist(), n[a:b].tolist(), strict=True)) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [{1: 2, 2: 1}, {}, {}, {3: 1}, {5: 9}, {}, {1: 1, 2: 1}, {1: 1}]
