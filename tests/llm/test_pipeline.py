"""The stages of the corpus pipeline, each held against its own input."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from tests.conftest import SF001
from thematica.llm import packing, shared
from tests.llm.test_near_dedup import brute, paragraphs_brute, shingle_set
from tests.llm.test_passages import brute as passages_brute
from thematica.llm.paragraphs import MIN_WORDS


def test_stages(spark):
    docs = shared.table(spark, SF001, "documents")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = shared.materialise(stage(spark, seen[-1], SF001), name)
        if name != "packing":
            assert out.columns == columns
        seen.append(out)
    rows = [{r.doc_id: r for r in x.collect()} for x in seen[:-1]]
    raw, lang, good, near, para = rows
    labels = {r.doc_id: r.quality for r in shared.table(spark, SF001, "labels").collect()}
    assert set(lang) <= set(raw) and len(lang) >= 0.98 * len(raw)
    assert set(good) <= set(lang) and all(good[i] == raw[i] for i in good)
    clean = [i for i in lang if labels.get(i) == 1]
    junk = [i for i in lang if labels.get(i) == 0]
    assert sum(i in good for i in clean) >= 0.95 * len(clean) and sum(i in good for i in junk) <= 0.1 * len(junk)
    comp = brute({i: shingle_set(r.text, 5) for i, r in good.items()})
    assert set(near) == {i for i in comp if comp[i] == i}
    gone = paragraphs_brute([(i, r.text) for i, r in near.items()], MIN_WORDS)
    lines = [(i, "\n".join(x for p, x in enumerate(r.text.split("\n")) if (i, p) not in gone)) for i, r in near.items()]
    for (i, _), left in zip(lines, passages_brute(lines), strict=True):
        assert para[i].text == left and para[i].n_chars == len(left)
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    packed = seen[-1].collect()
    assert {r.doc_id for r in packed} == set(para)
    for r in packed:
        ids = np.array(tok.encode(para[r.doc_id].text, add_special_tokens=False).ids + [1], "<u4")[r.start:r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_run_applies_all_stages(spark):
    out = E.queries()["pipeline"](spark, SF001)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_nulls_and_empty_table(spark):
    docs = shared.table(spark, SF001, "documents")
    odd = spark.createDataFrame([(10**7, None, "en", "src0", 0), (10**7 + 1, "", "en", "src0", 0), (None, None, None, None, None)], docs.schema)
    x = docs.unionByName(odd).unionByName(docs.limit(3))
    for _, stage in corpus_pipeline.STAGES:
        x = stage(spark, x, SF001)
    assert x.count() > 0
    x = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        x = stage(spark, x, SF001)
    assert x.count() == 0


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 14)] + ["pipeline"])
def test_registered(name):
    assert sum(q.startswith(name) for q in E.queries()) == 1
