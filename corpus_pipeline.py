"""From raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``docs``.

1. language_id: documents in no known language go.
2. quality: documents that the classifier scores below its cut go.
3. near_dedup: of documents whose 5-word shingle sets are linked by similarities of
   0.8 or more, the one with the smallest id stays.
4. paragraph_dedup: paragraphs that repeat an earlier one, and passages that repeat inside
   or across lines, are cut out of the texts.
5. packing: what is left is tokenised and packed into sequences.

Null texts are in no language and have no quality to score: they go in stage 1.
An empty table passes through all stages.  Very long texts are read whole.  Rows
that repeat an id are one document to stages 3 and 4, ties go to the smaller id,
and extra columns pass through under any name but the contract's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thematica.llm import langid, near_dedup, packing, paragraphs, passages, quality
from thematica.llm.shared import importable, materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return langid.filter_documents(docs, langid.train(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return near_dedup.drop_near_duplicates(docs)


def paragraph_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    out = passages.remove_passages(paragraphs.remove_repeated(docs))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_duplicates),
    ("paragraph_dedup", paragraph_dedup),
    ("packing", pack),
]

#: the models, components and tokens can't be written in SQL; tests hold stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
