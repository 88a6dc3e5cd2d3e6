"""Structured Streaming use of the row-local operators.

The reference has no streams; everything it does per row (cleaning, lexicon
matches, expression scoring, blank masks, theme flags) is stateless, so the
same column expressions run on a ``readStream`` frame.  The distinct-then-
join-back strategy is a batch optimisation and is not used on streams
(``dedupe=False``).  Running totals by flag combination are a streaming
aggregation; checkpoints live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import automate, overlap, scoring
from ..session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A file stream over a folder (``glob`` picks the files of one table)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def keyword_flags(stream: DataFrame, lexicons: dict, text: str = "text") -> DataFrame:
    """Cleaned text and one match flag per lexicon (stateless)."""
    c = T.clean_text(F.col(text))
    return stream.withColumns({f"{name}_kw": lex.match(c) for name, lex in lexicons.items()})


def flag_activities(stream: DataFrame, scorers: dict, lexicons: dict, text_cols) -> DataFrame:
    """X01 (inline strategy) + X04 on a stream: one output row per input row."""
    p = scoring.predict_activities(stream, scorers, lexicons, text_cols=text_cols, dedupe=False)
    return automate.automate_activities(p, text_cols=text_cols)


def running_overlap(flagged: DataFrame, keys=("year",), amount: str = "usd_disbursement") -> DataFrame:
    """A01 as a streaming aggregation (emit with outputMode complete/update)."""
    return overlap.overlap_by(flagged, list(keys), amount=amount)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Process everything available now into a Parquet sink under the shared
    folder and return it as a batch DataFrame.  Rows never pass the driver."""
    spark = df.sparkSession
    at = checkpoint_location(spark, name)
    out = f"{at}-out"
    q = (df.writeStream.format("parquet").queryName(name).outputMode("append").option("path", out)
         .option("checkpointLocation", at).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
