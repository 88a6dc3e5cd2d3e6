"""Sources and sinks.

Every reader pins a schema (no inference pass over 100 TB) and every writer
is a distributed DataFrame write; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.columns import source_order


def read_csv(spark: SparkSession, path, schema: StructType | str | None = None, *,
             header: bool = True, multiline: bool = True, null_value: str | None = None,
             sep: str = ",") -> DataFrame:
    """Header CSV with quoted multi-line text and a pinned schema.

    ``null_value='NA'`` reads R's bare NA as missing (N14).  Without a schema
    every column is read as string (no inference scan).
    """
    r = (spark.read.option("header", header).option("multiLine", multiline)
         .option("escape", '"').option("sep", sep).option("mode", "PERMISSIVE"))
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A published dataset partitioned by ``split``; ``None`` = all splits.

    The split predicate is a partition filter, so only that folder is read.
    """
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def save_table(df: DataFrame, name: str, path: str, partition_by=(), bucket_by=(), buckets: int = 32) -> DataFrame:
    """A warehouse table: Parquet under ``path``, registered in the catalog as ``name``.

    Rows are dealt by the bucket key before the write, so each task holds whole buckets and writes one file a bucket
    and partition.  Tables with the same buckets join on the key without an exchange, and filters on
    ``partition_by`` read only the partitions they name."""
    by, bucket_by = list(partition_by), list(bucket_by)
    w = df.repartition(buckets, *bucket_by) if bucket_by else df
    w = w.write.mode("overwrite").format("parquet").option("path", path)
    if by:
        w = w.partitionBy(*by)
    if bucket_by:
        w = w.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def extract(source, predicate: Column, path: str | None = None, fmt: str = "csv", spark: SparkSession | None = None) -> DataFrame:
    """Warehouse extract with a predicate (pushed to the scan), optionally written.
    ``source`` is a frame, or the name of a table of ``spark``'s catalog."""
    df = spark.table(source) if isinstance(source, str) else source
    out = df.where(predicate)
    if path is not None:
        write_csv(out, path) if fmt == "csv" else out.write.mode("overwrite").parquet(path)
    return out


def read_tagged(spark: SparkSession, paths, schema: StructType | str, tag_regex: str,
                tag_col: str = "tag", header: bool = True, ord_col: str | None = "row_ord",
                file_col: str = "source_file", multiline: bool = True) -> DataFrame:
    """Many exported sheets into one table tagged from each file name.

    ``tag_regex`` has one group, e.g. ``r'/(\\d{4})[^/]*\\.csv$'`` for a year.
    ``ord_col`` keeps the sheet's row order (P25, ``columns.source_order``).
    Cells with line breaks need ``multiline``, which reads a file in one task; without it a large sheet is split
    over tasks and its order still holds.
    """
    r = spark.read.option("header", header).option("multiLine", multiline).option("escape", '"').schema(schema)
    df = r.csv(paths)
    # columns of the scan itself: nothing may move rows before they are taken
    df = df.withColumns({file_col: F.col("_metadata.file_path"), **({ord_col: source_order()} if ord_col else {})})
    return df.withColumn(tag_col, F.regexp_extract(F.col(file_col), tag_regex, 1))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_split(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """Publish a split dataset as parquet partitioned by split."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
