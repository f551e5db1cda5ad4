"""Text corpora as log records: a line each, a millisecond apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP = 1_000_000


def severity(line: Column) -> Column:
    """The floor of the first level that stands alone in a line; INFO without one."""
    level = F.regexp_extract(line, r"(?:^|[^A-Za-z0-9_])(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)(?![A-Za-z0-9_])", 1)
    return F.when(level == "TRACE", 1).when(level == "DEBUG", 5).when(level.isin("WARN", "WARNING"), 13).when(level == "ERROR", 17).when(level == "FATAL", 21).otherwise(9)


def lines(spark: SparkSession, path: str, tenant: str, start: int = 0) -> DataFrame:
    """One record per line of the files. `file` and `row` say where it stands; its time is a millisecond for each line before
    it in its file, whatever the partitions."""
    text = spark.read.text(path).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # a line's number within its block is told by its id; blocks before it in the file are counted
    blocks = text.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    seq = F.col("_before") + F.col("_id") - F.col("_first")
    numbered = text.join(F.broadcast(before), ["file", "_block"])
    return numbered.select(F.lit(tenant).alias("tenant_id"), "file", seq.alias("seq"), (F.lit(start) + seq * STEP).alias("time_unix_nano"), (F.lit(start) + seq * STEP).alias("effective_time_unix_nano"), severity(F.col("body")).alias("severity_number"), F.lit(None).cast("string").alias("scope_name"), F.lit(None).cast("string").alias("event_name"), F.lit(0).cast("byte").alias("body_kind"), "body")
