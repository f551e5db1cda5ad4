"""Comparison of two results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that the two multisets hold a different number of times, with both numbers; empty for equal ones."""
    keys = a.columns
    one, two = counted(a, keys, "a").withColumn("b", F.lit(0).cast("long")), counted(b, keys, "b").withColumn("a", F.lit(0).cast("long"))
    return one.unionByName(two).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> b")


def both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left, right = a.withColumnRenamed("n", "a"), b.withColumnRenamed("n", "b")
    return left.join(right, keys, "full_outer").select(*keys, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def aggregates(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose n differ; a cell that one side lacks has 0 there."""
    return both(a, b, keys).where("a <> b")


def margin(a: DataFrame, b: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Each cell with whether b has at least that share of a; a cell that only b has never passes."""
    return both(a, b, keys).withColumn("passed", (F.col("a") > 0) & (F.col("b") <= F.col("a")) & (F.col("b") * 1.0 >= least * F.col("a")))


def reconstruction_rate(rendered: DataFrame, raw: str = "raw") -> DataFrame:
    """The share of text lines that aren't lossy whose rendering is the line, byte by byte."""
    return rendered.where(~F.col("lossy_flag") & (F.col("body_kind") == 0)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rendered").eqNullSafe(F.col(raw)), 1.0).otherwise(0.0)).alias("rate"))


def convergence(mined: DataFrame, every: int) -> DataFrame:
    """Templates seen after each `every` lines: step, templates. A template counts from the step of its first line."""
    first = mined.where("template_id > 0").groupBy("template_id").agg(F.min(F.expr(f"seq div {every}")).alias("step"))
    per_step = first.groupBy("step").agg(F.count(F.lit(1)).alias("new"))
    # few rows: one per step
    return per_step.select("step", F.expr("sum(new) over (order by step rows between unbounded preceding and current row)").alias("templates"))
