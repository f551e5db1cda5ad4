"""Records that can't be stored: which and why, row by row, so that one bad record doesn't hold up its batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_NANOS = (1 << 63) - 1
#: A tenant's name: 1 to 128 visible ASCII characters without : # and /.
TENANT = r"^[!-~&&[^:#/]]{1,128}$"


def fault(df: DataFrame) -> Column:
    """What is wrong with a mined record, null if nothing: an absent body that is there, a lossy text without one, fewer
    separators than its parameters need, a time beyond 63 bits or below 0, a tenant that isn't one."""
    kind, body = F.col("body_kind"), F.col("body")
    rules = [
        (~F.coalesce(F.col("tenant_id").rlike(TENANT), F.lit(False)), "tenant_id"),
        (F.col("time_unix_nano").isNull() | (F.col("time_unix_nano") < 0) | (F.col("time_unix_nano") > MOST_NANOS), "time_overflow"),
        ((kind == 2) & body.isNotNull(), "absent_body_present"),
        ((kind == 1) & body.isNull(), "structured_body_missing"),
        ((kind == 0) & F.col("lossy_flag") & body.isNull(), "lossy_body_missing"),
        ((kind == 0) & ~F.col("lossy_flag") & body.isNull() & (F.size("separators") < F.size("params") + 1), "separators"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for bad, name in rules[1:]:
        out = out.when(bad, name)
    return out


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be stored, and those that can't with their `reason`."""
    marked = df.withColumn("reason", fault(df))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def events(bad: DataFrame, now: int) -> DataFrame:
    """One record_quarantined event for each tenant and reason."""
    tenant = F.when(F.coalesce(F.col("tenant_id").rlike(TENANT), F.lit(False)), F.col("tenant_id")).otherwise(F.lit("unknown"))
    return bad.groupBy(tenant.alias("tenant_id"), "reason").agg(F.count(F.lit(1)).cast("int").alias("quarantined")).select("tenant_id", F.lit(now).cast("long").alias("timestamp"), F.lit(7).alias("event_kind"), F.lit("record_quarantined").alias("event_type"), "reason", "quarantined")
