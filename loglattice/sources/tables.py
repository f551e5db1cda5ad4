"""The driver's tables as log records, and the same views in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.plans.compile import Promoted

#: Attributes with columns of their own.
PROMOTED = {("resource", "service.name"): Promoted("service"), ("attr", "k"): Promoted("attr__k", "i64"), ("attr", "value"): Promoted("attr__value", "f64"), ("attr", "note"): Promoted("attr__note")}

#: The logs view in SQL; DuckDB's spelling. Spark's is built from the same parts below.
LOGS_SQL = """logs as (select event_id, user_id, 't' || (user_id % 2) as tenant_id, epoch_us(ts) * 1000 as t,
 case event_type when 'error' then 17 when 'purchase' then 13 when 'signup' then 9 when 'click' then 5 else 0 end as severity_number,
 event_type as event_name, case when user_id % 7 = 0 then null else 'lib.' || event_type end as scope_name,
 'svc-' || (user_id % 5) as service, cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as bigint) as attr__k, value as attr__value,
 case user_id % 4 when 0 then '1.5' when 1 then 'n/a' when 2 then cast(event_id % 10 as varchar) end as attr__note,
 md5(user_id || '-' || (event_id // 8)) as trace_id, event_id % 3 as version, event_id % 50 + 1 as template_id,
 'user ' || user_id || ' ' || event_type || ' cents ' || cast(round(value * 100) as bigint) as body from events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mined log records of two tenants: severity by kind of event (views unspecified), some null scopes, and
    attributes both as columns and as canonical text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = lambda c: c.cast("string")
    user, kind = F.col("user_id"), F.col("event_type")
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1)
    note = F.when(user % 4 == 0, "1.5").when(user % 4 == 1, "n/a").when(user % 4 == 2, text(F.col("event_id") % 10))
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    attributes = F.concat(
        F.lit('[{"key":"k","value":{"intValue":"'), k, F.lit('"}}'), F.when(note.isNotNull(), F.concat(F.lit(',{"key":"note","value":{"stringValue":"'), note, F.lit('"}}'))).otherwise(""), F.lit(',{"key":"kind","value":{"stringValue":"'), kind, F.lit('"}}]')
    )
    return e.select(
        "event_id",
        "user_id",
        F.concat(F.lit("t"), text(user % 2)).alias("tenant_id"),
        at.alias("time_unix_nano"),
        F.when(F.col("event_id") % 5 > 0, at).alias("effective_time_unix_nano"),
        F.when(kind == "error", 17).when(kind == "purchase", 13).when(kind == "signup", 9).when(kind == "click", 5).otherwise(0).alias("severity_number"),
        kind.alias("event_name"),
        F.when(user % 7 != 0, F.concat(F.lit("lib."), kind)).alias("scope_name"),
        F.concat(F.lit("svc-"), text(user % 5)).alias("service"),
        F.concat(F.lit('[{"key":"service.name","value":{"stringValue":"svc-'), text(user % 5), F.lit('"}}]')).alias("resource_attributes"),
        attributes.alias("attributes"),
        k.cast("long").alias("attr__k"),
        F.col("value").alias("attr__value"),
        note.alias("attr__note"),
        F.md5(F.concat(text(user), F.lit("-"), F.expr("cast(event_id div 8 as string)")).cast("binary")).alias("trace_id"),
        (F.col("event_id") % 50 + 1).alias("template_id"),
        F.lit(1).alias("template_version"),
        F.lit(False).alias("lossy_flag"),
        (F.col("event_id") % 11 / F.lit(10.0)).cast("float").alias("confidence"),
        (F.col("event_id") % 4).alias("flags"),
        F.lit(0).alias("body_kind"),
        F.array(F.struct(F.lit(2).alias("type_tag"), text(user).cast("binary").alias("value"))).alias("params"),
        F.array(F.lit("").cast("binary"), F.lit(" ").cast("binary")).alias("separators"),
        F.concat(F.lit("user "), text(user), F.lit(" "), kind, F.lit(" cents "), text(F.round(F.col("value") * 100).cast("long"))).alias("body"),
    )


#: An audit stream made of events: what changed templates, and what is no drift.
AUDIT_SQL = """audit as (select 't' || (user_id % 2) as tenant_id, epoch_us(ts) * 1000 as "timestamp", event_id,
 case event_type when 'error' then 'template_widened' when 'click' then 'template_type_expanded' when 'signup' then 'template_created' when 'view' then 'template_widening_rejected_degenerate' else 'compaction' end as event_type,
 user_id % 40 as template_id, cast(event_id % 6 + 1 as integer) as old_version, cast(event_id % 6 + 2 as integer) as new_version, 'user <*> ' || event_type || ' v' || (event_id % 6 + 2) as new_template from events)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    names = F.when(kind == "error", "template_widened").when(kind == "click", "template_type_expanded").when(kind == "signup", "template_created").when(kind == "view", "template_widening_rejected_degenerate").otherwise("compaction")
    numbers = F.when(kind == "error", 0).when(kind == "click", 1).when(kind == "signup", 6).when(kind == "view", 2).otherwise(3)
    old = (F.col("event_id") % 6 + 1).cast("int")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 2).cast("string")).alias("tenant_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"),
        numbers.alias("event_kind"),
        names.alias("event_type"),
        (F.col("user_id") % 40).alias("template_id"),
        old.alias("old_version"),
        (old + 1).alias("new_version"),
        F.concat(F.lit("user <*> "), kind, F.lit(" v"), (old + 1).cast("string")).alias("new_template"),
    )
