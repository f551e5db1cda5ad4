"""Output rows: the fields of a record that a query returns, its rendered body, and its JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.templates import OVERFLOW, rebuilt, template_words

#: Fields of an output row with their types. Fixed values.
FIELDS = {
    "time_unix_nano": "bigint",
    "observed_time_unix_nano": "bigint",
    "severity_number": "int",
    "severity_text": "string",
    "trace_id": "string",
    "span_id": "string",
    "flags": "bigint",
    "event_name": "string",
    "scope_name": "string",
    "scope_version": "string",
    "scope_attributes": "string",
    "resource_schema_url": "string",
    "scope_schema_url": "string",
    "attributes": "string",
    "resource_attributes": "string",
    "dropped_attributes_count": "bigint",
    "template_id": "bigint",
    "template_version": "int",
}
STRING, STRUCTURED, ABSENT = 0, 1, 2
#: What a body is rendered from; null where a table lacks it.
NEEDED = {"template_id": "bigint", "template_version": "int", "body": "string", "lossy_flag": "boolean", "params": "array<struct<type_tag:int,value:binary>>", "separators": "array<binary>"}


def rendered(body: Column, kind: Column, lossy: Column, params: Column, separators: Column, template: Column) -> Column:
    """A record's body as struct<form, text, faithful>: null if it has none; a structured one as its JSON; a text that was kept
    or is rebuilt from its template. A text is faithful unless nothing of it is left to rebuild it from."""
    values = F.transform(params, lambda p: p["value"].cast("string"))
    spelled = rebuilt(template_words(template), values, F.transform(separators, lambda s: s.cast("string")))
    whole = ~F.coalesce(lossy, F.lit(False)) & ~F.exists(params, lambda p: p["type_tag"] == OVERFLOW)
    text = F.coalesce(body.cast("string"), F.when(whole, spelled))
    form = F.when(kind == STRUCTURED, "structured").when(body.isNotNull(), "retained").when(text.isNotNull(), "rebuilt").otherwise("lost")
    return F.when(F.coalesce(kind, F.lit(STRING)) != ABSENT, F.struct(form.alias("form"), text.alias("text"), text.isNotNull().alias("faithful")))


def log_rows(df: DataFrame, registry: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The output fields of df's records and their rendered `body`; columns that df lacks are null. The registry (template_id,
    version, template) of a tenant is bounded by its template ceiling, so it is sent to every task."""
    df = df.selectExpr("*", *(f"cast(null as {t}) as {c}" for c, t in NEEDED.items() if c not in df.columns))
    small = F.broadcast(registry.select(F.col("template_id").alias("_id"), F.col("version").alias("_version"), F.col("template").alias("_template")))
    joined = df.join(small, (F.col("template_id") == F.col("_id")) & (F.col("template_version") == F.col("_version")), "left")
    hexed = lambda c: F.lower(F.hex(c)) if isinstance(df.schema[c].dataType, T.BinaryType) else F.col(c)
    fields = [(hexed(c) if c in ("trace_id", "span_id") else F.col(c).cast(t)).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in FIELDS.items() if c not in keep]
    kind = F.col("body_kind") if "body_kind" in df.columns else F.lit(STRING)
    return joined.select(*keep, *fields, rendered(F.col("body"), kind, F.col("lossy_flag"), F.col("params"), F.col("separators"), F.col("_template")).alias("body"))


def row_json(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Output rows as JSON text: absent fields and bodies are left out, attributes are JSON themselves."""
    body = F.when(F.col("body").isNotNull(), F.struct(F.col("body.form").alias("form"), F.col("body.text").alias("text"), F.col("body.faithful").alias("faithful")))
    return rows.select(*keep, F.to_json(F.struct(*FIELDS, body.alias("body")), {"ignoreNullFields": "true"}).alias("row"))
