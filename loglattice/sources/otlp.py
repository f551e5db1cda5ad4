"""OTLP JSON export requests to flat log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_value = "STRING"
_attrs = "ARRAY<STRUCT<key: STRING, value: STRING>>"
_record = f"STRUCT<timeUnixNano: STRING, observedTimeUnixNano: STRING, severityNumber: INT, severityText: STRING, body: {_value}, attributes: {_attrs}, droppedAttributesCount: BIGINT, flags: BIGINT, traceId: STRING, spanId: STRING, eventName: STRING>"
_scope = f"STRUCT<name: STRING, version: STRING, attributes: {_attrs}>"
#: An export request; attribute values and bodies stay JSON text.
REQUEST = f"STRUCT<resourceLogs: ARRAY<STRUCT<resource: STRUCT<attributes: {_attrs}>, schemaUrl: STRING, scopeLogs: ARRAY<STRUCT<scope: {_scope}, schemaUrl: STRING, logRecords: ARRAY<{_record}>>>>>>"


def canonical(attributes: Column) -> Column:
    """Attribute list as canonical JSON text: [] where empty, key before value."""
    one = lambda a: F.concat(F.lit('{"key":'), F.to_json(F.array(a["key"])).substr(F.lit(2), F.length(F.to_json(F.array(a["key"]))) - 2), F.lit(',"value":'), F.coalesce(a["value"], F.lit("{}")), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(attributes, F.array().cast(_attrs)), one), ","), F.lit("]"))


def identifier(text: Column, size: int) -> Column:
    """Bytes of a hexadecimal id; null unless it has the right length."""
    return F.when((F.length(text) == 2 * size) & text.rlike("^[0-9a-fA-F]+$"), F.unhex(text))


def nanos(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0))


def flatten(requests: DataFrame, tenant: str, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per log record of JSON requests; with `keep`, those columns of the request and the record's `position` in it. Wrong-length ids are null, severities beyond 0..255 are 0, an event
    name is taken from the attribute event.name where the field is empty. Broken JSON gives no rows."""
    parsed = requests.select(*keep, F.from_json(F.col(column), REQUEST).alias("r"))
    # positions multiply: a request has fewer than 1000 resources and scopes each where its order matters
    r = parsed.select(*keep, F.posexplode("r.resourceLogs").alias("p1", "rl")).select(*keep, "p1", "rl", F.posexplode("rl.scopeLogs").alias("p2", "sl")).select(*keep, "p1", "p2", "rl", "sl", F.posexplode("sl.logRecords").alias("p3", "x"))
    place = [*keep, ((F.col("p1") * 1000 + F.col("p2")).cast("long") * 1_000_000 + F.col("p3")).alias("position")] if keep else []
    x, named = F.col("x"), F.filter(F.col("x.attributes"), lambda a: a["key"] == "event.name")
    from_attribute = F.get_json_object(F.get(named, F.lit(0))["value"], "$.stringValue")
    text = F.get_json_object(x["body"], "$.stringValue")
    at, seen = nanos(x["timeUnixNano"]), x["observedTimeUnixNano"].try_cast("long")
    return r.select(
        *place,
        F.lit(tenant).alias("tenant_id"),
        at.alias("time_unix_nano"),
        seen.alias("observed_time_unix_nano"),
        F.when(at > 0, at).otherwise(F.coalesce(seen, F.lit(0))).alias("effective_time_unix_nano"),
        F.when(x["severityNumber"].between(0, 255), x["severityNumber"]).otherwise(0).cast("short").alias("severity_number"),
        F.nullif(x["severityText"], F.lit("")).alias("severity_text"),
        F.nullif(F.col("sl.scope.name"), F.lit("")).alias("scope_name"),
        F.nullif(F.col("sl.scope.version"), F.lit("")).alias("scope_version"),
        canonical(x["attributes"]).alias("attributes"),
        F.coalesce(x["droppedAttributesCount"], F.lit(0)).alias("dropped_attributes_count"),
        canonical(F.col("rl.resource.attributes")).alias("resource_attributes"),
        identifier(x["traceId"], 16).alias("trace_id"),
        identifier(x["spanId"], 8).alias("span_id"),
        F.coalesce(x["flags"], F.lit(0)).alias("flags"),
        F.coalesce(F.nullif(x["eventName"], F.lit("")), F.nullif(from_attribute, F.lit(""))).alias("event_name"),
        F.when(x["body"].isNull() | (x["body"] == "{}") | (x["body"] == "null"), 2).when(text.isNotNull(), 0).otherwise(1).cast("byte").alias("body_kind"),
        F.when((x["body"] == "{}") | (x["body"] == "null"), None).otherwise(F.coalesce(text, x["body"])).alias("body"),
        F.when(F.size("sl.scope.attributes") > 0, canonical(F.col("sl.scope.attributes"))).alias("scope_attributes"),
        F.nullif(F.col("rl.schemaUrl"), F.lit("")).alias("resource_schema_url"),
        F.nullif(F.col("sl.schemaUrl"), F.lit("")).alias("scope_schema_url"),
    )


def promoted(attributes: Column, key: str, kind: str = "string") -> Column:
    """A query column of an attribute: its first occurrence, null where its value is of another kind."""
    first = F.get(F.filter(F.from_json(attributes, _attrs), lambda a: a["key"] == key), F.lit(0))["value"]
    whole = F.get_json_object(first, "$.intValue").try_cast("long")
    if kind == "string":
        return F.get_json_object(first, "$.stringValue")
    return whole if kind == "i64" else F.coalesce(F.get_json_object(first, "$.doubleValue").try_cast("double"), whole.cast("double"))
