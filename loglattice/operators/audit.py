"""Folds over the audit stream: template registry, alias classes, drift."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Event names by number. Fixed values.
EVENTS = ["template_widened", "template_type_expanded", "template_widening_rejected_degenerate", "compaction", "alias_asserted", "alias_retracted", "template_created", "record_quarantined", "ingest_denied", "conversation_erased"]
DRIFT = ("template_widened", "template_type_expanded")
#: Columns beside those that every event has.
AUDIT_SCHEMA = """tenant_id string, timestamp long, event_kind int, event_type string, template_id long, old_version int, new_version int,
 old_template string, new_template string, positions_widened array<int>, slots_expanded array<struct<slot_index:int,types_added:array<int>>>,
 triggering_line_hash binary, triggering_line_sample string, reason string, files_in int, files_out int, partition string,
 alias_ids array<long>, actor string, quarantined int, denied_tenant string, conversation_id string, rows_erased long"""
REASON_BYTES = 256


def drift(audit: DataFrame, tenant: str, start: int, end: int) -> DataFrame:
    """template_id, widening_count, from_version, to_version, first_at, last_at of the templates that changed in the
    half-open window, most changes first. Creation is no change; reversed bounds are swapped."""
    start, end = sorted((start, end))
    changes = audit.where((F.col("tenant_id") == tenant) & F.col("event_type").isin(*DRIFT) & (F.col("timestamp") >= start) & (F.col("timestamp") < end))
    return (
        changes.groupBy("template_id")
        .agg(F.count(F.lit(1)).alias("widening_count"), F.min("old_version").alias("from_version"), F.max("new_version").alias("to_version"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
        .orderBy(F.desc("widening_count"), "template_id")
    )


def registry(audit: DataFrame, tenant: str) -> DataFrame:
    """template_id, version, template: the text of each version. Creation is version 1; of several events for a version
    the last by time counts. Rejected widenings add nothing."""
    made = audit.where((F.col("tenant_id") == tenant) & F.col("event_type").isin("template_created", *DRIFT))
    version = F.when(F.col("event_type") == "template_created", F.lit(1)).otherwise(F.col("new_version"))
    return made.groupBy("template_id", version.alias("version")).agg(F.max_by("new_template", F.struct("timestamp", "event_kind")).alias("template"))


def list_templates(audit: DataFrame, tenant: str) -> DataFrame:
    return registry(audit, tenant).orderBy("template_id", "version")


def alias_classes(events: Iterable[tuple[str, list[int]]]) -> list[set[int]]:
    """Disjoint classes from (event_type, ids) in order: an assertion unites all classes it touches, a retraction takes
    its ids out, and a class of fewer than two dissolves."""
    classes: list[set[int]] = []
    for kind, ids in events:
        named = set(ids)
        if kind == "alias_asserted" and len(named) > 1:
            touched = [c for c in classes if c & named]
            classes = [c for c in classes if not c & named] + [named.union(*touched)]
        elif kind == "alias_retracted":
            classes = [c for c in (c - named for c in classes) if len(c) > 1]
    return classes


def aliases(audit: DataFrame, tenant: str) -> list[set[int]]:
    """Operators assert aliases by hand: their events are few, and order decides what they mean: that of the log (file and
    row, where the audit table has them), then of time, then of kind and ids."""
    order = [c for c in ("file", "row", "timestamp", "event_kind", "alias_ids") if c in audit.columns]
    events = audit.where((F.col("tenant_id") == tenant) & F.col("event_type").isin("alias_asserted", "alias_retracted")).orderBy(*order).select("event_type", "alias_ids")
    return alias_classes((r[0], r[1] or []) for r in events.toLocalIterator())


def resolver(classes: list[set[int]]):
    """The alias class of an id; itself where it has none."""
    by = {i: c for c in classes for i in c}
    return lambda n: by.get(n, {n})


def alias_event(tenant: str, ids: list[int], actor: str, reason: str, at: int, retract: bool = False) -> dict:
    """An audit row; refused without an actor, with fewer than two ids to unite, or with a long reason."""
    if not actor or len(set(ids)) < (1 if retract else 2) or len(reason.encode()) > REASON_BYTES:
        raise ValueError("an alias needs an actor, two ids and a reason of at most 256 bytes")
    kind = 5 if retract else 4
    return {"tenant_id": tenant, "timestamp": at, "event_kind": kind, "event_type": EVENTS[kind], "alias_ids": sorted(set(ids)), "actor": actor, "reason": reason}
