"""What a server answers: statements as text or JSON over a store, and the tools of an agent."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from loglattice.operators import audit as A
from loglattice.operators import template_map
from loglattice.operators.query import Logs
from loglattice.operators.rows import log_rows, row_json
from loglattice.operators.stats import scan_stats
from loglattice.operators.visibility import Forbidden, Visibility
from loglattice.plans.compile import MOST_ROWS, Promoted, body_texts, row_limit, template_ids, validate
from loglattice.plans.ir import Aggregate, Drift, Limit, Query, QueryError
from loglattice.plans.structured import JSON_SCHEMA, parse_json
from loglattice.plans.text import parse
from loglattice.sources.store import LogStore, tenant_id

TOOL_ROWS = 100
#: The language in brief, for agents.
GRAMMAR = """statement  = predicate { "|" stage } | "drift from" time "to" time
predicate  = "true" | "false" | "severity" op level | field op literal | call | "not" predicate | predicate ("and" | "or") predicate | "(" predicate ")"
call       = ("matches" | "contains" | "starts_with" | "ends_with") "(" field "," text ")" | "resolves_to(" number ")"
field      = "body" | "ts" | "observed_ts" | "trace_id" | "span_id" | "scope" | "event_name" | "flags" | "service" | "template_id" | "confidence" | "lossy" | "attr." key | "resource." key
op         = "==" | "!=" | "<" | "<=" | ">" | ">=" | "=~" | "!~"
stage      = "range(" time "," time ")" | "limit" number | ("count" | ("sum" | "min" | "max" | "avg") "(" field ")") [ "by" term { "," term } ]
term       = field | "param(" number ")" | "bucket(" duration ")"
time       = "now" | ["-"] duration | RFC 3339 time;  duration = number ("s" | "m" | "h" | "d" | "w")"""
COSTS = {"window": "hours outside of range() are not listed; without one the last hour is read", "template_id": "equality prunes row groups", "trace_id": "equality is answered by bloom filters", "body": "contains and =~ read the column; == also matches templates", "attributes": "promoted ones have columns, others are searched as text"}


@dataclass
class Engine:
    """One store, its promoted attributes, and which tenants each token may read (None: all)."""

    store: LogStore
    promoted: dict[tuple[str, str], Promoted] = field(default_factory=dict)
    tokens: dict[str, frozenset[str]] | None = None
    most_rows: int = MOST_ROWS

    def admitted(self, tenant: str, token: str | None) -> str:
        """The tenant, if the token may read it: an unknown token is refused before anything is said of the tenant."""
        if self.tokens is not None and token not in self.tokens:
            raise PermissionError("unauthenticated")
        if not tenant:
            raise QueryError("a tenant is needed")
        try:
            tenant_id(tenant)
        except ValueError as e:
            raise QueryError(str(e)) from e
        if self.tokens is not None and tenant not in self.tokens[token]:
            raise Forbidden("tenant")
        return tenant

    def logs(self, tenant: str, query: Query, now: int, visibility: Visibility | None = None) -> tuple[Logs, template_map.TemplateMap, int]:
        """The tenant's records of the query's window, its template map where the query needs one, and how many files it has."""
        start, end = validate(query, now).window
        known, _ = template_map.load(self.store, tenant)
        kinds = {p.column: {"i64": "bigint", "f64": "double"}.get(p.kind, "string") for p in self.promoted.values()}
        df = self.store.scan(tenant, start, end, kinds=kinds) if start < end else self.store.scan(tenant, 0, 0)
        for c in ("effective_time_unix_nano", "time_unix_nano"):
            if c not in df.columns:
                df = df.selectExpr("*", f"cast(null as bigint) as {c}")
        classes = {n: A.resolver(known.classes)(n) for n in template_ids(query.predicate)}
        bodies = {t: known.bodies(t) for t in body_texts(query.predicate)}
        made = Logs(df, tenant, self.promoted, classes=classes.__getitem__, bodies=bodies.__getitem__, visibility=visibility)
        return made, known, sum(len(p.live) for p in self.store.partitions(tenant))

    def records(self, tenant: str, query: Query, now: int, visibility: Visibility | None = None) -> DataFrame:
        """Output rows of the records that match, in no order."""
        logs, known, _ = self.logs(tenant, query, now, visibility)
        return log_rows(logs.rows(query, now), known.registry(self.store))

    def answer(self, tenant: str, source: str | dict, now: int | None = None, visibility: Visibility | None = None, token: str | None = None) -> dict:
        """The answer to a statement, text or JSON: rows, groups or drift, with what was read. A bare count counts."""
        self.admitted(tenant, token)
        now = time.time_ns() if now is None else now
        statement = parse_json(source) if isinstance(source, dict) or source.lstrip().startswith("{") else parse(source)
        if isinstance(statement, Drift):
            return self.drift(tenant, statement, now, visibility)
        began = time.monotonic()
        checked = validate(statement, now)
        logs, known, files = self.logs(tenant, statement, now, visibility)
        if checked.aggregate is not None:
            got = logs.execute(statement, now)
            return {"kind": "groups", **got, "seconds": time.monotonic() - began}
        limit = min(row_limit(checked.limit), self.most_rows)
        rows = row_json(log_rows(logs.rows(statement, now), known.registry(self.store)))
        found = [json.loads(r.row) for r in rows.limit(limit).collect()] if not files else self.collected(rows.limit(limit))
        read = scan_stats(self.last, files) if files and self.last is not None else {"files_scanned": 0, "files_pruned": 0, "bytes_read": 0, "rows_read": 0}
        total = len(found) if len(found) < limit else logs.count(statement, now).first()["n"]
        return {"kind": "rows", "rows": total, "records": found, "stats": read, "seconds": time.monotonic() - began}

    last: DataFrame | None = None

    def collected(self, rows: DataFrame) -> list[dict]:
        self.last = rows
        return [json.loads(r.row) for r in rows.collect()]

    def drift(self, tenant: str, statement: Drift, now: int, visibility: Visibility | None = None) -> dict:
        if visibility:
            visibility.require_wide()
        start, end = sorted((statement.start.resolve(now), statement.end.resolve(now)))
        log = self.store.scan_audit(tenant, start, end, schema=A.AUDIT_SCHEMA.replace("\n", " "))
        return {"kind": "drift", "templates": [r.asDict() for r in A.drift(log, tenant, start, end).collect()]}

    # tools of an agent

    def query_logs(self, tenant: str, query: str, limit: int = TOOL_ROWS, **more) -> dict:
        """Rows or groups; `limit` is a cap that no stage of the query exceeds."""
        statement = parse(query)
        if isinstance(statement, Drift):
            raise QueryError("drift is a tool of its own")
        limits = [s.n for s in statement.stages if isinstance(s, Limit)]
        if not any(isinstance(s, Aggregate) for s in statement.stages):
            statement = replace(statement, stages=(*statement.stages, Limit(min([limit, self.most_rows, *limits[-1:]]))))
        from loglattice.plans.text import written

        return self.answer(tenant, written(statement), **more)

    def list_templates(self, tenant: str, visibility: Visibility | None = None, token: str | None = None) -> dict:
        self.admitted(tenant, token)
        if visibility:
            visibility.require_wide()
        known, how = template_map.load(self.store, tenant)
        return {"kind": "templates", "map": how, "templates": [{"template_id": i, "version": v, "template": t} for (i, v), t in sorted(known.templates.items())]}

    def template_drift(self, tenant: str, start: str, end: str, **more) -> dict:
        return self.answer(tenant, f"drift from {start} to {end}", **more)

    def resources(self) -> dict:
        """What an agent may read before it asks."""
        return {"grammar": GRAMMAR, "schema": JSON_SCHEMA, "costs": COSTS}
