"""The template map of a tenant: text of each template's versions and alias classes, folded from the audit log and kept
beside it. A kept map counts only if it was folded from just the files that are live now."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from loglattice.functions.templates import unify
from loglattice.operators import audit as A
from loglattice.sources.store import LogStore

FORM = 1


@dataclass(frozen=True)
class TemplateMap:
    """A tenant has at most as many templates as the miner's ceiling, so a map fits on the driver."""

    tenant: str
    frontier: tuple[str, ...]
    templates: dict[tuple[int, int], str]
    classes: list[set[int]]

    def text(self) -> str:
        return json.dumps({"form": FORM, "tenant": self.tenant, "frontier": self.frontier, "templates": [[i, v, t] for (i, v), t in sorted(self.templates.items())], "classes": [sorted(c) for c in self.classes]})

    def bodies(self, text: str) -> list[tuple[int, int, list[bytes], list[bytes]]]:
        """(template, version, parameters, separators) of all versions that spell the text."""
        found = []
        for (i, v), template in self.templates.items():
            got = unify(text, template.split(" "))
            if got is not None:
                found.append((i, v, *got))
        return found

    def registry(self, store: LogStore) -> DataFrame:
        return store.spark.createDataFrame([(i, v, t) for (i, v), t in self.templates.items()], "template_id long, version int, template string")


def path(store: LogStore, tenant: str) -> str:
    return f"{store.tenant_path(tenant, 'maps')}"


def kept(store: LogStore, tenant: str) -> tuple[int, TemplateMap | None, str]:
    """Generation of the newest kept map, the map if it can be read, and why not: absent, torn or unknown."""
    files = sorted(p for p, _ in store.files.children(path(store, tenant))[1] if p.endswith(".json"))
    if not files:
        return 0, None, "absent"
    generation = int(files[-1].rsplit("-", 1)[1][:-5])
    try:
        got = json.loads(store.files.read(files[-1]))
        if got["form"] != FORM:
            return generation, None, "unknown"
        if got["tenant"] != tenant:
            raise PermissionError("a map of another tenant")
        return generation, TemplateMap(tenant, tuple(got["frontier"]), {(i, v): t for i, v, t in got["templates"]}, [set(c) for c in got["classes"]]), ""
    except (ValueError, KeyError, TypeError):
        return generation, None, "torn"


def folded(store: LogStore, tenant: str) -> TemplateMap:
    frontier = tuple(sorted(store.live_files(tenant, table="audit")))
    log = store.scan_audit(tenant, schema=", ".join(" ".join(A.AUDIT_SCHEMA.split()).split(", ")))
    templates = {(r.template_id, r.version): r.template for r in A.registry(log, tenant).toLocalIterator()}
    return TemplateMap(tenant, frontier, templates, A.aliases(log, tenant))


def load(store: LogStore, tenant: str) -> tuple[TemplateMap, str]:
    """The tenant's map and how it was come by: hit, stale, or miss with the reason. A map that was folded anew is kept for
    the next time; of two writers one wins, and the loser's map serves just as well."""
    generation, have, why = kept(store, tenant)
    if have is not None and have.frontier == tuple(sorted(store.live_files(tenant, table="audit"))):
        return have, "hit"
    fresh = folded(store, tenant)
    publish(store, fresh, generation)
    return fresh, "stale" if have is not None else f"miss: {why}"


def publish(store: LogStore, made: TemplateMap, generation: int) -> bool:
    """Keep a map as the next generation; False if another writer was first."""
    won = store.files.create(f"{path(store, made.tenant)}/map-{generation + 1:08d}.json", made.text())
    if won and generation:
        store.files.delete(f"{path(store, made.tenant)}/map-{generation:08d}.json")
    return won
