"""What a principal may see of a tenant's records: all, all with content masked, or some conversations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.plans.ir import Aggregate, Call, Compare, Path, Query, QueryError, walk


class Forbidden(QueryError):
    """The query touches a column that the principal may not see."""


@dataclass(frozen=True)
class Visibility:
    """masked: content fields and attribute keys (resource|attr, key) whose values are hidden. scope: (column, ids) that
    are visible, and own: (column, id) of what is the principal's own."""

    masked: frozenset = frozenset()
    scope: tuple[str, tuple[str, ...]] | None = None
    own: tuple[str, str] | None = None

    def restrict(self, df: DataFrame) -> DataFrame:
        if self.scope is None:
            return df
        visible = F.col(self.scope[0]).isin(*self.scope[1]) if self.scope[1] else F.lit(False)
        return df.where(visible | (F.col(self.own[0]) == self.own[1]) if self.own else visible)

    def hides(self, path: Path) -> bool:
        return (path.name if not path.is_attribute else (path.name, path.key)) in self.masked

    def forbid(self, query: Query) -> None:
        used = [n.path for n in walk(query.predicate) if isinstance(n, Compare | Call)]
        for s in query.stages:
            if isinstance(s, Aggregate):
                used += [t for t in (s.path, *s.by) if isinstance(t, Path)]
                if "body" in self.masked and len([t for t in s.by if not isinstance(t, Path)]) and any(hasattr(t, "slot") for t in s.by):
                    raise Forbidden("param")
        for p in used:
            if self.hides(p):
                raise Forbidden(p.key or p.name)

    def mask(self, df: DataFrame) -> DataFrame:
        """Body, parameters and the masked attributes' values go; their keys stay."""
        if not self.masked:
            return df
        out = df
        if "body" in self.masked:
            for c in ("body", "params"):
                if c in df.columns:
                    out = out.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
        for scope, column in (("attr", "attributes"), ("resource", "resource_attributes")):
            keys = [m[1] for m in self.masked if isinstance(m, tuple) and m[0] == scope]
            if keys and column in df.columns:
                shape = "array<struct<key:string,value:map<string,string>>>"
                hidden = F.transform(F.from_json(column, shape), lambda a: F.struct(a["key"].alias("key"), F.when(~a["key"].isin(*keys), a["value"]).alias("value")))
                out = out.withColumn(column, F.to_json(hidden))
        return out

    def require_wide(self) -> None:
        """Drift and template listings need sight of the whole tenant."""
        if self.masked or self.scope is not None:
            raise Forbidden("tenant-wide read needed")
