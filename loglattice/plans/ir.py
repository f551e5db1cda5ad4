"""The query tree that both front ends build."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """A query that can't be parsed, validated or compiled."""


@dataclass(frozen=True)
class Path:
    """A named field, or a key of the resource's or the record's attributes."""

    name: str  # field name, or "resource" / "attr"
    key: str | None = None

    @property
    def is_attribute(self) -> bool:
        return self.key is not None


@dataclass(frozen=True)
class Duration:
    ns: int
    text: str


@dataclass(frozen=True)
class Timestamp:
    ns: int
    text: str


@dataclass(frozen=True)
class Time:
    """now, a signed duration from now, or a timestamp."""

    kind: str  # now, offset, at
    ns: int = 0
    text: str = "now"

    def resolve(self, now: int) -> int:
        ns = now if self.kind == "now" else now + self.ns if self.kind == "offset" else self.ns
        return max(-(1 << 63), min((1 << 63) - 1, ns))


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Compare:
    path: Path
    op: str
    value: object  # str, int, float, bool, None, Duration, Timestamp


@dataclass(frozen=True)
class Severity:
    op: str
    level: int | str  # a number, or a name in lower case


@dataclass(frozen=True)
class Call:
    name: str  # matches, contains, starts_with, ends_with
    path: Path
    text: str


@dataclass(frozen=True)
class ResolvesTo:
    template: int


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class Param:
    slot: int


@dataclass(frozen=True)
class Bucket:
    width: Duration


@dataclass(frozen=True)
class Range:
    start: Time
    end: Time


@dataclass(frozen=True)
class Aggregate:
    function: str  # count, sum, min, max, avg
    path: Path | None = None
    by: tuple = ()


@dataclass(frozen=True)
class Sort:
    key: str
    descending: bool = False


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Project:
    fields: tuple


@dataclass(frozen=True)
class Render:
    pass


@dataclass(frozen=True)
class Query:
    predicate: object
    stages: tuple = field(default=())


@dataclass(frozen=True)
class Drift:
    start: Time
    end: Time


def joined(kind: type, children: list) -> object:
    """And or Or of the children, with nested ones of the same kind taken in; a single child stands for itself."""
    flat: list = []
    for c in children:
        flat += c.children if isinstance(c, kind) else [c]
    return flat[0] if len(flat) == 1 else kind(tuple(flat))


def walk(node: object):
    """All predicates of a tree, the node first."""
    yield node
    for c in node.children if isinstance(node, And | Or) else (node.child,) if isinstance(node, Not) else ():
        yield from walk(c)


#: Fields of a record by the name that queries use, with their column. Fixed values.
FIELDS = {
    "body": "body",
    "ts": "time_unix_nano",
    "observed_ts": "observed_time_unix_nano",
    "trace_id": "trace_id",
    "span_id": "span_id",
    "scope": "scope_name",
    "event_name": "event_name",
    "flags": "flags",
    "service": "service",
    "template_id": "template_id",
    "confidence": "confidence",
    "lossy": "lossy_flag",
    "severity": "severity_number",
}
TEXT_FIELDS = frozenset(("body", "scope", "event_name"))
#: First number of each severity's band of four. Fixed values.
SEVERITIES = {"trace": 1, "debug": 5, "info": 9, "warn": 13, "error": 17, "fatal": 21}
#: Nanoseconds of each unit of duration. Fixed values.
UNITS = {"s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}
CALLS = ("matches", "contains", "starts_with", "ends_with")
SCALARS = ("sum", "min", "max", "avg")
