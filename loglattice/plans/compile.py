"""From query tree to Column expressions: checks that need no data, then lowering against a table's columns."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.plans.ir import (
    FIELDS, SEVERITIES, TEXT_FIELDS, Aggregate, And, Bucket, Call, Compare, Const, Limit, Not, Or, Param, Path, Project, Query, QueryError, Range, Render, ResolvesTo, Severity, Sort, Time, Timestamp, walk,
)
from loglattice.plans.text import timestamp

#: The window of a query that names none, and the limits of returned rows.
DEFAULT_WINDOW = 3600 * 10**9
DEFAULT_ROWS, MOST_ROWS = 1000, 10_000
#: What the other regular expression dialects of this language lack.
_foreign = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<")
_number = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Promoted:
    """An attribute that has a column of its own; kind: string, i64 or f64."""

    column: str
    kind: str = "string"


@dataclass(frozen=True)
class Table:
    """What the compiler knows of a table: its columns, and its promoted attributes by (resource|attr, key)."""

    types: dict[str, T.DataType]
    promoted: dict[tuple[str, str], Promoted] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, promoted: dict[tuple[str, str], Promoted]) -> Table:
        types = {f.name: f.dataType for f in df.schema.fields}
        return cls(types, {k: p for k, p in promoted.items() if p.column in types})

    def attribute(self, path: Path) -> Path:
        return Path("resource", "service.name") if path == Path("service") else path


@dataclass(frozen=True)
class Checked:
    window: tuple[int, int]
    limit: int | None
    aggregate: Aggregate | None


def validate(query: Query, now: int, window: int = DEFAULT_WINDOW) -> Checked:
    """Everything that can be refused before any file is listed."""
    aggregates = [s for s in query.stages if isinstance(s, Aggregate)]
    for s in query.stages:
        if isinstance(s, Sort | Project | Render):
            raise QueryError(f"{type(s).__name__.lower()} can't be executed")
    if len(aggregates) > 1:
        raise QueryError("only one aggregation is possible")
    limits = [s.n for s in query.stages if isinstance(s, Limit)]
    aggregate = aggregates[0] if aggregates else None
    if aggregate and limits:
        raise QueryError("limit can't follow an aggregation")
    if aggregate:
        check_terms(aggregate, query.predicate)
    ranges = [s for s in query.stages if isinstance(s, Range)]
    last = ranges[-1] if ranges else Range(Time("offset", -window), Time("now"))
    bounds = sorted((last.start.resolve(now), last.end.resolve(now)))
    return Checked((bounds[0], bounds[1]), limits[-1] if limits else None, aggregate)


def check_terms(aggregate: Aggregate, predicate: object) -> None:
    if aggregate.path is not None and not (aggregate.path.is_attribute or aggregate.path == Path("service")):
        raise QueryError(f"{aggregate.function} takes an attribute")
    if len(set(aggregate.by)) < len(aggregate.by):
        raise QueryError("a group term stands twice")
    buckets = [t for t in aggregate.by if isinstance(t, Bucket)]
    if len(buckets) > 1:
        raise QueryError("only one bucket is possible")
    if buckets and not 0 < buckets[0].width.ns < 1 << 63:
        raise QueryError("a bucket needs a width above zero that fits into 64 bits")
    if any(isinstance(t, Param) for t in aggregate.by) and not pinned(predicate):
        raise QueryError("param() needs one template_id in the predicate")


def pinned(predicate: object) -> bool:
    """Whether the top conjunction demands one template."""
    parts = predicate.children if isinstance(predicate, And) else (predicate,)
    return len({p.value for p in parts if isinstance(p, Compare) and p.path == Path("template_id") and p.op == "=="}) == 1


def row_limit(limit: int | None) -> int:
    """What a server returns: its default without a limit, never more than its most."""
    return min(DEFAULT_ROWS if limit is None else limit, MOST_ROWS)


def compared(column: Column, op: str, value: Column) -> Column:
    match op:
        case "==":
            return column == value
        case "!=":
            return column != value
        case "<":
            return column < value
        case "<=":
            return column <= value
        case ">":
            return column > value
    return column >= value


def severity_column(node: Severity) -> Column:
    """Names are bands of four for == and !=, and a band's floor in an order. Unspecified severity passes floors."""
    column, op = F.col("severity_number"), node.op
    floor = SEVERITIES[node.level] if isinstance(node.level, str) else node.level
    if op in ("==", "!=") and isinstance(node.level, str):
        band = column.between(floor, floor + 3)
        return band if op == "==" else ~band
    plain = compared(column, op, F.lit(floor))
    if op in (">", ">="):
        return plain | (column == 0)
    return plain & (column != 0) if op in ("<", "<=") else plain


def hex_literal(value: object, digits: int) -> str:
    if not (isinstance(value, str) and len(value) == digits and re.fullmatch(r"[0-9A-Fa-f]+", value)):
        raise QueryError(f"{digits} hexadecimal digits expected")
    return value.lower()


def regex_literal(text: str) -> str:
    if _foreign.search(text):
        raise QueryError("look-around and back-references aren't supported")
    return text


def fragment(key: str, tag: str, value: str | None = None) -> str:
    """Part of canonical attribute text: a key with a kind of value, and the value if given."""
    head = '{"key":' + json.dumps(key, ensure_ascii=False) + ',"value":{"' + tag + '":'
    return head + (json.dumps(value, ensure_ascii=False) + "}}" if value is not None else "")


class Compiler:
    """Lowers predicates and group terms against one table. `classes` gives the alias class of a template id, `bodies`
    the (template_id, version, params, separators) that render to a body text."""

    def __init__(self, table: Table, classes=None, bodies=None):
        self.table = table
        self.classes = classes or (lambda n: {n})
        self.bodies = bodies or (lambda text: [])

    def column(self, name: str) -> Column | None:
        return F.col(f"`{name}`") if name in self.table.types else None

    def predicate(self, node: object) -> Column | bool:
        """A condition, or a constant where the predicate is one: then no file need be read."""
        match node:
            case Const():
                return node.value
            case Not():
                inner = self.predicate(node.child)
                return not inner if isinstance(inner, bool) else ~inner
            case And() | Or():
                absorbing, op = (False, and_) if isinstance(node, And) else (True, or_)
                parts = [self.predicate(c) for c in node.children]
                if any(p is absorbing for p in parts):
                    return absorbing
                live = [p for p in parts if not isinstance(p, bool)]
                return reduce(op, live) if live else not absorbing
            case Severity():
                return severity_column(node)
            case ResolvesTo():
                return F.col("template_id").isin(*sorted(self.classes(node.template)))
            case Call():
                return self.call(node)
            case Compare():
                return self.compare(node)
        raise QueryError(f"no predicate: {node}")

    def call(self, node: Call) -> Column:
        if node.path.is_attribute or node.path.name not in TEXT_FIELDS:
            raise QueryError(f"{node.name}() isn't possible for {node.path.name}")
        column = self.column(FIELDS[node.path.name])
        if column is None:
            return F.lit(False)
        text = column.cast("string")
        match node.name:
            case "matches":
                return text.rlike(regex_literal(node.text))
            case "contains":
                return text.contains(node.text)
            case "starts_with":
                return text.startswith(node.text)
        return text.endswith(node.text)

    def compare(self, node: Compare) -> Column:
        path = self.table.attribute(node.path)
        if path.is_attribute:
            return self.attribute(path, node.op, node.value)
        name, column = path.name, self.column(FIELDS[path.name])
        if node.op in ("=~", "!~"):
            if name not in TEXT_FIELDS or not isinstance(node.value, str):
                raise QueryError(f"{name} has no patterns")
            regex_literal(node.value)
        if name == "body" and node.op in ("==", "!=") and isinstance(node.value, str):
            return self.body(node.op, node.value)
        value = self.field_literal(name, node.value, column)
        if column is None:
            return F.lit(False)
        if node.op in ("=~", "!~"):
            hit = column.cast("string").rlike(node.value)
            return hit if node.op == "=~" else ~hit
        return compared(column.cast("string") if name in TEXT_FIELDS else column, node.op, value)

    def field_literal(self, name: str, value: object, column: Column | None) -> Column:
        number = isinstance(value, int) and not isinstance(value, bool)
        if name in ("ts", "observed_ts"):
            if isinstance(value, Timestamp):
                return F.lit(value.ns).cast("long")
            if number and value >= 0:
                return F.lit(value).cast("long")
            if isinstance(value, str):
                return F.lit(timestamp(value)).cast("long")
        elif name in ("trace_id", "span_id"):
            digits = hex_literal(value, 32 if name == "trace_id" else 16)
            binary = column is not None and isinstance(self.table.types[FIELDS[name]], T.BinaryType)
            return F.unhex(F.lit(digits)) if binary else F.lit(digits)
        elif name == "template_id" and number and 0 <= value < 1 << 63:
            return F.lit(value).cast("long")
        elif name == "confidence" and (number or isinstance(value, float)):
            return F.lit(float(struct.unpack("f", struct.pack("f", value))[0])).cast("float")
        elif name == "lossy" and isinstance(value, bool):
            return F.lit(value)
        elif name == "flags" and number and 0 <= value < 1 << 32:
            return F.lit(value).cast("long")
        elif name in TEXT_FIELDS and isinstance(value, str):
            return F.lit(value)
        raise QueryError(f"{value!r} can't be compared with {name}")

    def attribute(self, path: Path, op: str, value: object) -> Column:
        promoted = self.table.promoted.get((path.name, path.key))
        text = F.col("resource_attributes" if path.name == "resource" else "attributes")
        column = F.col(f"`{promoted.column}`") if promoted else None
        kind = promoted.kind if promoted else "string"
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if kind == "string":
            if not isinstance(value, str):
                raise QueryError(f"{path.key} is compared with text")
            literal, tag, shown = F.lit(value), "stringValue", value
        else:
            if op in ("=~", "!~") or not number or kind == "i64" and isinstance(value, float):
                raise QueryError(f"{path.key} is compared with {'whole ' if kind == 'i64' else ''}numbers")
            literal, tag, shown = F.lit(value).cast("long" if kind == "i64" else "double"), "intValue", str(value)
        if op not in ("==", "!="):
            if column is None:
                raise QueryError(f"{path.key} has no column of its own: only == and != are possible")
            if op in ("=~", "!~"):
                hit = column.rlike(regex_literal(value))
                return hit if op == "=~" else ~hit
            return compared(column, op, literal)
        if kind == "f64":
            return compared(column, op, literal)
        here, present = text.contains(fragment(path.key, tag, shown)), text.contains(fragment(path.key, tag))
        if column is None:
            return here if op == "==" else present & ~here
        if op == "==":
            return (column == literal) | (column.isNull() & here)
        return (column.isNotNull() & (column != literal)) | (column.isNull() & present & ~here)

    def body(self, op: str, text: str) -> Column:
        """Stored bodies, or bodies that a template and its parameters render to."""
        stored = self.column("body")
        if stored is None:
            return F.lit(False)
        kind = self.column("body_kind")
        raw = F.lit(text) if isinstance(self.table.types["body"], T.StringType) else F.lit(text).cast("binary")
        plain = (kind == 0) if kind is not None else F.lit(True)
        arms = [plain & (stored == raw)] + [self.candidate(*c) for c in self.bodies(text)]
        hit = F.coalesce(reduce(or_, arms), F.lit(False))
        return hit if op == "==" else plain & ~hit

    def candidate(self, template: int, version: int, params: list[bytes], separators: list[bytes]) -> Column:
        """One template's version whose parameters and white space spell the text."""
        parts = [F.col("template_id") == template, F.col("template_version") == version, F.col("body").isNull(), ~F.col("lossy_flag"), F.size("params") == len(params), F.size("separators") == len(separators)]
        parts += [F.get("params", F.lit(i))["value"] == F.lit(bytearray(p)) for i, p in enumerate(params)]
        parts += [F.get("separators", F.lit(i)) == F.lit(bytearray(s)) for i, s in enumerate(separators)]
        return reduce(and_, parts)

    def term(self, term: object) -> Column:
        """A group key as text; NULL where a record has none."""
        if isinstance(term, Bucket):
            start = F.expr(f"coalesce(effective_time_unix_nano, time_unix_nano) div {term.width.ns}L").cast("long") * F.lit(term.width.ns).cast("long")
            return rfc3339(start)
        if isinstance(term, Param):
            return F.get("params", F.lit(term.slot))["value"].cast("string")
        path = self.table.attribute(term)
        if path.is_attribute:
            promoted = self.table.promoted.get((path.name, path.key))
            if promoted is None:
                raise QueryError(f"{path.key} has no column of its own; promote it to group by it")
            return F.col(f"`{promoted.column}`").cast("string")
        column = self.column(FIELDS[path.name])
        if column is None:
            return F.lit(None).cast("string")
        if path.name in ("ts", "observed_ts"):
            return rfc3339(column)
        return F.lower(F.hex(column)) if path.name in ("trace_id", "span_id") and isinstance(self.table.types[FIELDS[path.name]], T.BinaryType) else column.cast("string")

    def scalar(self, aggregate: Aggregate) -> Column:
        """The number that is aggregated; NULL where a record has none."""
        path = self.table.attribute(aggregate.path)
        promoted = self.table.promoted.get((path.name, path.key))
        if promoted is None:
            raise QueryError(f"{path.key} has no column of its own; promote it to aggregate it")
        column = F.col(f"`{promoted.column}`")
        if promoted.kind == "string":  # Spark's cast takes padded and suffixed numbers too
            return F.when(column.rlike(_number), column.try_cast("double"))
        return column.cast("double")


def rfc3339(ns: Column) -> Column:
    """UTC time of nanoseconds since 1970, with 0, 3, 6 or 9 digits of the second as needed. Whole numbers only: the session's
    time zone plays no part."""
    long = lambda n: F.lit(n).cast("long")
    rest, second = F.pmod(ns, long(10**9)), F.pmod(ns, long(86_400 * 10**9)) / long(10**9)
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((ns - F.pmod(ns, long(86_400 * 10**9))) / long(86_400 * 10**9)).cast("int")).cast("string")
    second = F.floor(second)
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    whole = F.concat(day, F.lit("T"), two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60))
    digits = F.lpad(rest.cast("string"), 9, "0")
    part = F.when(rest == 0, "").when(rest % 10**6 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3))).when(rest % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6))).otherwise(F.concat(F.lit("."), digits))
    return F.concat(whole, part, F.lit("Z"))


def in_window(start: int, end: int) -> Column:
    """Half-open over effective time; written as an OR, which Parquet's filters understand."""
    eff, at = F.col("effective_time_unix_nano"), F.col("time_unix_nano")
    return ((eff >= start) & (eff < end)) | (eff.isNull() & (at >= start) & (at < end))


def template_ids(predicate: object) -> Iterable[int]:
    return [n.template for n in walk(predicate) if isinstance(n, ResolvesTo)]


def body_texts(predicate: object) -> Iterable[str]:
    return [n.value for n in walk(predicate) if isinstance(n, Compare) and n.path == Path("body") and isinstance(n.value, str)]
