"""The template miner: lines to templates and parameters, one state machine per shard.

A line is only ever compared with templates of as many words, the same severity and scope, and the same route: its first
masked words, where a node of the routing tree that is full sends new words to a wildcard. Which words a node has room for
is told by their first lines, which Spark finds beforehand; so shards of (tenant, words, route, severity, scope) mine
independently and in parallel, each streaming its lines in order. A template's id carries its shard: it depends on no other
shard's lines. The ceiling of templates holds for each shard.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.templates import OVERFLOW, STR, WILDCARD, NulError, masked, rebuilt, sample, split_line, template_words, tokens, word_kind


@dataclass(frozen=True)
class Tunables:
    """Thresholds and limits, with the ranges they may have."""

    threshold: float = 0.7
    floor: float = 0.4
    depth: int = 2
    param_bytes: int = 256
    children: int = 100
    templates: int = 20_000
    words: int = 512

    def __post_init__(self):
        if not (0 < self.threshold <= 1 and 0 < self.floor <= self.threshold and 0 <= self.depth <= 8 and 1 <= self.param_bytes <= 1024 and self.children > 0 and self.templates > 0 and self.words > 0):
            raise ValueError(f"out of range: {self}")


@dataclass
class Leaf:
    """A template: None stands for a wildcard; kinds has the kinds each wildcard has seen."""

    words: list[str | None]
    id: int
    severity: int
    scope: str
    version: int = 1
    kinds: dict[int, set[int]] = field(default_factory=dict)

    @property
    def text(self) -> str:
        return " ".join(WILDCARD if w is None else w for w in self.words)


@dataclass
class Line:
    """What mining makes of a line."""

    template_id: int = 0
    template_version: int = 0
    params: list[tuple[int, bytes]] = field(default_factory=list)
    separators: list[bytes] = field(default_factory=list)
    confidence: float = 0.0
    lossy: bool = False
    body: str | None = None
    failure: str | None = None


class Shard:
    """Templates of one shard. ids are (shard number << 22) + a running number."""

    def __init__(self, number: int, tunables: Tunables | None = None):
        self.number, self.tunables = number, tunables or Tunables()
        self.routes: dict[tuple, list[Leaf]] = {}
        self.fanout: dict[tuple, set] = {}
        self.made = 0
        self.structured: dict[tuple, int] = {}

    def snapshot(self) -> str:
        """The state as JSON; `restored` takes it up again."""
        leaves = [[list(at), [[x.words, x.id, x.severity, x.scope, x.version, sorted((i, sorted(k)) for i, k in x.kinds.items())] for x in xs]] for at, xs in self.routes.items()]
        return json.dumps({"form": 1, "number": self.number, "made": self.made, "routes": leaves, "fanout": [[list(at), sorted(w for w in ws if w is not None), None in ws] for at, ws in self.fanout.items()], "structured": [[*k, v] for k, v in self.structured.items()]})

    @classmethod
    def restored(cls, text: str, tunables: Tunables | None = None) -> Shard:
        got = json.loads(text)
        if got.get("form") != 1:
            raise ValueError("a snapshot of another form")
        out = cls(got["number"], tunables)
        out.made = got["made"]
        out.routes = {tuple(at): [Leaf(w, i, s, c, v, {p: set(k) for p, k in kinds}) for w, i, s, c, v, kinds in xs] for at, xs in got["routes"]}
        out.fanout = {tuple(at): {*ws, *([None] if wild else [])} for at, ws, wild in got["fanout"]}
        out.structured = {tuple(k): v for *k, v in got["structured"]}
        return out

    def new_id(self) -> int:
        self.made += 1
        return (self.number << 22) + self.made

    def route(self, masked: list[str | None]) -> tuple:
        """The leaf list a line belongs to: its first words, where a node that is full sends new words to a wildcard."""
        at: tuple = ()
        for w in masked[: self.tunables.depth]:
            known = self.fanout.setdefault(at, set())
            if w not in known:
                if len(known) >= self.tunables.children and w is not None:
                    w = None
                known.add(w)
            at = (*at, w)
        return at

    def best(self, leaves: list[Leaf], masked: list[str | None], severity: int, scope: str) -> tuple[Leaf | None, np.float32]:
        best, top = None, np.float32(-1)
        for leaf in leaves:
            if (leaf.severity, leaf.scope) == (severity, scope):
                same = sum(a is None or a == b for a, b in zip(leaf.words, masked, strict=True))
                score = np.float32(same) / np.float32(len(masked))
                if score > top:
                    best, top = leaf, score
        return best, top

    def structured_body(self, severity: int, scope: str, event: str, body: str) -> Line:
        """A body that isn't text: one template per kind of record, its body kept."""
        key = (severity, scope, event)
        if key not in self.structured:
            self.structured[key] = self.new_id()
        return Line(self.structured[key], 1, confidence=1.0, body=body)

    def text(self, raw: str, severity: int, scope: str) -> tuple[Line, list[dict]]:
        """A line's outcome, and the audit events it causes."""
        t = self.tunables
        fail = lambda why: (Line(body=raw, lossy=True, failure=why), [])
        try:
            words, seps = split_line(raw)
        except NulError:
            return Line(body=raw, lossy=True), []
        if not words:
            return fail("empty_line")
        if len(words) > t.words:
            return fail("line_too_long")
        kinds = [word_kind(w) for w in words]
        masked = [None if k is not None else w for w, k in zip(words, kinds, strict=True)]
        leaves = self.routes.setdefault(self.route(masked), [])
        leaf, score = self.best(leaves, masked, severity, scope)
        if leaf is not None and score < np.float32(t.floor):
            return fail("below_floor")
        events: list[dict] = []
        if leaf is None or score < np.float32(t.threshold):
            if self.made >= t.templates:
                return fail("template_ceiling")
            fresh = Leaf(list(masked), self.new_id(), severity, scope, kinds={i: {k} for i, k in enumerate(kinds) if k is not None})
            leaves.append(fresh)
            events.append(self.event("template_created", fresh, raw, new_template=fresh.text, new_version=1))
            line = self.line(fresh, words, kinds, seps, raw)
            if leaf is not None:
                line.confidence, line.body = float(score / np.float32(t.threshold)), raw
            return line, events
        differ = [i for i, (a, b) in enumerate(zip(leaf.words, masked, strict=True)) if a is not None and a != b]
        seen = {i: kinds[i] if kinds[i] is not None else STR for i, a in enumerate(leaf.words) if a is None}
        fresh_kinds = {i: k for i, k in seen.items() if k not in leaf.kinds.setdefault(i, set())}
        if differ:
            if all(a is None or i in differ for i, a in enumerate(leaf.words)):
                events.append(self.event("template_widening_rejected_degenerate", leaf, raw, old_version=leaf.version, old_template=leaf.text, reason="no fixed word would remain"))
                line, _ = fail("degenerate_widening")
                return line, events
            old, version = leaf.text, leaf.version
            for i in differ:
                leaf.words[i] = None
                leaf.kinds[i] = {STR, kinds[i] if kinds[i] is not None else STR}
            leaf.version += 1
            events.append(self.event("template_widened", leaf, raw, old_version=version, new_version=leaf.version, old_template=old, new_template=leaf.text, positions_widened=differ))
        if fresh_kinds:
            version = leaf.version
            for i, k in fresh_kinds.items():
                leaf.kinds[i].add(k)
            leaf.version += 1
            slots = {p: s for s, p in enumerate(i for i, a in enumerate(leaf.words) if a is None)}
            events.append(self.event("template_type_expanded", leaf, raw, old_version=version, new_version=leaf.version, old_template=leaf.text, new_template=leaf.text, slots_expanded=[{"slot_index": slots[i], "types_added": [k]} for i, k in sorted(fresh_kinds.items())]))
        return self.line(leaf, words, kinds, seps, raw), events

    def line(self, leaf: Leaf, words: list[str], kinds: list[int | None], seps: list[str], raw: str) -> Line:
        """Parameters at the leaf's wildcards; a word there that has no kind is text. Too long a one keeps the body."""
        out = Line(leaf.id, leaf.version, separators=[s.encode() for s in seps], confidence=1.0)
        for w, k, fixed in zip(words, kinds, leaf.words, strict=True):
            if fixed is None:
                value = w.encode()
                if len(value) > self.tunables.param_bytes:
                    out.params.append((OVERFLOW, f"OVERFLOW(length={len(value)},sha256={hashlib.sha256(value).hexdigest()[:16]})".encode()))
                    out.body = raw
                else:
                    out.params.append((STR if k is None else k, value))
        return out

    def event(self, kind: str, leaf: Leaf, raw: str, **more) -> dict:
        return {"event_type": kind, "template_id": leaf.id, "triggering_line_hash": hashlib.sha256(raw.encode()).digest()[:16], "triggering_line_sample": sample(raw), **more}


def rebuild(template: str, line: Line) -> str | None:
    """The line's text; None where it was kept as a body instead or its parts don't fit."""
    words = template.split(" ")
    if line.lossy or any(k == OVERFLOW for k, _ in line.params) or len(line.separators) != len(words) + 1 or sum(w == WILDCARD for w in words) != len(line.params):
        return None
    values = iter(v.decode() for _, v in line.params)
    return "".join(s.decode() + (next(values) if w == WILDCARD else w) for s, w in zip(line.separators, words, strict=False)) + line.separators[-1].decode()


MINED = "template_id long, template_version int, params array<struct<type_tag:int,value:binary>>, separators array<binary>, confidence float, lossy_flag boolean, body string"
EVENT = "event_type string, template_id long, old_version int, new_version int, old_template string, new_template string, positions_widened array<int>, slots_expanded array<struct<slot_index:int,types_added:array<int>>>, triggering_line_hash binary, triggering_line_sample string, reason string"
_event_names = [c.strip().split(" ")[0] for c in "event_type,template_id,old_version,new_version,old_template,new_template,positions_widened,slots_expanded,triggering_line_hash,triggering_line_sample,reason".split(",")]


def shard_number(key: str) -> int:
    """40 bits, so that ids fit into a positive long."""
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=5).digest(), "big")


def output(seq: int, line: Line, events: list[dict]) -> dict:
    return {
        "seq": seq, "template_id": line.template_id, "template_version": line.template_version, "params": [{"type_tag": k, "value": v} for k, v in line.params], "separators": line.separators, "confidence": line.confidence,
        "lossy_flag": line.lossy, "body": line.body, "failure": line.failure, "events": [{n: e.get(n) for n in _event_names} for e in events],
    }


CARRIED_OUT = ("body", "template_id", "template_version", "params", "separators", "confidence", "lossy_flag", "failure", "events")


def sharded(df: DataFrame, tunables: Tunables) -> DataFrame:
    """df with `_shard`, the text that names each line's shard. A node has room for the words that come first: of each node's
    words the first lines are found (one row per word, summed before the shuffle) and ranked."""
    text = (F.col("body_kind") == 0) & F.col("body").isNotNull()
    words = F.when(text, tokens(F.col("body")))
    n = F.coalesce(F.size(words), F.lit(-1))
    short = F.when(text, masked(F.slice(words, 1, max(1, tunables.depth))))
    mark = fresh_names(df)
    keyed = df.withColumns({mark["t"]: F.coalesce("tenant_id", F.lit("")), mark["n"]: n, mark["at"]: F.lit("")})
    for level in range(tunables.depth):
        word = F.get(short, F.lit(level))
        keyed = keyed.withColumn(mark["w"], word)
        node = [mark["t"], mark["n"], mark["at"]]
        firsts = keyed.where(F.col(mark["w"]).isNotNull() & (F.col(mark["w"]) != WILDCARD)).groupBy(*node, mark["w"]).agg(F.min("seq").alias("_first"))
        full = firsts.groupBy(*node).agg(F.count(F.lit(1)).alias("_words")).where(F.col("_words") > tunables.children)
        # only crowded nodes need a rank: which of their words came first
        crowded = firsts.join(full.select(*node), node)
        late = crowded.withColumn("_rank", F.row_number().over(Window.partitionBy(*node).orderBy("_first", mark["w"]))).where(F.col("_rank") > tunables.children).select(*node, mark["w"], F.lit(True).alias(mark["late"]))
        keyed = keyed.join(late, [*node, mark["w"]], "left")
        step = F.when(F.col(mark["w"]).isNull(), F.lit("")).when(F.coalesce(F.col(mark["late"]), F.lit(False)), F.lit(WILDCARD)).otherwise(F.col(mark["w"]))
        keyed = keyed.withColumn(mark["at"], F.concat_ws("\x01", F.col(mark["at"]), step)).drop(mark["late"], mark["w"])
    shard = F.concat_ws("\x02", mark["t"], F.col(mark["n"]).cast("string"), mark["at"], F.coalesce("severity_number", F.lit(0)).cast("string"), F.coalesce("scope_name", F.lit("")))
    return keyed.withColumn("_shard", shard).drop(mark["t"], mark["n"], mark["at"])


def fresh_names(df: DataFrame) -> dict[str, str]:
    return {k: next(n for i in range(99) if (n := f"_{k}{'_' * i}") not in df.columns) for k in ("t", "n", "at", "w", "late")}


def schema_of(df: DataFrame, kept: list[str]) -> str:
    events = EVENT.replace(" string", ":string").replace(" long", ":long").replace(" int", ":int").replace(" binary", ":binary").replace(" array", ":array")
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields), MINED, "failure string", f"events array<struct<{events}>>"])


def mine(df: DataFrame, tunables: Tunables | None = None) -> DataFrame:
    """df (tenant_id, seq, body_kind, body, severity_number, scope_name, event_name, ...) with the mined columns, and
    `events` for the audit stream. Lines of a shard are mined in the order of seq; a partition streams its sorted shards, so
    that one template's lines needn't be in memory at once. A null body is absent: template 0."""
    limits = tunables or Tunables()
    kept = [c for c in df.columns if c not in (*CARRIED_OUT, "_shard")]
    keyed = sharded(df, limits)
    columns = [*kept, "body", "_shard"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, name = None, None
        for pdf in batches:
            out = []
            for at, group in pdf.groupby("_shard", sort=False):
                if at != name:
                    # the route is part of the shard's name
                    state, name = Shard(shard_number(at), replace(limits, depth=0)), at
                out += list(mined_rows(group, state))
            if out:
                made = pd.DataFrame(out, columns=list(out[0]))
                for c in kept:
                    made[c] = pdf[c].to_numpy()
                yield made

    return keyed.select(*columns).repartition(parts, "_shard").sortWithinPartitions("_shard", "seq").mapInPandas(run, schema_of(df, kept))


def mined_rows(pdf: pd.DataFrame, state: Shard) -> Iterator[dict]:
    for r in pdf.itertuples(index=False):
        severity = 0 if pd.isna(r.severity_number) else int(r.severity_number)
        scope = r.scope_name if isinstance(r.scope_name, str) else ""
        if not isinstance(r.body, str) or r.body_kind == 2:
            yield output(r.seq, Line(), [])
        elif r.body_kind == 1:
            yield output(r.seq, state.structured_body(severity, scope, r.event_name if isinstance(r.event_name, str) else "", r.body), [])
        else:
            yield output(r.seq, *state.text(r.body, severity, scope))


def audit_of(mined: DataFrame) -> DataFrame:
    """The audit rows of mined lines: tenant_id, timestamp (the line's time) and the events' columns."""
    return mined.select("tenant_id", F.col("time_unix_nano").alias("timestamp"), "seq", F.posexplode("events").alias("event_index", "e")).select("tenant_id", "timestamp", "seq", "event_index", "e.*")


def render(mined: DataFrame, registry: DataFrame) -> DataFrame:
    """mined with `rendered` and how: absent, structured, retained or rebuilt; null where a template is missing."""
    joined = mined.join(registry.select(F.col("template_id").alias("_id"), F.col("version").alias("_v"), "template"), (F.col("template_id") == F.col("_id")) & (F.col("template_version") == F.col("_v")), "left")
    text = rebuilt(template_words(F.col("template")), F.transform("params", lambda p: p["value"].cast("string")), F.transform("separators", lambda s: s.cast("string")))
    return (
        joined.withColumn("rendered", F.coalesce(F.col("body"), F.when(~F.col("lossy_flag"), text)))
        .withColumn("how", F.when(F.col("body_kind") == 2, "absent").when(F.col("body_kind") == 1, "structured").when(F.col("body").isNotNull(), "retained").when(F.col("rendered").isNotNull(), "rebuilt"))
        .drop("_id", "_v", "template")
    )
