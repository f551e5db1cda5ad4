"""Tables on a file system that Hadoop's API reaches: layout, manifests, live files, compaction, erasure."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR = 3600 * 10**9
DAY = 24 * HOUR
GRACE = 15 * 60 * 10**9
#: Nanoseconds for which files that a manifest names no more stay, for readers that began before.
READERS = 15 * 60 * 10**9
TARGET_BYTES, MOST_FILES = 128 << 20, 4
_tenant = re.compile(r"[!-~]{1,128}\Z")
_hour = re.compile(r"year=(\d{4})(?:/month=(\d{2})(?:/day=(\d{2})(?:/hour=(\d{2}))?)?)?")
SORTED_BY = ["service", "time_unix_nano"]
#: Columns that every file of records has in one type; other columns are attributes with columns of their own.
BASE = frozenset(
    "tenant_id template_id template_version time_unix_nano observed_time_unix_nano effective_time_unix_nano severity_number severity_text scope_name scope_version attributes dropped_attributes_count resource_attributes trace_id span_id flags event_name body_kind body params separators confidence lossy_flag scope_attributes resource_schema_url scope_schema_url".split()
)
#: Columns of ids that are looked up one at a time, and ones whose values repeat too little for a dictionary.
BLOOM, PLAIN = ("trace_id", "span_id"), ("trace_id", "span_id", "time_unix_nano", "observed_time_unix_nano")


def tenant_id(text: str) -> str:
    if not _tenant.match(text) or set(text) & set(":#/"):
        raise ValueError(f"not a tenant id: {text!r}")
    return text


class Files:
    """The few operations on files that tables need, by Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def list(self, under: str) -> list[tuple[str, int]]:
        """Files below a folder with their sizes; none if it doesn't exist."""
        return [(p, n) for p, n, _ in self.stat(under)]

    def stat(self, under: str) -> list[tuple[str, int, int]]:
        """The same, with the nanosecond of their last change."""
        if not self.fs.exists(self.path(under)):
            return []
        it, out = self.fs.listFiles(self.path(under), True), []
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime() * 10**6))
        return sorted(out)

    def children(self, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders and files directly in a folder; nothing if it doesn't exist."""
        if not self.fs.exists(self.path(folder)):
            return [], []
        folders, files = [], []
        for s in self.fs.listStatus(self.path(folder)):
            (folders.append(s.getPath().toString()) if s.isDirectory() else files.append((s.getPath().toString(), s.getLen())))
        return sorted(folders), sorted(files)

    def canonical(self, p: str) -> str:
        """The path with its scheme, and without . and .. parts."""
        uri = self.fs.makeQualified(self.path(p)).toUri().normalize()
        return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"

    def read(self, p: str) -> str | None:
        if not self.fs.exists(self.path(p)):
            return None
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, p: str, text: str) -> bool:
        """Write a file that doesn't exist yet; False if it does. Of two writers one wins: on a local file system by a hard
        link to a whole file, else by a rename that doesn't overwrite, which HDFS does at once. Stores whose rename copies
        give no such promise."""
        temp = f"{p}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(temp), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                local = lambda x: self.jvm.java.io.File(self.path(x).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(p), local(temp))
            else:
                options = self.jvm.org.apache.hadoop.fs.Options.Rename
                none = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(self.path(temp), self.path(p), none)
            return True
        except Exception as e:
            if not re.search(r"FileAlreadyExists", str(getattr(e, "java_exception", e))):
                raise
            return False
        finally:
            self.fs.delete(self.path(temp), False)

    def move(self, a: str, b: str) -> None:
        self.fs.mkdirs(self.path(b).getParent())
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"{a} can't be moved to {b}")

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


@dataclass(frozen=True)
class Partition:
    path: str
    live: tuple[tuple[str, int], ...]
    generation: int
    schemas: tuple[str | None, ...] = ()

    @property
    def hour(self) -> int | None:
        return hour_of(self.path)


def span_of(path: str) -> tuple[int, int] | None:
    """First nanosecond and end of the year, month, day or hour that a path names; None for a path of another form."""
    m = _hour.search(path)
    try:
        if not m:
            return None
        y, mo, d, h = (int(x) if x else None for x in m.groups())
        begin = datetime(y, mo or 1, d or 1, h or 0, tzinfo=UTC)
        if h is not None:
            length = HOUR
        elif d is not None:
            length = DAY
        else:
            after = datetime(y + 1, 1, 1, tzinfo=UTC) if mo is None or mo == 12 else datetime(y, mo + 1, 1, tzinfo=UTC)
            length = int((after - begin).total_seconds()) * 10**9
        return int(begin.timestamp()) * 10**9, int(begin.timestamp()) * 10**9 + length
    except ValueError:
        return None


def hour_of(path: str) -> int | None:
    """The first nanosecond of a partition's hour (or day); None for a path of another form."""
    got = span_of(path)
    return got[0] if got else None


def overlaps(path: str, start: int, end: int) -> bool:
    """Whether a folder's time meets the half-open window; one that can't be told is kept."""
    got = span_of(path)
    return got is None or got[0] < end and start < got[1]


def whole(ns: Column, unit: int) -> Column:
    """How many units there are before a time; whole numbers, so that no time zone plays a part."""
    return ((ns - F.pmod(ns, F.lit(unit).cast("long"))) / F.lit(unit).cast("long")).cast("long")


def partition_columns(ns: Column) -> list[Column]:
    """year, month, day, hour of effective time in UTC, as text of fixed width."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), whole(ns, DAY).cast("int"))
    parts = [(F.year(day), 4, "year"), (F.month(day), 2, "month"), (F.dayofmonth(day), 2, "day"), (F.pmod(whole(ns, HOUR), F.lit(24)), 2, "hour")]
    return [F.lpad(c.cast("string"), n, "0").alias(name) for c, n, name in parts]


class LogStore:
    """data/tenant_id=../year=../month=../day=../hour=../*.parquet, with a commit log of manifests per partition.

    A manifest names a partition's live files with their sizes and schemas, and those retired lately; generation n is the
    file manifest-n.json, created only where it doesn't exist: of two writers one wins, the other tries again. Every append
    publishes. Without a manifest all Parquet files are live, as other tools may have written them."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = time.time_ns):
        self.spark, self.files, self.root, self.clock = spark, Files(spark, root), root.rstrip("/"), clock

    def tenant_path(self, tenant: str, table: str = "data") -> str:
        return f"{self.root}/{table}/tenant_id={quote(tenant_id(tenant), safe='')}"

    # writing

    def append(self, df: DataFrame, table: str = "data", daily: bool = False) -> None:
        """Add records; each goes to the partition of its effective time (audit: its timestamp). Files that were moved but not
        yet published are no one's until they are; garbage collection leaves them be for READERS."""
        ns = F.col("timestamp") if daily else F.coalesce("effective_time_unix_nano", "time_unix_nano")
        parts = partition_columns(ns)[: 3 if daily else 4]
        names = ["tenant_id", "year", "month", "day", *([] if daily else ["hour"])]
        stage = f"{self.root}/staging/{uuid.uuid4().hex}"
        writer = df.select("*", *parts).repartition(*names).write.partitionBy(*names).option("compression", "zstd")
        for c in (c for c in BLOOM if c in df.columns):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        for c in (c for c in PLAIN if c in df.columns):
            writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
        writer.parquet(stage)
        # the path holds the tenant; files have the other columns
        schema = T.StructType([f for f in df.schema.fields if f.name not in names]).json()
        moved: dict[str, dict[str, dict]] = {}
        for path, size in self.files.list(stage):
            if path.endswith(".parquet"):
                folder = f"{self.root}/{table}/" + path.split(stage.rsplit("/", 1)[1] + "/", 1)[1].rsplit("/", 1)[0]
                name = f"{uuid.uuid4().hex}.parquet"
                self.files.move(path, f"{folder}/{name}")
                moved.setdefault(folder, {})[name] = {"bytes": size, "schema": schema}
        self.files.delete(stage)
        for folder, new in moved.items():
            self.change(folder, new)

    def change(self, folder: str, new: dict[str, dict], old: Iterable[str] = (), base: int | None = None) -> bool:
        """Publish a partition's next generation with files added and retired, again until no other writer is first; with
        `base` only upon that generation, False if there is a later one."""
        while True:
            m = self.manifest(folder)
            generation = m["generation"] if m else 0
            if base is not None and generation != base:
                return False
            files = dict(m["files"]) if m else {p.rsplit("/", 1)[1]: {"bytes": n} for p, n in self.files.children(folder)[1] if p.endswith(".parquet")}
            now = self.clock()
            retired = {f: at for f, at in (m["retired"] if m else {}).items() if at + READERS > now} | dict.fromkeys(old, now)
            files = {f: x for f, x in (files | new).items() if f not in set(old)}
            if self.publish(folder, generation, files, retired):
                return True

    def manifest(self, folder: str) -> dict | None:
        found = [int(m[1]) for p, _ in self.files.children(folder)[1] if (m := re.search(r"/manifest-(\d+)\.json$", p))]
        return json.loads(self.files.read(f"{folder}/manifest-{max(found)}.json")) if found else None

    def publish(self, folder: str, generation: int, files: dict[str, dict], retired: dict[str, int]) -> bool:
        """Replace the manifest of this generation; False if another writer was first."""
        text = json.dumps({"generation": generation + 1, "files": dict(sorted(files.items())), "retired": retired})
        return self.files.create(f"{folder}/manifest-{generation + 1}.json", text)

    # reading

    def partitions(self, tenant: str, start: int | None = None, end: int | None = None, table: str = "data") -> list[Partition]:
        """A tenant's partitions that meet the window, with their live files. Folders of other years, months, days and hours
        aren't listed."""
        out: list[Partition] = []

        def walk(folder: str) -> None:
            folders, files = self.files.children(folder)
            for f in folders:
                if start is None or overlaps(f, start, end):
                    walk(f)
            parquet = {p.rsplit("/", 1)[1]: (p, n) for p, n in files if p.endswith(".parquet")}
            if parquet or any("/manifest-" in p for p, _ in files):
                m = self.manifest(folder)
                live = parquet if m is None else {f: parquet[f] for f in m["files"] if f in parquet}
                if m is not None and len(live) < len(m["files"]):
                    raise OSError(f"{folder}: its manifest names files that are gone")
                schemas = {f: (m["files"][f].get("schema") if m else None) for f in live}
                out.append(Partition(folder, tuple(live.values()), m["generation"] if m else 0, tuple(schemas.values())))

        walk(self.tenant_path(tenant, table))
        return out

    def live_files(self, tenant: str, start: int | None = None, end: int | None = None, table: str = "data") -> dict[str, str | None]:
        """Live files that meet the window, each once, with the schema that their manifest knows. One that lies outside of
        the tenant's folder is an error."""
        home, out = self.files.canonical(self.tenant_path(tenant, table)) + "/", {}
        for x in self.partitions(tenant, start, end, table):
            for (p, _), schema in zip(x.live, x.schemas, strict=True):
                if not self.files.canonical(p).startswith(home):
                    raise OSError(f"outside of the tenant's folder: {p}")
                out[p] = schema
        return out

    def scan(self, tenant: str, start: int | None = None, end: int | None = None, table: str = "data", schema: T.StructType | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
        """Live files under a union of their schemas, columns in the order they first appear. Files with one schema are read
        together. The types that `kinds` declares win; an attribute's column whose type differs between files and isn't
        declared is text. A column of another type than the union's reads as NULL, it is never cast; for a column of BASE
        that is an error. No files give no rows."""
        files = self.live_files(tenant, start, end, table)
        if not files:
            return self.spark.createDataFrame([], schema or "tenant_id string")
        groups: dict[str, list[str]] = {}
        for p, known in files.items():
            groups.setdefault(known or self.footer(p), []).append(p)
        types: dict[str, str] = {}
        for f in (f for g in groups for f in T.StructType.fromJson(json.loads(g)).fields):
            kind = f.dataType.simpleString()
            if f.name in (kinds or {}):
                types[f.name] = kinds[f.name]
            elif types.setdefault(f.name, kind) != kind:
                if table == "data" and f.name in BASE:
                    raise TypeError(f"{f.name} is {types[f.name]} in some files and {kind} in others")
                types[f.name] = "string"
        frames = []
        for g, paths in groups.items():
            one = T.StructType.fromJson(json.loads(g))
            df = self.spark.read.schema(one).parquet(*paths)
            frames.append(df.select(F.lit(tenant).alias("tenant_id") if "tenant_id" not in df.columns else F.col("tenant_id"), *[F.col(f"`{f.name}`") if f.dataType.simpleString() == types[f.name] else F.lit(None).cast(types[f.name]).alias(f.name) for f in one.fields if f.name != "tenant_id"]))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def footer(self, path: str) -> str:
        """The schema of a file that no manifest describes."""
        return T.StructType([f for f in self.spark.read.parquet(path).schema.fields if f.name not in ("year", "month", "day", "hour")]).json()

    def scan_audit(self, tenant: str, start: int | None = None, end: int | None = None, schema: T.StructType | str = "tenant_id string, timestamp long, event_kind int, event_type string") -> DataFrame:
        """Audit events of a tenant with their place in the log, `file` and `row`: the order of a fold is (file, row). An event
        of another tenant is an error when it is read."""
        files = sorted(self.live_files(tenant, start, end, "audit"))
        if not files:
            return self.spark.createDataFrame([], schema).withColumns({"file": F.lit(""), "row": F.lit(0).cast("long")})
        df = self.spark.read.schema(schema).parquet(*files).withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
        own = F.coalesce(F.col("tenant_id"), F.lit(tenant)) if "tenant_id" in df.columns else F.lit(tenant)
        return df.withColumn("tenant_id", F.when(own == tenant, own).otherwise(F.raise_error(F.lit("an event of another tenant"))))

    def misplaced(self, tenant: str) -> DataFrame:
        """Records whose effective time isn't that of their partition's path."""
        df = self.spark.read.parquet(*self.live_files(tenant)).withColumn("_file", F.col("_metadata.file_path"))
        want = F.concat_ws("/", *[F.concat(F.lit(n + "="), c) for n, c in zip(("year", "month", "day", "hour"), partition_columns(F.coalesce("effective_time_unix_nano", "time_unix_nano")), strict=True)])
        return df.where(~F.contains("_file", want))

    # maintenance

    def candidates(self, tenant: str, now: int) -> list[Partition]:
        """Sealed partitions of several files that are many or small."""
        return [p for p in self.partitions(tenant) if p.hour is not None and now >= p.hour + HOUR + GRACE and len(p.live) >= 2 and (len(p.live) > MOST_FILES or any(s < TARGET_BYTES for _, s in p.live))]

    def rewrite(self, p: Partition, keep: Column | None = None, sort: list | None = None) -> bool:
        """Write a partition's live rows anew, sorted and without those that `keep` refuses, and swap the manifest. Rows that
        sort alike stay in the order of their files and rows. The old files are retired, not deleted: readers that began
        before still find them."""
        names = [f.rsplit("/", 1)[1] for f, _ in p.live]
        df = self.spark.read.parquet(*[f for f, _ in p.live])
        columns = df.columns
        df = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
        df = df.where(keep) if keep is not None else df
        total = sum(s for _, s in p.live)
        order = [*(sort or [F.asc_nulls_first(c) for c in SORTED_BY if c in columns]), "_file", "_row"]
        parts = max(1, round(total / (4 * TARGET_BYTES)))
        df = df.repartition(1).sortWithinPartitions(*order) if parts == 1 else df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        stage = f"{self.root}/staging/{uuid.uuid4().hex}"
        made = df.select(*columns)
        made.write.option("compression", "zstd").option("parquet.block.size", str(min(max(total // 8, 1 << 20), 32 << 20))).parquet(stage)
        fresh = {}
        for path, size in self.files.list(stage):
            if path.endswith(".parquet"):
                name = f"{uuid.uuid4().hex}.parquet"
                self.files.move(path, f"{p.path}/{name}")
                fresh[name] = {"bytes": size, "schema": T.StructType([f for f in made.schema.fields if f.name not in ("tenant_id", "year", "month", "day", "hour") or f.name == "tenant_id" and "tenant_id=" not in p.path]).json()}
        self.files.delete(stage)
        if not self.change(p.path, fresh, names, p.generation):
            for f in fresh:
                self.files.delete(f"{p.path}/{f}")
            return False
        return True

    def compact(self, tenant: str, now: int) -> int:
        """Rewrite every candidate; the number of partitions rewritten."""
        return sum(self.rewrite(p) for p in self.candidates(tenant, now))

    def collect_garbage(self, tenant: str, table: str = "data") -> list[str]:
        """Delete what no manifest names and no reader needs any more: retired files and others that a partition's manifest
        doesn't name, temporary files and old manifests, each READERS after it was retired or last changed."""
        gone, now = [], self.clock()
        for p in self.partitions(tenant, table=table):
            if p.generation:
                live, retired = {f for f, _ in p.live}, self.manifest(p.path)["retired"]
                for f, _, changed in self.files.stat(p.path):
                    name = f.rsplit("/", 1)[1]
                    old = name.endswith(".tmp") or name.endswith(".parquet") and f not in live or name.startswith("manifest-") and name != f"manifest-{p.generation}.json"
                    if old and retired.get(name, changed) + READERS <= now:
                        gone.append(f)
        for f in gone:
            self.files.delete(f)
        return gone

    def request_erasure(self, tenant: str, conversation: str) -> bool:
        """Mark a conversation for erasure; False if it is marked already."""
        return self.files.create(self.mark(tenant, conversation, "rows"), json.dumps({"conversation": conversation, "phase": "rows"}))

    def erasures(self, tenant: str) -> list[tuple[str, str]]:
        """(conversation, phase) of the marks: rows are erased first, then what was derived from them."""
        marks = [json.loads(self.files.read(p)) for p, _ in self.files.list(f"{self.root}/erasure/{quote(tenant, safe='')}") if p.endswith(".json")]
        phases: dict[str, str] = {}
        for m in sorted(marks, key=lambda m: ("rows", "tuples").index(m["phase"])):
            phases[m["conversation"]] = m["phase"]
        return sorted(phases.items())

    def pending_erasures(self, tenant: str) -> list[str]:
        return [c for c, _ in self.erasures(tenant)]

    def mark(self, tenant: str, conversation: str, phase: str) -> str:
        return f"{self.root}/erasure/{quote(tenant, safe='')}/{quote(conversation, safe='')}.{phase}.json"

    def erase(self, tenant: str, column: str, tuples: Callable[[str], None] | None = None) -> dict[str, int]:
        """Rewrite every partition without the marked conversations' rows, note that this phase is over, have `tuples` remove
        what was derived, write an audit event, then remove the marks. A run that was cut off goes on where it was; rows
        erased by conversation."""
        marked = self.erasures(tenant)
        if not marked:
            return {}
        count = dict.fromkeys([c for c, _ in marked], 0)
        rows = [c for c, phase in marked if phase == "rows"]
        if rows:
            hit = F.col(column).isin(*rows)
            for p in self.partitions(tenant):
                if p.live:
                    found = self.spark.read.parquet(*[f for f, _ in p.live]).where(hit).groupBy(column).count().collect()
                    if found:
                        if not self.rewrite(p, F.coalesce(~hit, F.lit(True))):
                            raise OSError(f"{p.path} changed meanwhile")
                        for r in found:
                            count[r[0]] += r[1]
            for c in rows:
                self.files.create(self.mark(tenant, c, "tuples"), json.dumps({"conversation": c, "phase": "tuples"}))
        now = self.clock()
        for c in count:
            if tuples:
                tuples(c)
        events = [(tenant, now, 9, "conversation_erased", c, n) for c, n in count.items()]
        self.append(self.spark.createDataFrame(events, "tenant_id string, timestamp long, event_kind int, event_type string, conversation_id string, rows_erased long"), "audit", True)
        for c in count:
            for phase in ("rows", "tuples"):
                self.files.delete(self.mark(tenant, c, phase))
        return count

    def append_tuples(self, tenant: str, tuples: DataFrame) -> int:
        """Add relationship tuples that aren't known yet; how many."""
        path = _tuples_path(self, tenant)
        known = self.spark.read.parquet(path) if self.files.list(path) else None
        new = tuples.join(known, ["subject", "relation", "object"], "left_anti") if known is not None else tuples
        stage = f"{self.root}/staging/{uuid.uuid4().hex}"
        new.write.parquet(stage)
        n = self.spark.read.schema(tuples.schema).parquet(stage).count()
        for p, _ in self.files.list(stage):
            if p.endswith(".parquet"):
                self.files.move(p, f"{path}/{uuid.uuid4().hex}.parquet")
        self.files.delete(stage)
        return n

    def sweep(self, tenants: Iterable[str], now: int, column: str) -> dict[str, tuple[int, dict[str, int]]]:
        """Garbage, compaction and erasure of each tenant."""
        out = {}
        for t in tenants:
            self.collect_garbage(t)
            out[t] = (self.compact(t, now), self.erase(t, column))
        return out

    def backfill(self, tenant: str, derive) -> list:
        """derive(DataFrame) for each partition, under a lock; refused while erasures are pending."""
        lock = f"{self.root}/backfill/{quote(tenant, safe='')}.lock"
        if self.pending_erasures(tenant):
            raise RuntimeError("erasures are pending")
        if not self.files.create(lock, "backfill"):
            raise RuntimeError("another backfill is running")
        try:
            return [derive(self.spark.read.parquet(*[f for f, _ in p.live])) for p in self.partitions(tenant) if p.live]
        finally:
            self.files.delete(lock)


def _tuples_path(store: LogStore, tenant: str) -> str:
    return store.tenant_path(tenant, "tuples")


def graph_tuples(df: DataFrame) -> DataFrame:
    """Distinct (subject, relation, object) of records: a tenant is parent of its conversations, a user takes part in them, an
    agent acts in them, and a reader that a record names may see them."""
    conversation = F.concat(F.lit("conversation:"), F.col("conversation_id"))
    known = df.where(F.col("conversation_id").isNotNull())
    pick = lambda column, kind, relation: known.where(F.col(column).isNotNull()).select(F.concat(F.lit(kind + ":"), F.col(column)).alias("subject"), F.lit(relation).alias("relation"), conversation.alias("object"))
    roles = [("tenant_id", "tenant", "parent"), ("user_id", "user", "participant"), ("agent_id", "agent", "actor"), ("reader_id", "user", "scoped_reader")]
    return reduce(DataFrame.union, [pick(*r) for r in roles if r[0] in df.columns]).distinct()
