"""Ingest as a structured stream: requests from files, mined in order, audit events before records, bad records aside.

Files of a landing folder are the replayable source; the stream's checkpoint holds its offsets and the miner's state, so a
restart goes on where it was. A batch is written under its number: one that was written before its offsets were is not
written again."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loglattice.functions.templates import masked, tokens
from loglattice.operators import audit as A
from loglattice.operators import quarantine
from loglattice.operators.miner import CARRIED_OUT, Shard, Tunables, audit_of, mined_rows, schema_of, shard_number
from loglattice.sources import otlp, protobuf
from loglattice.sources.store import LogStore

#: Files that one micro-batch takes at most: what is over waits.
FILES = 1000


def requests(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """Export requests that were put into a folder, one a file: JSON or protobuf, gzipped or not. Columns: value (JSON text),
    lenient, error, file."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files).load(folder)
    return protobuf.to_json(raw.select(F.col("path").alias("file"), "content"), "content", keep=("file",))


def records(requests: DataFrame, tenant: str) -> DataFrame:
    """Flat records with `seq`, the order within a batch: by file, then as they stand in the request."""
    flat = otlp.flatten(requests, tenant, keep=("file",))
    return flat.withColumn("seq", F.concat_ws("/", "file", F.lpad(F.col("position").cast("string"), 15, "0"))).drop("file", "position")


def mined(df: DataFrame, tunables: Tunables | None = None) -> DataFrame:
    """The miner as a stateful operator. Its state is a shard's snapshot, keyed by tenant, number of words, first masked words,
    severity and scope. A stream can't see which words of a crowded node came first over all, so routes have no wildcard for
    late words here, and the ceiling holds for each shard."""
    limits = tunables or Tunables()
    kept = [c for c in df.columns if c not in (*CARRIED_OUT, "_shard")]
    text = (F.col("body_kind") == 0) & F.col("body").isNotNull()
    words = tokens(F.col("body"))
    route = F.when(text, F.array_join(masked(F.slice(words, 1, limits.depth)), "\x01")).otherwise("") if limits.depth else F.lit("")
    key = F.concat_ws("\x02", "tenant_id", F.when(text, F.size(words)).otherwise(-1).cast("string"), route, F.coalesce("severity_number", F.lit(0)).cast("string"), F.coalesce("scope_name", F.lit("")))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inner = replace(limits, depth=0)  # the route is part of the key
        shard = Shard.restored(state.get[0], inner) if state.exists else Shard(shard_number(key[0]), inner)
        rows = pd.DataFrame([r for b in batches for r in b.to_dict("records")]).sort_values("seq", kind="stable")
        out = list(mined_rows(rows, shard))
        state.update((shard.snapshot(),))
        made = pd.DataFrame(out, columns=list(out[0]))
        for c in kept:
            made[c] = rows[c].to_numpy()
        yield made

    return df.withColumn("_shard", key).groupBy("_shard").applyInPandasWithState(run, schema_of(df, kept), "snapshot string", "append", GroupStateTimeout.NoTimeout)


class Denied(PermissionError):
    """A batch with a tenant that its sender isn't bound to."""


def publish(store: LogStore, batch: DataFrame, now: int) -> tuple[int, int]:
    """A mined batch into the store: what can't be stored is counted in the audit log and kept beside it, audit events are
    durable before the records that name their templates. Records stored and set aside."""
    held = batch.persist()
    try:
        good, bad = quarantine.split(held)
        stored, aside = good.count(), bad.count()
        numbers = F.create_map(*[x for i, n in enumerate(A.EVENTS) for x in (F.lit(n), F.lit(i))])
        events = audit_of(good).withColumn("event_kind", numbers[F.col("event_type")]).drop("seq", "event_index")
        if aside:
            bad.withColumn("at", F.lit(now)).write.mode("append").parquet(f"{store.root}/quarantine")
            store.append(quarantine.events(bad, now), "audit", True)
        if events.limit(1).count():
            store.append(events, "audit", True)
        if stored:
            store.append(good.drop("events", "failure", "seq"))
        return stored, aside
    finally:
        held.unpersist()


def sink(store: LogStore, name: str, allowed: frozenset[str] | None = None, clock: Callable[[], int] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch of a stream of that name. A batch with a tenant outside of `allowed` is refused as a whole, with an audit
    event, and none of its records are stored. A batch whose number is marked was written by an earlier attempt."""
    clock = clock or store.clock

    def write(batch: DataFrame, number: int) -> None:
        mark = f"{store.root}/commits/{name}/{number:012d}.json"
        if store.files.read(mark) is not None:
            return
        denied = [r[0] for r in batch.where(~F.coalesce(F.col("tenant_id").isin(*allowed), F.lit(False))).select("tenant_id").distinct().limit(10).collect()] if allowed is not None else []
        if denied:
            # the event belongs to each tenant that the sender is bound to; the stranger's log isn't written
            store.append(store.spark.createDataFrame([(t, clock(), 8, "ingest_denied", str(d)) for t in sorted(allowed) for d in denied], "tenant_id string, timestamp long, event_kind int, event_type string, denied_tenant string"), "audit", True)
            result = {"denied": [str(d) for d in denied]}
        else:
            stored, aside = publish(store, batch, clock())
            result = {"stored": stored, "aside": aside}
        store.files.create(mark, json.dumps(result))

    return write


def start(spark: SparkSession, folder: str, tenant: str, store: LogStore, checkpoint: str, trigger: dict | None = None, tunables: Tunables | None = None, allowed: frozenset[str] | None = None, files: int = FILES) -> StreamingQuery:
    """Run the stream; `trigger` as of writeStream.trigger (by default all that is there, then stop)."""
    got = requests(spark, folder, files).where("error is null")
    writer = mined(records(got, tenant), tunables).writeStream.foreachBatch(sink(store, tenant, allowed)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
