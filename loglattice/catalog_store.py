"""Queries that read through a store: mined records, output rows, templates, streams, maintenance; with their SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import audit as A
from loglattice.operators import evaluate as E
from loglattice.operators import miner as M
from loglattice.operators import quarantine, template_map
from loglattice.operators.engine import Engine
from loglattice.operators.rows import log_rows, row_json
from loglattice.plans.compile import Promoted
from loglattice.plans.text import parse, timestamp
from loglattice.sources import corpus, otlp, protobuf
from loglattice.sources.frames import FrameLog
from loglattice.sources.store import LogStore, graph_tuples
from loglattice.sources.tables import AUDIT_SQL, LOGS_SQL, PROMOTED, audit, logs
from loglattice.streaming import ingest

FROM, TO = timestamp("2024-01-08T00:00:00Z"), timestamp("2024-01-10T00:00:00Z")
SPAN = " | range(2024-01-08T00:00:00Z, 2024-01-10T00:00:00Z)"
NOW = timestamp("2024-02-01T00:00:00Z")
WINDOW = f"t >= {FROM} and t < {TO}"
PROMOTED_HERE = PROMOTED | {("attr", "event"): Promoted("attr__event", "i64")}
_roots: dict[tuple, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder for a query's store: where the cluster's checkpoints go; on a single machine a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/loglattice-stores/{uuid.uuid4().hex}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tenants' records of the window, unmined."""
    df = logs(spark, sf_dir).where((F.col("time_unix_nano") >= FROM) & (F.col("time_unix_nano") < TO))
    return df.withColumns({"seq": F.col("event_id"), "attr__event": F.col("event_id"), "conversation_id": F.concat(F.lit("c"), (F.col("event_id") % 20).cast("string")), "effective_time_unix_nano": F.col("time_unix_nano")})


def held(spark: SparkSession, sf_dir: str) -> LogStore:
    """A store of mined records and the events of their mining; built once for a session and a folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _roots:
        store = LogStore(spark, scratch(spark))
        mined = M.mine(lines(spark, sf_dir)).persist()
        numbers = F.create_map(*[x for i, n in enumerate(A.EVENTS) for x in (F.lit(n), F.lit(i))])
        store.append(M.audit_of(mined).withColumn("event_kind", numbers[F.col("event_type")]).drop("seq", "event_index"), "audit", True)
        store.append(mined.drop("events", "failure", "seq", "user_id"))
        mined.unpersist()
        _roots[key] = store.root
    return LogStore(spark, _roots[key])


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(held(spark, sf_dir), PROMOTED_HERE)


def matching(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made, _, _ = engine(spark, sf_dir).logs("t0", parse(text + SPAN if "range(" not in text else text), NOW)
        return made.matching(parse(text + SPAN if "range(" not in text else text), NOW)[0].select("event_id", "severity_number", "event_name")

    return run


def first(spark: SparkSession, sf_dir: str, column: str) -> str:
    """The column of tenant t0's first record in the window."""
    return lines(spark, sf_dir).where("tenant_id = 't0'").orderBy("event_id").select(column).first()[0]


def body_eq(op: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: matching(f'event_name != "purchase" and body {op} "{first(spark, sf_dir, "body")}"')(spark, sf_dir)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(f'trace_id == "{first(spark, sf_dir, "trace_id").upper()}"')(spark, sf_dir)


def scan(start: int = FROM, end: int = TO) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: held(spark, sf_dir).scan("t0", start, end).where((F.col("time_unix_nano") >= start) & (F.col("time_unix_nano") < end)).select("event_id", "severity_number", "service")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    made, known, _ = e.logs("t0", parse("true" + SPAN), NOW)
    return log_rows(made.matching(parse("true" + SPAN), NOW)[0], known.registry(e.store), ("event_id",))


def output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("event_id", "time_unix_nano", "severity_number", "event_name", "scope_name", "trace_id", "flags", "span_id")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("event_id", "body.form", "body.text", "body.faithful")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = row_json(rows(spark, sf_dir), ("event_id",))
    return got.select("event_id", F.get_json_object("row", "$.body.text").alias("text"), F.get_json_object("row", "$.scope_name").alias("scope_name"), F.get_json_object("row", "$.severity_number").cast("int").alias("severity_number"), F.col("row").contains('"span_id"').alias("has_span"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each template's text."""
    store = held(spark, sf_dir)
    known = template_map.load(store, "t0")[0].registry(store)
    return store.scan("t0").join(F.broadcast(known), ["template_id"]).groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("template_id").alias("leaves"))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda i: F.get("params", F.lit(i))["value"].cast("string")
    return held(spark, sf_dir).scan("t0").select("event_id", value(0).alias("p0"), value(1).alias("p1"), F.size("params").alias("n_params"), F.size("separators").alias("n_separators"), "lossy_flag")


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = held(spark, sf_dir)
    return store.scan_audit("t0", schema="event_type string, new_version int, new_template string, template_id long, timestamp long").groupBy("event_type", "new_template", "new_version").agg(F.count(F.lit(1)).alias("n"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir).list_templates("t0")["templates"]
    return spark.createDataFrame([(t["template"], t["version"]) for t in got], "template string, version int").groupBy("template", "version").agg(F.count(F.lit(1)).alias("n"))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the map was come by the second time, and how many templates it has."""
    store = held(spark, sf_dir)
    template_map.load(store, "t0")
    known, how = template_map.load(store, "t0")
    return spark.createDataFrame([(how, len(known.templates))], "outcome string, n long")


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = held(spark, sf_dir)
    text = rows(spark, sf_dir).select("event_id", "body.text")
    both = lines(spark, sf_dir).where("tenant_id = 't0'").select("event_id", "body").join(text, "event_id", "left")
    return both.agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("body") == F.col("text")).cast("long")).alias("same")).crossJoin(F.broadcast(store.scan("t0").agg(F.countDistinct("template_id").alias("templates"))))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir).answer("t0", {"predicate": {"field": "severity", "op": ">=", "value": "error"}, "stages": [{"range": {"from": "2024-01-08T00:00:00Z", "to": "2024-01-10T00:00:00Z"}}, {"count": {"by": ["service", {"bucket": "6h"}]}}]}, NOW)
    return spark.createDataFrame([(g["key0"], g["key1"], g["n"]) for g in got["groups"]], "key0 string, key1 string, n long")


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = LogStore(spark, scratch(spark))
    events = audit(spark, sf_dir).where((F.col("timestamp") >= FROM) & (F.col("timestamp") < TO))
    store.append(events, "audit", True)
    got = Engine(store).answer("t0", "drift from 2024-01-08T00:00:00Z to 2024-01-09T12:00:00Z", NOW)["templates"]
    return spark.createDataFrame([tuple(t.values()) for t in got], "template_id long, widening_count long, from_version int, to_version int, first_at long, last_at long")


def small_files(spark: SparkSession, sf_dir: str, parts: int = 3) -> LogStore:
    store = LogStore(spark, scratch(spark))
    df = lines(spark, sf_dir).where(f"tenant_id = 't0' and time_unix_nano < {FROM + 6 * 3600 * 10**9}").select("tenant_id", "event_id", "time_unix_nano", "effective_time_unix_nano", "service", "conversation_id", F.col("user_id").cast("string").alias("user_id"), F.when(F.col("event_id") % 2 == 0, F.col("service")).alias("agent_id"))
    for i in range(parts):
        store.append(df.where(F.col("event_id") % parts == i))
    return store


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = small_files(spark, sf_dir)
    store.compact("t0", NOW)
    alone = [len(p.live) for p in store.partitions("t0")]
    return store.scan("t0").select("event_id", "service", F.lit(max(alone)).alias("files"))


def erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = small_files(spark, sf_dir, 1)
    store.request_erasure("t0", "c3")
    store.erase("t0", "conversation_id")
    return store.scan("t0").select("event_id", "conversation_id")


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = small_files(spark, sf_dir, 1)
    for _ in range(2):  # a second backfill adds nothing
        store.backfill("t0", lambda df: store.append_tuples("t0", graph_tuples(df.withColumn("tenant_id", F.lit("t0")))))
    return spark.read.parquet(store.tenant_path("t0", "tuples")).select("subject", "relation", "object")


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose attribute columns differ in type: a declared type wins, others read as null."""
    store = LogStore(spark, scratch(spark))
    df = lines(spark, sf_dir).where("tenant_id = 't0'").select("tenant_id", "event_id", "time_unix_nano", "effective_time_unix_nano", "attr__k")
    store.append(df.where("event_id % 2 = 0"))
    store.append(df.where("event_id % 2 = 1").withColumn("attr__k", F.col("attr__k").cast("string")).withColumn("more", F.lit("x")))
    return store.scan("t0", kinds={"attr__k": "bigint"}).select("event_id", "attr__k", "more")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export request for each user: JSON text."""
    df = lines(spark, sf_dir).where("tenant_id = 't0'")
    value = lambda k, c: F.struct(c.cast("string").alias(k))
    record = F.struct(
        F.col("time_unix_nano").cast("string").alias("timeUnixNano"), F.col("severity_number").alias("severityNumber"), value("stringValue", F.col("body")).alias("body"),
        F.array(F.struct(F.lit("event").alias("key"), value("intValue", F.col("event_id")).alias("value"))).alias("attributes"), F.col("trace_id").alias("traceId"), F.when(F.col("event_id") % 3 == 0, F.lit("abcd")).alias("spanId"), F.col("event_name").alias("eventName"),
    )
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), value("stringValue", F.col("service")).alias("value"))).alias("attributes"))
    by = df.withColumns({"rec": record, "res": resource}).groupBy("user_id", "scope_name", "res").agg(F.sort_array(F.collect_list(F.struct("event_id", "rec"))).alias("all"))
    scoped = F.struct(F.struct(F.col("scope_name").alias("name")).alias("scope"), F.transform("all", lambda x: x["rec"]).alias("logRecords"))
    return by.select("user_id", F.to_json(F.struct(F.array(F.struct(F.col("res").alias("resource"), F.array(scoped).alias("scopeLogs"))).alias("resourceLogs"))).alias("value"))


def decoded(df: DataFrame) -> DataFrame:
    flat = otlp.flatten(df, "t0")
    return flat.select(otlp.promoted(F.col("attributes"), "event", "i64").alias("event_id"), "time_unix_nano", F.col("severity_number").cast("int").alias("severity_number"), "scope_name", "event_name", F.lower(F.hex("trace_id")).alias("trace_id"), F.col("span_id").isNull().alias("no_span"), F.col("body_kind").cast("int").alias("body_kind"), "body", otlp.promoted(F.col("resource_attributes"), "service.name").alias("service"))


def from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(requests(spark, sf_dir))


def from_protobuf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests put into protobuf's wire form and read back."""

    def write(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            made = []
            for text in batch.column("value").to_pylist():
                tree = json.loads(text)
                for rl in tree["resourceLogs"]:
                    for sl in rl["scopeLogs"]:
                        for r in sl["logRecords"]:
                            r.pop("spanId", None)
                made.append(protobuf.encoded(tree))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["content"])

    return decoded(protobuf.to_json(requests(spark, sf_dir).select("value").mapInArrow(write, "content binary")).select("value"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in a folder, taken in by the stream in two runs, and the records that the store then has, rendered."""
    root = scratch(spark)
    store, got = LogStore(spark, f"{root}/store"), requests(spark, sf_dir)
    for part in range(2):
        got.where(F.col("user_id") % 4 == 2 * part).select("value").repartition(2).write.mode("append").option("lineSep", "\x00").text(f"{root}/lines-{part}")
        # each line is a request of its own: files of one request would be many
        spark.read.option("lineSep", "\x00").text(f"{root}/lines-{part}").select(F.from_json("value", "resourceLogs array<string>").alias("r")).select(F.explode("r.resourceLogs").alias("x")).agg(F.concat(F.lit('{"resourceLogs":['), F.array_join(F.sort_array(F.collect_list("x")), ","), F.lit("]}"))).coalesce(1).write.mode("append").text(f"{root}/landing")
        ingest.start(spark, f"{root}/landing", "t0", store, f"{root}/checkpoint").awaitTermination()
    known = template_map.load(store, "t0")[0]
    return log_rows(store.scan("t0"), known.registry(store), ("attributes",)).select(otlp.promoted(F.col("attributes"), "event", "i64").alias("event_id"), "severity_number", "body.text")


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/corpus"
    lines(spark, sf_dir).where("tenant_id = 't0'").select("event_id", F.concat(F.upper("event_name"), F.lit(": "), F.col("body")).alias("value")).orderBy("event_id").coalesce(1).select("value").write.text(path)
    return corpus.lines(spark, path, "t0", FROM).select("seq", "time_unix_nano", "severity_number", "body")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of half a day's bodies, replayed. The log is one machine's, so the time bounds what it holds."""
    got = [(r.event_id, r.body) for r in lines(spark, sf_dir).where(f"tenant_id = 't0' and time_unix_nano < {FROM + 12 * 3600 * 10**9}").orderBy("event_id").collect()]
    log = FrameLog(tempfile.mkdtemp(), segment_bytes=2000)
    for event, body in got:
        log.append([f"{event} {body}".encode()])
    log.close()
    again = FrameLog(log.folder)
    return spark.createDataFrame([(int(p.decode().split(" ", 1)[0]), p.decode().split(" ", 1)[1]) for _, _, p in again.replay()], "event_id long, body string")


def set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some can't be stored, by what is wrong with them."""
    df = lines(spark, sf_dir)
    n = F.col("event_id") % 11
    spoiled = df.withColumns({"body_kind": F.when(n == 1, 2).when(n == 2, 1).otherwise(0), "body": F.when(n.isin(2, 3, 4), None).otherwise(F.col("body")), "lossy_flag": n == 3, "separators": F.when(n == 4, F.array().cast("array<binary>")).otherwise(F.col("separators")), "time_unix_nano": F.when(n == 5, -1).otherwise(F.col("time_unix_nano")), "tenant_id": F.when(n == 6, "a/b").otherwise(F.col("tenant_id"))})
    good, bad = quarantine.split(spoiled)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).union(good.agg(F.lit("stored").alias("reason"), F.count(F.lit(1)).alias("n")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).withColumn("severity_text", F.upper("event_name"))
    own = df.where("tenant_id = 't0'")
    some = E.request_filters(own, (FROM, FROM + 12 * 3600 * 10**9), severity_text="ERROR")
    return some.select("event_id", F.lit("text").alias("by")).union(E.request_filters(own, (FROM, TO), 8).select("event_id", F.lit("template")))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.percentiles(lines(spark, sf_dir), ["service"], "attr__value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attributes")
    return lines(spark, sf_dir).select("event_id", otlp.promoted(a, "k", "i64").alias("k"), otlp.promoted(a, "note").alias("note"), otlp.promoted(a, "kind", "i64").alias("wrong_kind"), otlp.promoted(a, "k", "f64").alias("k_wide"))


def aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases asserted and retracted in the audit log decide which templates a query's one stands for."""
    store = LogStore(spark, scratch(spark))
    store.append(lines(spark, sf_dir).select("tenant_id", "event_id", "time_unix_nano", "effective_time_unix_nano", "template_id", "severity_number", "event_name"))
    events = [A.alias_event("t0", [3, 7, 9], "me", "same", FROM), A.alias_event("t0", [9, 21], "me", "same", FROM + 1), A.alias_event("t0", [7], "me", "no", FROM + 2, retract=True)]
    store.append(spark.createDataFrame([tuple(e.values()) for e in events], "tenant_id string, timestamp long, event_kind int, event_type string, alias_ids array<long>, actor string, reason string"), "audit", True)
    query = parse("resolves_to(3)" + SPAN)
    return Engine(store).logs("t0", query, NOW)[0].matching(query, NOW)[0].select("event_id")


STORE = {
    "scan_logs": scan(), "partition_prune_hour": scan(FROM + 5 * 3600 * 10**9, FROM + 11 * 3600 * 10**9), "schema_union": united, "store_pred": matching('severity >= error and service != "svc-2"'), "store_attr": matching('attr.kind == "click" and attr.k >= 2'), "pred_hex": trace, "body_unify": body_eq("=="), "body_unify_not": body_eq("!="),
    "log_row": output_rows, "render_body": bodies, "row_dto": json_rows, "mine_string": templates, "mine_params": parameters, "new_leaf": created, "list_templates": listed, "map_cache": mapped, "agg_c1": rebuilt, "api_query": answered, "scan_audit": drifted, "compact": compacted, "erase": erased, "graph_tuples": tuples,
    "decode_otlp_json": from_json, "decode_otlp_pb": from_protobuf, "src_otlp_http": streamed, "src_corpus": corpus_lines, "src_wal": replayed, "quarantine": set_aside, "req_filters": asked, "agg_latency_pct": latency, "project_promoted": promoted, "alias_fold": aliased,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(STORE)


def oracle_sql() -> dict[str, str]:
    own = f"with {LOGS_SQL}, own as (select * from logs where tenant_id = 't0' and {WINDOW}), both_ as (select * from logs where {WINDOW})"
    hour = 3600 * 10**9
    mask = "'user <*> ' || event_name || ' cents <*>'"
    some = "event_id, severity_number, event_name"
    one = "(select body from own order by event_id limit 1)"
    early = f"{own}, early as (select *, 'c' || (event_id % 20) as conversation_id from own where t < {FROM + 6 * hour})"
    flat = "event_id, t as time_unix_nano, severity_number, scope_name, event_name, trace_id, true as no_span, 0 as body_kind, body, service"
    return {
        "scan_logs": f"{own} select event_id, severity_number, service from own",
        "partition_prune_hour": f"{own} select event_id, severity_number, service from own where t >= {FROM + 5 * hour} and t < {FROM + 11 * hour}",
        "schema_union": f"{own} select event_id, case when event_id % 2 = 0 then attr__k end as attr__k, case when event_id % 2 = 1 then 'x' end as more from own",
        "store_pred": f"{own} select {some} from own where (severity_number = 0 or severity_number >= 17) and service <> 'svc-2'",
        "store_attr": f"{own} select {some} from own where event_name = 'click' and attr__k >= 2",
        "pred_hex": f"{own} select {some} from own where trace_id = (select trace_id from own order by event_id limit 1)",
        "body_unify": f"{own} select {some} from own where event_name <> 'purchase' and body = {one}",
        "body_unify_not": f"{own} select {some} from own where event_name <> 'purchase' and body <> {one}",
        "log_row": f"{own} select event_id, t as time_unix_nano, severity_number, event_name, scope_name, trace_id, event_id % 4 as flags, cast(null as varchar) as span_id from own",
        "render_body": f"{own} select event_id, 'rebuilt' as form, body as text, true as faithful from own",
        "row_dto": f"{own} select event_id, body as text, scope_name, severity_number, false as has_span from own",
        "mine_string": f"{own} select {mask} as template, count(*) as n, count(distinct coalesce(scope_name, '')) as leaves from own group by 1",
        "mine_params": f"{own} select event_id, cast(user_id as varchar) as p0, split_part(body, ' ', 5) as p1, 2 as n_params, 6 as n_separators, false as lossy_flag from own",
        "new_leaf": f"{own} select 'template_created' as event_type, {mask} as new_template, 1 as new_version, count(distinct coalesce(scope_name, '')) as n from own group by event_name",
        "list_templates": f"{own} select {mask} as template, 1 as version, count(distinct coalesce(scope_name, '')) as n from own group by event_name",
        "map_cache": f"{own} select 'hit' as outcome, count(distinct event_name || coalesce(scope_name, '')) as n from own",
        "agg_c1": f"{own} select count(*) as lines, count(*) as same, count(distinct event_name || coalesce(scope_name, '')) as templates from own",
        "api_query": f"{own} select service as key0, strftime(make_timestamp((t // {6 * hour}) * {6 * hour // 1000}), '%Y-%m-%dT%H:%M:%SZ') as key1, count(*) as n from own where severity_number = 0 or severity_number >= 17 group by 1, 2",
        "scan_audit": f"""with {AUDIT_SQL} select template_id, count(*) as widening_count, min(old_version) as from_version, max(new_version) as to_version, min("timestamp") as first_at, max("timestamp") as last_at
 from audit where tenant_id = 't0' and event_type in ('template_widened', 'template_type_expanded') and "timestamp" >= {FROM} and "timestamp" < {FROM + 36 * hour} group by template_id""",
        "compact": f"{early} select event_id, service, 1 as files from early",
        "erase": f"{early} select event_id, conversation_id from early where conversation_id <> 'c3'",
        "graph_tuples": f"{early} select distinct 'tenant:t0' as subject, 'parent' as relation, 'conversation:' || conversation_id as object from early union select 'user:' || user_id, 'participant', 'conversation:' || conversation_id from early union select 'agent:' || service, 'actor', 'conversation:' || conversation_id from early where event_id % 2 = 0",
        "decode_otlp_json": f"{own} select {flat} from own",
        "decode_otlp_pb": f"{own} select {flat} from own",
        "src_otlp_http": f"{own} select event_id, severity_number, body as text from own",
        "src_corpus": f"{own} select row_number() over (order by event_id) - 1 as seq, {FROM} + 1000000 * (row_number() over (order by event_id) - 1) as time_unix_nano, case when event_name = 'error' then 17 else 9 end as severity_number, upper(event_name) || ': ' || body as body from own",
        "src_wal": f"{own} select event_id, body from own where t < {FROM + 12 * hour}",
        "quarantine": f"{own}, b as (select case event_id % 11 when 6 then 'tenant_id' when 5 then 'time_overflow' when 1 then 'absent_body_present' when 2 then 'structured_body_missing' when 3 then 'lossy_body_missing' when 4 then 'separators' else 'stored' end as reason from both_) select reason, count(*) as n from b group by reason",
        "req_filters": f"{own} select event_id, 'text' as by from own where t < {FROM + 12 * hour} and event_name = 'error' union all select event_id, 'template' from own where template_id = 8",
        "agg_latency_pct": f"{own} select service, quantile_disc(attr__value, 0.5) as p50, quantile_disc(attr__value, 0.95) as p95, quantile_disc(attr__value, 0.99) as p99 from both_ group by service",
        "project_promoted": f"{own} select event_id, attr__k as k, attr__note as note, cast(null as bigint) as wrong_kind, cast(attr__k as double) as k_wide from both_",
        "alias_fold": f"{own} select event_id from own where template_id in (3, 9, 21)",
    }
