"""Queries through a store against their SQL, and what they are made of."""

import gzip
import json
import math
import os
import random

import pytest
from check_sql import compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglattice import __main__ as cli
from loglattice import catalog_store
from loglattice.operators import evaluate as E
from loglattice.operators import miner as M
from loglattice.operators import template_map
from loglattice.operators.engine import Engine
from loglattice.operators.stats import operator_spans
from loglattice.operators.visibility import Forbidden, Visibility
from loglattice.plans.compile import Promoted
from loglattice.plans.ir import QueryError
from loglattice.sources import protobuf
from loglattice.sources.frames import FrameError, FrameLog, Place, frame, frames
from loglattice.sources.store import HOUR, LogStore
from loglattice.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["scan_logs", "body_unify", "render_body", "row_dto", "mine_params", "agg_c1", "api_query", "scan_audit", "decode_otlp_pb", "quarantine", "alias_fold"])
def test_equals_sql(spark, name):
    n, differs = compare(spark, DATA, name)
    assert not differs and n > 0


values = st.recursive(
    st.builds(lambda x: {"stringValue": x}, st.text(max_size=5))
    | st.builds(lambda x: {"intValue": str(x)}, st.integers(-(2**63), 2**63 - 1))
    | st.builds(lambda x: {"boolValue": x}, st.booleans())
    | st.builds(lambda x: {"doubleValue": x}, st.floats(allow_nan=False, allow_infinity=False))
    | st.builds(lambda x: {"bytesValue": __import__("base64").b64encode(x).decode()}, st.binary(max_size=5)),
    lambda v: st.builds(lambda x: {"arrayValue": {"values": x}}, st.lists(v, min_size=1, max_size=3)) | st.builds(lambda k, x: {"kvlistValue": {"values": [{"key": k, "value": x}]}}, st.text(max_size=3), v),
    max_leaves=5,
)


@given(values, st.integers(0, 2**64 - 1), st.integers(-(2**31), 2**31 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=100, deadline=None)
def test_protobuf_round_trip(value, time, severity, flags):
    tree = {"resourceLogs": [{"resource": {"attributes": [{"key": "k", "value": value}]}, "scopeLogs": [{"scope": {"name": "é"}, "logRecords": [{"timeUnixNano": str(time), "severityNumber": severity, "body": value, "flags": flags, "traceId": "00ff"}, {}]}]}]}
    raw = protobuf.encoded(tree)
    assert protobuf.decoded(raw) == tree
    assert protobuf.decoded(raw + protobuf.number(99 << 3) + protobuf.number(5)) == tree  # an unknown field
    if len(raw) > 3:
        with pytest.raises(protobuf.WireError):
            protobuf.decoded(raw[:-1])


def test_http_bodies(spark):
    tree = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": "x"}}]}]}]}
    empty = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {}}, {"body": None}]}]}]}
    text = json.dumps(tree).encode()
    for body, lenient in ((text, False), (gzip.compress(text), False), (protobuf.encoded(tree), False), (json.dumps(empty).encode(), True)):
        got, flag = protobuf.json_form(body)
        assert flag == lenient and (lenient or json.loads(got) == tree)
    rows = protobuf.to_json(spark.createDataFrame([(b"{broken",), (b"\xff\xff",), (None,), (text,)], "content binary")).collect()
    assert [r.error is None for r in rows] == [False, False, True, True]
    assert protobuf.json_form(b"")[0] == "{}" and not math.isnan(len(rows))


def test_messages_that_begin_like_json():
    of = lambda n: {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": "x" * n}}]}]}]}
    tree = next(t for t in map(of, range(200)) if protobuf.encoded(t)[1:2] == b"{")  # a newline and the length 123
    raw = protobuf.encoded(tree)
    assert len(raw) == 125 and json.loads(protobuf.json_form(raw)[0]) == tree == json.loads(protobuf.json_form(gzip.compress(raw))[0])
    assert json.loads(protobuf.json_form(b"\n" + json.dumps(tree).encode())[0]) == tree
    for bad in (raw[:-1], b"\n{broken", b"{broken"):
        with pytest.raises(ValueError):
            protobuf.json_form(bad)


def test_frames(tmp_path):
    log = FrameLog(str(tmp_path), segment_bytes=200)
    places = [log.append([f"p{i}".encode() * 10]) for i in range(30)]
    assert len(log.segments()) > 2 and [p for *_, p in log.replay()] == [f"p{i}".encode() * 10 for i in range(30)]
    gone = log.checkpoint(places[20])
    assert gone and [p for *_, p in log.replay()] == [f"p{i}".encode() * 10 for i in range(21, 30)]
    with pytest.raises(ValueError):
        log.checkpoint(places[3])
    log.close()
    with open(log.path(log.segment), "ab") as f:
        f.write(frame(1, b"torn")[:-2])
    again = FrameLog(str(tmp_path))
    assert again.cut_off == 14 and len(list(again.replay())) == 9 and again.append([b"more"]) > places[-1]
    bad = bytearray(frame(2, b"abc") + frame(1, b"d"))
    bad[13] ^= 1
    for data in (bytes(bad), frame(1, b"abc")[:5], b"\xff" * 20, frame(1, b"x").replace(b"\x01\0\0\0", b"\x09\0\0\0", 2)):
        with pytest.raises(FrameError):
            list(frames(data))
    with pytest.raises(FrameError):
        frame(7, b"")
    assert Place(0, 5) < Place(1, 0)


def test_gates():
    assert E.must_win(10, 100, 10).passed and not E.must_win(11, 100, 10).passed and E.must_win(0, 1, 2).passed is None and E.must_win(1, 1, 0).passed is None
    assert E.within_floor(20, 10, 2).passed and not E.within_floor(21, 10, 2).passed
    assert E.nearest_rank([], 0.5) == 0 and E.nearest_rank([1, 2, 3, 4], 0.5) == 2 and E.nearest_rank([1, 2, 3, 4], 0.99) == 4
    assert E.three_digits(0.7519) == 0.751 and E.three_digits(31.79) == 31.7 and E.compression(1000, 100, 50, 0.5)["delta"] == 0.5 and not E.compression(1, 0, 1)["passed"]
    now = [0.0]

    def send(batch):
        now[0] += 0.3 if len(sent) == 2 else 0.01
        sent.extend([batch])

    sent = []
    got = E.soak(send, lambda i: f"line {i}", 100, 1.0, 10, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert got["lines"] == 100 and sum(map(len, sent)) == 100 and got["p99"] == 300_000 and got["p50"] < 300_000 and got["most_overdue"] >= 2


def fixture(spark, tmp_path, name="store"):
    """Four records of two services that share a trace, mined into a store."""
    t0 = 1_775_127_480_000_000_000
    rows = [(0, 9, "user 1 logged in", "00112233445566778899aabbccddeeff", "a"), (1000, 9, "user 2 logged in", "ffeeddccbbaa99887766554433221100", "a"), (2000, 17, "payment 7 failed", "00112233445566778899aabbccddeeff", "a"), (3000, 17, "payment 7 retried", "00112233445566778899aabbccddeeff", "b")]
    df = spark.createDataFrame([("acme", t0 + d, t0 + d, i, 0, s, "lib", None, b, bytearray.fromhex(t), v, f'[{{"key":"service.name","value":{{"stringValue":"{v}"}}}}]', "[]") for i, (d, s, b, t, v) in enumerate(rows)], "tenant_id string, time_unix_nano long, effective_time_unix_nano long, seq long, body_kind int, severity_number int, scope_name string, event_name string, body string, trace_id binary, service string, resource_attributes string, attributes string")
    store = LogStore(spark, str(tmp_path / name))
    ingest.publish(store, M.mine(df), t0)
    return Engine(store, {("resource", "service.name"): Promoted("service")}), t0 + HOUR // 2


def test_engine_answers(spark, tmp_path):
    engine, now = fixture(spark, tmp_path)
    got = engine.answer("acme", 'trace_id == "00112233445566778899AABBCCDDEEFF"', now)
    assert got["rows"] == 3 and {r["body"]["text"] for r in got["records"]} == {"user 1 logged in", "payment 7 failed", "payment 7 retried"} and {r["body"]["form"] for r in got["records"]} == {"rebuilt", "retained"}
    assert got["records"][0]["trace_id"] == "00112233445566778899aabbccddeeff" and "span_id" not in got["records"][0]
    assert got["stats"]["files_scanned"] == 1 and got["stats"]["rows_read"] == 4
    assert engine.answer("acme", "severity >= error", now)["rows"] == 2 and engine.answer("acme", "true | limit 1", now)["rows"] == 4
    assert [r["body"]["text"] for r in engine.answer("acme", 'body == "payment 7 failed"', now)["records"]] == ["payment 7 failed"]
    assert engine.answer("acme", 'body != "payment 7 failed"', now)["rows"] == 3 and engine.answer("acme", "true", 0)["rows"] == 0 and engine.answer("other", "true", now)["rows"] == 0
    assert engine.answer("acme", {"predicate": {"const": True}, "stages": [{"count": {"by": ["service"]}}]}, now)["groups"] == [{"key0": "a", "n": 3}, {"key0": "b", "n": 1}]
    assert engine.query_logs("acme", "true | limit 3", 2, now=now)["records"].__len__() == 2
    assert [t["template"] for t in engine.list_templates("acme")["templates"]] and engine.list_templates("acme")["map"] == "hit"
    assert engine.template_drift("acme", "-1d", "now", now=now)["templates"] == []
    assert set(engine.resources()) == {"grammar", "schema", "costs"}
    for bad in ("tru", '{"predicate": 3}', "true | sort ts"):
        with pytest.raises(QueryError):
            engine.answer("acme", bad, now)
    with pytest.raises(QueryError):
        engine.query_logs("acme", "drift from -1d to now")
    with pytest.raises(QueryError):
        engine.answer("a/b", "true", now)
    with pytest.raises(Forbidden):
        engine.list_templates("acme", Visibility(masked=frozenset({"body"})))
    closed = Engine(engine.store, tokens={"t": frozenset({"acme"})})
    assert closed.answer("acme", "true", now, token="t")["rows"] == 4
    with pytest.raises(PermissionError):
        closed.answer("acme", "true", now, token="x")
    with pytest.raises(Forbidden):
        closed.answer("other", "true", now, token="t")
    names = [s.name for s in operator_spans(engine.last)]
    assert any(n.startswith("Scan parquet") for n in names)


def test_foreign_record_is_an_error(spark, tmp_path):
    engine, now = fixture(spark, tmp_path)
    df = engine.store.scan("acme").withColumn("tenant_id", F.when(F.col("severity_number") == 17, "other").otherwise(F.col("tenant_id")))
    from loglattice.operators.query import Logs
    from loglattice.plans.text import parse

    assert Logs(df, "acme").execute(parse("severity < error"), now)["rows"] == 2
    with pytest.raises(QueryError):
        Logs(df, "acme").execute(parse("severity == error"), now)
    with pytest.raises(QueryError):
        Logs(df, "acme").execute(parse("true | count by scope, trace_id"), now, most=1)


def test_template_map_outcomes(spark, tmp_path):
    engine, _ = fixture(spark, tmp_path)
    store = engine.store
    assert template_map.load(store, "acme")[1] == "miss: absent" and template_map.load(store, "acme")[1] == "hit"
    ingest.publish(store, M.mine(spark.createDataFrame([("acme", 5, 5, 9, 0, 9, "lib", None, "another kind of line")], "tenant_id string, time_unix_nano long, effective_time_unix_nano long, seq long, body_kind int, severity_number int, scope_name string, event_name string, body string")), 5)
    known, how = template_map.load(store, "acme")
    assert how == "stale" and "another kind of line" in known.templates.values() and template_map.load(store, "acme")[1] == "hit"
    folder = template_map.path(store, "acme")
    assert template_map.publish(store, known, 5) and not template_map.publish(store, known, 5)
    assert store.files.create(f"{folder}/map-00000009.json", "{") and template_map.load(store, "acme")[1] == "miss: torn"
    assert store.files.create(f"{folder}/map-00000011.json", '{"form": 9}') and template_map.load(store, "acme")[1] == "miss: unknown"
    store.files.create(f"{folder}/map-00000013.json", json.dumps({"form": 1, "tenant": "x", "frontier": [], "templates": [], "classes": []}))
    with pytest.raises(PermissionError):
        template_map.load(store, "acme")


def test_command_line(spark, tmp_path, capsys):
    engine, now = fixture(spark, tmp_path)
    root = engine.store.root
    cli.main(["query", root, "acme", "true | range(2026-04-02T00:00:00Z, 2026-04-03T00:00:00Z) | count"], spark)
    assert json.loads(capsys.readouterr().out)["groups"] == [{"n": 4}]
    store = LogStore(spark, str(tmp_path / "talk"))
    store.append(spark.createDataFrame([("acme", 5, 5, f"c{i}", "u") for i in range(3)], "tenant_id string, time_unix_nano long, effective_time_unix_nano long, conversation_id string, user_id string"))
    for verb, want in ((["backfill", store.root, "acme"], {"partitions": 1}), (["erase", store.root, "acme", "c1", "--now"], {"requested": ["c1"], "erased": {"c1": 1}}), (["compact", store.root, "acme"], {"partitions": 0})):
        cli.main(verb, spark)
        assert json.loads(capsys.readouterr().out.splitlines()[-1]) == want
    assert store.scan("acme").count() == 2


def test_snapshots_go_on_where_they_were():
    rng = random.Random(1)
    lines = [f"{rng.choice(['user', 'job', 'disk'])} {rng.randrange(9)} {rng.choice(['in', 'out', 'x7'])} of {rng.choice(['a', 'b', '10.0.0.1'])}" for _ in range(300)]
    whole, part = M.Shard(7), M.Shard(7)
    want = [whole.text(x, 9, "s") for x in lines]
    got = []
    for i, x in enumerate(lines):
        if i % 50 == 0:
            part = M.Shard.restored(part.snapshot())
        got.append(part.text(x, 9, "s"))
    assert got == want
    with pytest.raises(ValueError):
        M.Shard.restored('{"form": 2}')


def test_shards_mine_like_one_machine(spark):
    """Whatever the sharding, lines that one state machine puts into one template share one, also beyond a full node."""
    rng = random.Random(2)
    lines = [f"{rng.choice('abcdefgh')}{rng.choice(['', rng.randrange(5)])} {rng.choice('xyz')} took {rng.randrange(99)} ms for {rng.choice(['one', 'two'])}" for _ in range(400)]
    limits = M.Tunables(children=4)
    one = M.Shard(1, limits)
    want = {}
    for i, x in enumerate(lines):
        want.setdefault(one.text(x, 9, "s")[0].template_id, set()).add(i)
    df = spark.createDataFrame([("t", i, 0, x, 9, "s", None) for i, x in enumerate(lines)], "tenant_id string, seq long, body_kind int, body string, severity_number int, scope_name string, event_name string")
    got = {}
    for r in M.mine(df, limits).select("seq", "template_id").collect():
        got.setdefault(r.template_id, set()).add(r.seq)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(got) > 8


def test_stream_restarts_and_refuses(spark, tmp_path):
    store, landing = LogStore(spark, str(tmp_path / "store")), tmp_path / "landing"
    landing.mkdir()

    def put(name, bodies, zipped=False):
        tree = {"resourceLogs": [{"scopeLogs": [{"scope": {"name": "s"}, "logRecords": [{"timeUnixNano": "5000", "severityNumber": 9, "body": b} for b in bodies]}]}]}
        raw = json.dumps(tree).encode() if not name.endswith(".pb") else protobuf.encoded(tree)
        (landing / name).write_bytes(gzip.compress(raw) if zipped else raw)

    text = lambda *xs: [{"stringValue": x} for x in xs]
    put("a.json", text("user 1 came in today", "user 2 came in today"))
    put("b.json.gz", text("user 3 came in today"), True)
    (landing / "c.json").write_bytes(b"{broken")
    run = lambda **more: ingest.start(spark, str(landing), "t0", store, str(tmp_path / "checkpoint"), **more).awaitTermination()
    run()
    first = {r.template_id for r in store.scan("t0").collect()}
    assert store.scan("t0").count() == 3 and len(first) == 1
    put("d.pb", text("user 4 came out today", "user 9 came in today", ""))
    run()
    rows = store.scan("t0").collect()
    assert len(rows) == 6 and {r.template_id for r in rows if r.template_id} == first and {r.template_version for r in rows if r.template_id} == {1, 2}
    assert sorted(r.event_type for r in store.scan("t0", table="audit").collect()) == ["template_created", "template_widened"]
    again = ingest.sink(store, "t0")
    again(store.scan("t0"), 0)
    assert store.scan("t0").count() == 6  # a batch that is marked isn't written again
    put("e.json", text("user 10 came in today"))
    run(allowed=frozenset({"other"}))
    assert store.scan("t0").count() == 6 and [r.event_type for r in store.scan("other", table="audit").collect()] == ["ingest_denied"]
    assert catalog_store.oracle_sql().keys() <= catalog_store.queries().keys()
