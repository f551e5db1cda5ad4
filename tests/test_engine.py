"""Miner, audit folds, store and visibility."""

import threading

import pytest
from pyspark.sql import functions as F

from loglattice.functions import templates as T
from loglattice.operators import audit as A
from loglattice.operators import miner as M
from loglattice.operators.visibility import Forbidden, Visibility
from loglattice.plans.text import parse
from loglattice.plans.compile import rfc3339
from loglattice.sources.corpus import lines as corpus_lines
from loglattice.sources.store import HOUR, READERS, LogStore

LINES = ["user 42 logged in from 10.0.0.1", "user 7 logged in from 10.0.0.2", "user x logged in from 10.0.0.3", "  a\tb  ", "", "a\0b", "job 8f14e45f-ceea-467f-a8d0-1234567890ab done", "p " + "9" * 300, "one two three", "one two four"]


def test_shard_decisions():
    s = M.Shard(1)
    first, made = s.text(LINES[0], 9, "s")
    assert [e["event_type"] for e in made] == ["template_created"] and [v for _, v in first.params] == [b"42", b"10.0.0.1"]
    second, none = s.text(LINES[1], 9, "s")
    assert second.template_id == first.template_id and not none
    other, _ = s.text(LINES[1], 17, "s")
    assert other.template_id != first.template_id
    assert M.Shard(2).text("", 9, "")[0].failure == "empty_line" and M.Shard(2).text("a\0", 9, "")[0].lossy
    assert M.Shard(2).text("w " * 600, 9, "")[0].failure == "line_too_long"
    with pytest.raises(ValueError):
        M.Tunables(threshold=0.3, floor=0.4)


def test_mined_lines_are_rebuilt(spark):
    rows = [("acme", i, 0, t, 9, None, None, i * 10**6) for i, t in enumerate(LINES)] + [("acme", 99, 2, None, 9, None, None, 0), ("acme", 98, 1, "{}", 9, "s", "e", 0)]
    df = spark.createDataFrame(rows, "tenant_id string, seq long, body_kind int, body string, severity_number int, scope_name string, event_name string, time_unix_nano long")
    mined = M.mine(df)
    got = M.render(mined, A.registry(M.audit_of(mined).withColumn("event_kind", F.lit(0)), "acme")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.rendered == (LINES[r.seq] if r.seq < len(LINES) else {99: None, 98: "{}"}[r.seq])


def test_splitting_and_unifying():
    assert T.split_line("  a\tb  ") == (["a", "b"], ["  ", "\t", "  "]) and T.split_line(" ") == ([], [" "])
    assert T.unify("user 5 in", ["user", "<*>", "in"]) == ([b"5"], [b"", b" ", b" ", b""]) and T.unify("user 5", ["user"]) is None


def test_rebuilding_splits_a_text_once(spark, tmp_path):
    from loglattice import catalog

    texts = [*LINES, *(f"{c}x{c}{c}7 {c}" for c in T.SPACE), "".join(T.SPACE), "a\u200bb \u1681 \u2027 \u2fff\u0084x", "1.2.3.4\u2028+5.0\n8f14e45f-ceea-467f-a8d0-1234567890ab", "256.1.1.1 1. -3 \n", None]
    texts.remove("a\0b")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = catalog.reconstruct(spark, str(tmp_path))
    assert [r.text for r in made.sort("doc_id").collect()] == texts
    # a text was split for every use of its words, which cost more than all else
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
    got = spark.read.parquet(str(tmp_path / "documents.parquet")).where("text is not null")
    words = T.tokens(F.col("text"))
    for r in got.select("text", words.alias("words"), T.separators(F.col("text")).alias("seps"), T.masked(words).alias("masked"), T.params(words).alias("params")).collect():
        assert (r.words, r.seps) == T.split_line(r.text)
        kinds = [T.word_kind(w) for w in r.words]
        assert r.masked == [w if k is None else T.WILDCARD for w, k in zip(r.words, kinds, strict=True)]
        assert [(p.type_tag, p.value.decode()) for p in r.params] == [(k, w) for w, k in zip(r.words, kinds, strict=True) if k is not None]


def test_aliases():
    assert A.alias_classes([("alias_asserted", [1, 2]), ("alias_asserted", [3, 4]), ("alias_asserted", [2, 3]), ("alias_retracted", [1, 4])]) == [{2, 3}]
    assert A.alias_classes([("alias_asserted", [1, 2]), ("alias_retracted", [1])]) == []
    with pytest.raises(ValueError):
        A.alias_event("t", [1], "me", "", 0)


def records(spark):
    return lambda h, n: spark.createDataFrame([("a", h * HOUR + i, h * HOUR + i, f"c{i % 2}", n) for i in range(6)], "tenant_id string, time_unix_nano long, effective_time_unix_nano long, conversation_id string, service string")


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_store(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    now = [10**18]
    store, rows = LogStore(spark, str(tmp_path / "logs"), lambda: now[0]), records(spark)
    for n in ("x", "y", None):
        store.append(rows(5, n))
        store.append(rows(6, n))
    assert store.scan("a").count() == 36 and store.scan("a", 5 * HOUR, 6 * HOUR).count() == 18 and store.scan("b").count() == 0
    assert {p.hour for p in store.partitions("a")} == {5 * HOUR, 6 * HOUR} and store.misplaced("a").count() == 0
    before = sorted(map(tuple, store.scan("a").select("time_unix_nano", "service").fillna("").collect()))
    reader = store.scan("a")
    assert store.compact("a", 5 * HOUR) == 0 and store.compact("a", 100 * HOUR) == 2
    assert [len(p.live) for p in store.partitions("a")] == [1, 1] and reader.count() == 36  # a reader of before goes on
    assert sorted(map(tuple, store.scan("a").select("time_unix_nano", "service").fillna("").collect())) == before
    assert store.collect_garbage("a") == []
    now[0] += READERS
    assert len([f for f in store.collect_garbage("a") if f.endswith(".parquet")]) == 6 and store.scan("a").count() == 36
    store.append(rows(5, "z"))
    assert store.scan("a", 5 * HOUR, 6 * HOUR).count() == 24
    assert store.request_erasure("a", "c1") and not store.request_erasure("a", "c1")
    with pytest.raises(RuntimeError):
        store.backfill("a", lambda df: df.count())
    gone = []
    assert store.erase("a", "conversation_id", gone.append) == {"c1": 21} and store.scan("a").count() == 21 and gone == ["c1"]
    assert [(r.event_type, r.conversation_id, r.rows_erased) for r in store.scan("a", table="audit").collect()] == [("conversation_erased", "c1", 21)] and store.pending_erasures("a") == []
    assert sum(store.backfill("a", lambda df: df.count())) == 21
    with pytest.raises(ValueError):
        store.scan("a/b")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_appends_during_compaction_lose_nothing(spark, tmp_path):
    store, rows = LogStore(spark, str(tmp_path / "logs")), records(spark)
    store.append(rows(5, "x"))
    errors = []

    def work(f):
        try:
            f()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(f,)) for f in [lambda: store.append(rows(5, "y"))] * 4 + [lambda: store.compact("a", 100 * HOUR)] * 3 + [lambda: store.collect_garbage("a")]]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store.scan("a").count() == 30
    assert [store.files.create(str(tmp_path / "one"), "x") for _ in range(2)] == [True, False]


def test_scans_unite_schemas(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "logs"))
    add = lambda value, kind: store.append(spark.createDataFrame([("a", 5 * HOUR, 5 * HOUR, value)], f"tenant_id string, time_unix_nano long, effective_time_unix_nano long, {kind}"))
    add(1, "attr_k long")
    add("x", "attr_k string")
    add("y", "other string")
    got = store.scan("a")
    assert dict(got.dtypes)["attr_k"] == "string" and sorted((r.attr_k or "", r.other or "") for r in got.collect()) == [("", ""), ("", "y"), ("x", "")]
    assert sorted(r.attr_k or 0 for r in store.scan("a", kinds={"attr_k": "bigint"}).collect()) == [0, 0, 1]
    add("z", "flags string")
    add(2, "flags long")
    with pytest.raises(TypeError):
        store.scan("a")


def test_queries_prune_files_and_push_filters(spark, tmp_path):
    store, rows = LogStore(spark, str(tmp_path / "logs")), records(spark)
    for h in range(48):
        store.append(rows(h, "x"))
    listed = []
    children = store.files.children
    store.files.children = lambda folder: listed.append(folder) or children(folder)
    df = store.scan("a", 5 * HOUR, 6 * HOUR).where("time_unix_nano >= 3")
    assert len(df.inputFiles()) == 1 and sum("hour=" in x for x in listed) <= 3
    assert "PushedFilters: [IsNotNull(time_unix_nano), GreaterThanOrEqual(time_unix_nano,3)]" in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_times_need_no_zone(spark):
    for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(1_775_127_480_000_000_000,), (0,), (-1,), (1_500_000,), (1_709_251_199_000_000_123,)], "ns long")
        got = [r[0] for r in df.select(rfc3339(F.col("ns"))).collect()]
        assert got == ["2026-04-02T10:58:00Z", "1970-01-01T00:00:00Z", "1969-12-31T23:59:59.999999999Z", "1970-01-01T00:00:00.001500Z", "2024-02-29T23:59:59.000000123Z"]
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_corpus_lines_are_numbered_within_their_file(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 300)):
        (tmp_path / f"{name}.txt").write_text("".join(f"line {i} of {name}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    got = corpus_lines(spark, str(tmp_path), "t", 7).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5300 and all(r.body.split()[1] == str(r.seq) and r.time_unix_nano == 7 + r.seq * 10**6 for r in got)


def test_visibility(spark):
    hidden = Visibility(masked=frozenset({"body", ("attr", "k")}))
    for q in ('contains(body, "x")', 'attr.k == "1"', "true | count by attr.k"):
        with pytest.raises(Forbidden):
            hidden.forbid(parse(q))
    hidden.forbid(parse("severity >= error | count by service"))
    with pytest.raises(Forbidden):
        hidden.require_wide()
