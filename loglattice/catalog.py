"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice import catalog_store
from loglattice.functions import templates as T
from loglattice.operators import audit as A
from loglattice.operators import compare as M
from loglattice.operators import evaluate as E
from loglattice.operators.query import Logs
from loglattice.operators.visibility import Visibility
from loglattice.plans.text import parse, timestamp
from loglattice.sources.corpus import severity
from loglattice.sources.tables import AUDIT_SQL, LOGS_SQL, PROMOTED, audit, logs

NOW = timestamp("2024-02-01T00:00:00Z")
SPAN = " | range(2024-01-02T00:00:00Z, 2024-01-25T12:00:00Z)"
FROM, TO = timestamp("2024-01-02T00:00:00Z"), timestamp("2024-01-25T12:00:00Z")
CLASSES = A.alias_classes([("alias_asserted", [3, 7, 9]), ("alias_asserted", [9, 21]), ("alias_retracted", [7])])
WINDOW = f"t >= {FROM} and t < {TO}"

#: Predicate operators: the query, and its condition in SQL over the logs view.
PREDICATES = {
    "pred_bool": ("true", "true"),
    "pred_bool_none": ("false or severity == error", "severity_number between 17 and 20"),
    "pred_and_or": ('event_name == "click" and (service == "svc-1" or service == "svc-2") and true', "event_name = 'click' and service in ('svc-1', 'svc-2')"),
    "pred_not": ('not scope == "lib.view"', "not (scope_name = 'lib.view')"),
    "pred_severity": ("severity >= warn", "severity_number = 0 or severity_number >= 13"),
    "pred_severity_below": ("severity < warn", "severity_number <> 0 and severity_number < 13"),
    "pred_severity_band": ("severity != error", "severity_number not between 17 and 20"),
    "pred_ord": ("template_id >= 20 and flags < 3 and template_id != 33", "template_id >= 20 and event_id % 4 < 3 and template_id <> 33"),
    "pred_literal": ("ts >= 2024-01-05T00:00:00.5Z and confidence <= 0.5 and lossy == false", f"t >= {timestamp('2024-01-05T00:00:00.5Z')} and (event_id % 11) / 10.0 <= 0.5"),
    "pred_regex": ('body =~ "user [0-9]*8 (click|view)"', "regexp_matches(body, 'user [0-9]*8 (click|view)')"),
    "pred_regex_not": ('scope !~ "^lib\\\\.c"', "not regexp_matches(scope_name, '^lib\\.c')"),
    "pred_attr_promoted": ('attr.note == "1.5"', "attr__note = '1.5'"),
    "pred_attr_promoted_ne": ('attr.note != "1.5"', "attr__note <> '1.5'"),
    "pred_attr_promoted_ord": ('service > "svc-2"', "service > 'svc-2'"),
    "pred_attr_json": ('attr.kind == "purchase"', "event_name = 'purchase'"),
    "pred_attr_json_ne": ('attr.kind != "purchase" and not attr.missing == "x"', "event_name <> 'purchase'"),
    "pred_attr_numeric": ("attr.k >= 3 and attr.k != 5 and attr.value < 40.5", "attr__k >= 3 and attr__k <> 5 and attr__value < 40.5"),
    "pred_like_escape": ('contains(body, "%") or contains(body, "_") or contains(body, "7")', "contains(body, '%') or contains(body, '_') or contains(body, '7')"),
    "pred_body_eq": ('body != "user 2 view cents 5" and event_name == "view" and contains(body, "user 2")', "event_name = 'view' and body <> 'user 2 view cents 5' and contains(body, 'user 2')"),
    "fn_matches": ('matches(event_name, "^(c|v)")', "regexp_matches(event_name, '^(c|v)')"),
    "fn_contains": ('contains(body, " error ")', "contains(body, ' error ')"),
    "fn_starts_with": ('starts_with(body, "user 1")', "starts_with(body, 'user 1')"),
    "fn_ends_with": ('ends_with(scope, "view")', "suffix(scope_name, 'view')"),
    "fn_resolves_to": ("resolves_to(3)", "template_id in (3, 9, 21)"),
}
#: Aggregations: the query, its keys in SQL, and its value if it has one.
AGGREGATES = {
    "agg_count": ("severity >= error | count", [], None),
    "agg_count_by": ("severity >= error | count by service, event_name", ["service", "event_name"], None),
    "agg_null_keys": ("severity >= error | count by scope", ["scope_name"], None),
    "agg_sum": ("severity >= error | sum(attr.k) by service", ["service"], "cast(sum(attr__k) as double)"),
    "agg_min_max": ("severity >= error | max(attr.value) by event_name", ["event_name"], "max(attr__value)"),
    "agg_min": ("severity >= error | min(attr.value)", [], "min(attr__value)"),
    "agg_avg": ("severity >= error | avg(attr.k) by scope", ["scope_name"], "avg(attr__k)"),
    "agg_text_number": ("severity >= error | sum(attr.note) by service", ["service"], "sum(try_cast(attr__note as double))"),
    "group_param": ("severity >= error and template_id == 8 | count by param(0)", ["cast(user_id as varchar)"], None),
    "group_bucket": ("severity >= error | count by service, bucket(1h)", ["service", "strftime(make_timestamp((t // 3600000000000) * 3600000000), '%Y-%m-%dT%H:%M:%SZ')"], None),
}


def view(spark: SparkSession, sf_dir: str, tenant: str = "t0", visibility: Visibility | None = None) -> Logs:
    return Logs(logs(spark, sf_dir), tenant, PROMOTED, classes=A.resolver(CLASSES), visibility=visibility)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).grouped(parse("severity >= error | count by service, bucket(1h)" + SPAN), NOW)


def matching(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: view(spark, sf_dir).matching(parse(text + SPAN), NOW)[0].select("event_id", "severity_number", "body")


def grouped(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: view(spark, sf_dir).grouped(parse(text + SPAN), NOW)


def tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).tally(parse("severity >= error | count by scope" + SPAN), NOW)


def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).count(parse("severity >= error | limit 5" + SPAN), NOW)


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Logs(logs(spark, sf_dir).where("tenant_id = 't0'"), "t0", PROMOTED)
    return own.rows(parse("severity >= error | limit 9 | limit 100" + SPAN), NOW, ["event_id"]).select("event_id", "body")


def filter_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a window that names its end first is turned round
    return view(spark, sf_dir).matching(parse("true | range(2024-01-09T06:00:00Z, 2024-01-08T00:00:00Z)"), NOW)[0].select("event_id")


def default_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).matching(parse("true"), timestamp("2024-01-10T12:00:00Z"))[0].select("event_id")


def filter_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = Visibility(scope=("service", ("svc-1", "svc-3")), own=("event_name", "error"))
    return view(spark, sf_dir, visibility=some).matching(parse("true" + SPAN), NOW)[0].select("event_id")


def mask_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = Visibility(masked=frozenset({"body"}))
    return hidden.mask(view(spark, sf_dir).matching(parse("severity == error" + SPAN), NOW)[0]).select("event_id", F.col("body").cast("string").alias("body"), "service")


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drift(audit(spark, sf_dir), "t0", FROM, TO)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.list_templates(audit(spark, sf_dir), "t0").select("template_id", "version", "template")


def mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy(T.template_text(T.tokens(F.col("body"))).alias("template")).agg(F.count(F.lit(1)).alias("n"))


def overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.capped(F.col("text")).alias("value"))


def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def again(words: Column) -> Column:
        values = F.transform(T.params(words), lambda p: p["value"].cast("string"))
        return T.rebuilt(T.masked(words), values, T.separators(text))

    return docs.select("doc_id", T.let(T.tokens(text), again).alias("text"))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("body"))
    score = T.similarity(T.template_words(F.lit("person <*> click cents <*>")), words)
    return logs(spark, sf_dir).groupBy(T.zone(score).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def corpus_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.upper("event_type"), F.lit(" x WARN y"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(severity(line).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").contains("the ")).agg(F.count(F.lit(1)).alias("n"))


def compare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = logs(spark, sf_dir).select(F.col("time_unix_nano").alias("ts"), "body")
    return M.lines(all_, all_.where(F.col("body").contains("1")))


def compare_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda df: df.groupBy("service").agg(F.count(F.lit(1)).alias("n"))
    all_ = logs(spark, sf_dir)
    return M.aggregates(by(all_), by(all_.where("severity_number <> 5 or service <> 'svc-1'")), ["service"])


def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda df: df.groupBy("service").agg(F.count(F.lit(1)).alias("n"))
    all_ = logs(spark, sf_dir)
    return M.margin(by(all_), by(all_.where("severity_number <> 5")), ["service"], 0.9)


def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.share(logs(spark, sf_dir), ["service"], F.col("severity_number") == 17)


def quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.percentiles(logs(spark, sf_dir), ["service"], "attr__value", {"p50": 0.5, "p01": 0.01})


OTHERS = {
    "null_key_tally": tally, "count_all": count_all, "limit": limited, "filter_window": filter_window, "default_window": default_window, "filter_visibility": filter_visibility, "mask_rows": mask_rows, "agg_drift": drift, "registry_fold": registry, "mask_tokens": mask_tokens, "overflow_cap": overflow,
    "reconstruct": reconstruct, "similarity_zone": similarity, "corpus_severity": corpus_severity, "grep_ref": grep, "cmp_lines": compare_lines, "cmp_aggs": compare_aggregates, "cmp_margin": margin, "agg_ratio": ratio, "agg_quantile": quantile,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: matching(q) for k, (q, _) in PREDICATES.items()} | {k: grouped(q) for k, (q, _, _) in AGGREGATES.items()} | OTHERS | catalog_store.queries()


def over_logs(select: str, where: str) -> str:
    return f"with {LOGS_SQL} select {select} from logs where tenant_id = 't0' and {WINDOW} and ({where})"


def grouped_sql(keys: list[str], value: str | None) -> str:
    named = "".join(f"{k} as key{i}, " for i, k in enumerate(keys))
    where = "(severity_number = 0 or severity_number >= 17)" + "".join(f" and {k} is not null" for k in keys)
    return over_logs(named + "count(*) as n" + (f", {value} as value" if value else ""), where) + (" group by " + ", ".join(keys) if keys else "")


def oracle_sql() -> dict[str, str]:
    floor = "severity_number = 0 or severity_number >= 17"
    out = {k: over_logs("event_id, severity_number, body", w) for k, (_, w) in PREDICATES.items()}
    out |= {k: grouped_sql(keys, value) for k, (_, keys, value) in AGGREGATES.items()}
    out["group_param"] = over_logs("cast(user_id as varchar) as key0, count(*) as n", f"({floor}) and template_id = 8") + " group by user_id"
    day = lambda a, b: f"with {LOGS_SQL} select event_id from logs where tenant_id = 't0' and t >= {timestamp(a)} and t < {timestamp(b)}"
    uuid = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    masks = f"^({uuid}|{octet}(\\.{octet}){{3}}|[+-]?[0-9]+(\\.[0-9]+)?)$"
    return out | catalog_store.oracle_sql() | {
        "null_key_tally": over_logs("count(*) as rows, cast(sum(case when scope_name is null then 1 else 0 end) as bigint) as rows_excluded", floor),
        "count_all": over_logs("count(*) as n", floor),
        "limit": over_logs("event_id, body", floor) + " order by event_id limit 100",
        "filter_window": day("2024-01-08T00:00:00Z", "2024-01-09T06:00:00Z"),
        "default_window": day("2024-01-10T11:00:00Z", "2024-01-10T12:00:00Z"),
        "filter_visibility": over_logs("event_id", "service in ('svc-1', 'svc-3') or event_name = 'error'"),
        "mask_rows": over_logs("event_id, cast(null as varchar) as body, service", "severity_number between 17 and 20"),
        "agg_drift": f"""with {AUDIT_SQL} select template_id, count(*) as widening_count, min(old_version) as from_version, max(new_version) as to_version, min("timestamp") as first_at, max("timestamp") as last_at
 from audit where tenant_id = 't0' and event_type in ('template_widened', 'template_type_expanded') and "timestamp" >= {FROM} and "timestamp" < {TO} group by template_id""",
        "registry_fold": f"""with {AUDIT_SQL}, made as (select template_id, case when event_type = 'template_created' then 1 else new_version end as version, new_template as template,
 row_number() over (partition by template_id, case when event_type = 'template_created' then 1 else new_version end order by "timestamp" desc, case event_type when 'template_created' then 6 when 'template_type_expanded' then 1 else 0 end desc) as place
 from audit where tenant_id = 't0' and event_type in ('template_widened', 'template_type_expanded', 'template_created')) select template_id, version, template from made where place = 1""",
        "mask_tokens": f"with {LOGS_SQL}, m as (select array_to_string([case when regexp_matches(x, '{masks}') then '<*>' else x end for x in string_split(body, ' ')], ' ') as template from logs) select template, count(*) as n from m group by template",
        "overflow_cap": "select doc_id, case when octet_length(encode(text)) > 256 then 'OVERFLOW(length=' || octet_length(encode(text)) || ',sha256=' || substr(sha256(text), 1, 16) || ')' else text end as value from documents",
        "reconstruct": "select doc_id, text from documents",
        "similarity_zone": f"with {LOGS_SQL} select case when event_name = 'click' then 'clean' else 'lossy' end as zone, count(*) as n from logs group by 1",
        "corpus_severity": "select case when event_type = 'error' then 17 else 13 end as severity, count(*) as n from events group by 1",
        "grep_ref": "select count(*) as n from documents where contains(text, 'the ')",
        "cmp_lines": f"with {LOGS_SQL} select t as ts, body, count(*) as a, cast(0 as bigint) as b from logs where not contains(body, '1') group by t, body",
        "cmp_aggs": f"with {LOGS_SQL} select service, count(*) as a, cast(sum(case when severity_number <> 5 then 1 else 0 end) as bigint) as b from logs where service = 'svc-1' group by service",
        "cmp_margin": f"with {LOGS_SQL}, m as (select service, count(*) as a, cast(sum(case when severity_number <> 5 then 1 else 0 end) as bigint) as b from logs group by service) select service, a, b, b * 1.0 >= 0.9 * a as passed from m",
        "agg_ratio": f"with {LOGS_SQL} select service, sum(case when severity_number = 17 then 1 else 0 end) / count(*) as ratio from logs group by service",
        "agg_quantile": f"with {LOGS_SQL} select service, quantile_disc(attr__value, 0.5) as p50, quantile_disc(attr__value, 0.01) as p01 from logs group by service",
    }
