"""What a query that ran has read: figures of its plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Span:
    """One operator of the executed plan: how deep it lies, its name, its figures."""

    depth: int
    name: str
    metrics: dict[str, int]


def operator_spans(df: DataFrame) -> list[Span]:
    """Operators of df's executed plan, from the top. df must have run as it is (collect, toArrow); a new DataFrame made
    from it has a plan of its own."""
    convert = df.sparkSession._jvm.scala.jdk.javaapi.CollectionConverters
    out: list[Span] = []

    def walk(node, depth: int) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return walk(node.plan(), depth)
        metrics = {k: v.value() for k, v in convert.asJava(node.metrics()).items()}
        out.append(Span(depth, node.nodeName(), metrics))
        for child in convert.asJava(node.children()):
            walk(child, depth + 1)

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return out


def scan_stats(df: DataFrame, files: int | None = None) -> dict[str, int]:
    """Files, bytes and rows that df's scans read, and of `files` in all how many weren't opened."""
    scans = [s.metrics for s in operator_spans(df) if s.name.startswith("Scan ") and "numFiles" in s.metrics]
    read = sum(m.get("numFiles", 0) for m in scans)
    out = {"files_scanned": read, "bytes_read": sum(m.get("filesSize", 0) for m in scans), "rows_read": sum(m.get("numOutputRows", 0) for m in scans)}
    return out | ({"files_pruned": max(0, files - read)} if files is not None else {})
