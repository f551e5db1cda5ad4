"""Request filters, ratios and percentiles over records, and gates on measured figures."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_DOWN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.plans.compile import in_window


def request_filters(df: DataFrame, window: tuple[int, int] | None = None, template_id: int | None = None, severity_text: str | None = None) -> DataFrame:
    """The smallest request: a half-open window, a template, a severity's text; all that are given must hold. A table without
    severity texts has no match for one."""
    out = df.where(in_window(*window)) if window else df
    if template_id is not None:
        out = out.where(F.col("template_id") == template_id)
    if severity_text is not None:
        out = out.where(F.col("severity_text") == severity_text) if "severity_text" in df.columns else out.limit(0)
    return out


def share(df: DataFrame, by: list[str], hit: Column, name: str = "ratio") -> DataFrame:
    """Of each group the share of rows that hit; an unknown hit is none."""
    return df.groupBy(*by).agg((F.sum(F.coalesce(hit, F.lit(False)).cast("long")) / F.count(F.lit(1))).alias(name))


def percentiles(df: DataFrame, by: list[str], column: str, ranks: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group, one column for each name: the smallest value with at least that share of rows
    at or below it. Nulls don't count."""
    return df.groupBy(*by).agg(*(F.expr(f"percentile_disc({p}) within group (order by `{column}`)").alias(n) for n, p in ranks.items()))


def nearest_rank(ordered: list[int], rank: float) -> int:
    """The same of a sorted list; 0 for an empty one."""
    return ordered[min(len(ordered), max(1, math.ceil(rank * len(ordered)))) - 1] if ordered else 0


def three_digits(x: float) -> float:
    """Rounded down to three significant digits, so that a gate is never passed by rounding."""
    if not x:
        return 0.0
    d = Decimal(x)
    return float(d.quantize(Decimal(1).scaleb(d.adjusted() - 2), ROUND_DOWN))


def compression(raw: int, stored: int, reference: int, least: float = 1.0) -> dict:
    """Ratios of raw bytes to those of the store and of a reference compressor, and how the first stands to the second."""
    ours, theirs = (raw / stored if stored else 0.0), (raw / reference if reference else 0.0)
    delta = three_digits(ours / theirs) if theirs else 0.0
    return {"ratio": three_digits(ours), "reference": three_digits(theirs), "delta": delta, "passed": delta >= least}


@dataclass(frozen=True)
class Gate:
    """Whether a measurement holds; None where it can't show anything, and why."""

    passed: bool | None
    advantage: float = 0.0
    reason: str = ""


def must_win(ours: int, theirs: int, margin: int) -> Gate:
    """We read at least `margin` times fewer bytes. Whole numbers decide."""
    if margin <= 0 or ours <= 0 or theirs <= 0:
        return Gate(None, reason="a margin and both measurements must be above zero")
    return Gate(ours * margin <= theirs, theirs / ours)


def within_floor(ours: int, theirs: int, factor: int) -> Gate:
    """We read at most `factor` times as many bytes."""
    if factor <= 0 or ours <= 0 or theirs <= 0:
        return Gate(None, reason="a factor and both measurements must be above zero")
    return Gate(ours <= theirs * factor, theirs / ours)


def soak(send: Callable[[list[str]], None], line: Callable[[int], str], rate: int, seconds: float, batch: int, clock: Callable[[], float], sleep: Callable[[float], None]) -> dict:
    """Send batches at a steady rate; each is due at its own time, however long the others took. Lines sent, percentiles of
    the time from when a batch was due to its acknowledgement in microseconds, and the largest number of batches overdue."""
    began, n, acks, backlog = clock(), 0, [], 0
    while (due := n * batch / rate) < seconds:
        wait = began + due - clock()
        if wait > 0:
            sleep(wait)
        backlog = max(backlog, int((clock() - began) * rate / batch) - n)
        send([line(n * batch + i) for i in range(batch)])
        acks.append(int((clock() - began - due) * 1e6))
        n += 1
    acks.sort()
    took = max(clock() - began, 1e-9)
    return {"lines": n * batch, "lines_per_second": n * batch / took, "p50": nearest_rank(acks, 0.5), "p99": nearest_rank(acks, 0.99), "most_overdue": backlog}
