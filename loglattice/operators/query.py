"""Execution of log queries: filters, counts, rows, grouped aggregates."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators.visibility import Visibility
from loglattice.plans.compile import Checked, Compiler, Promoted, Table, in_window, row_limit, validate
from loglattice.plans.ir import Aggregate, Query, QueryError


FOREIGN = "a record of another tenant"
#: Groups that an answer holds at most.
MOST_GROUPS = 100_000


def filtered(df: DataFrame, query: Query, checked: Checked, compiler: Compiler, visibility: Visibility) -> DataFrame:
    """Window, predicate and what the principal may see. A predicate that is constantly false reads nothing."""
    condition = compiler.predicate(query.predicate)
    if condition is False or checked.window[0] >= checked.window[1]:
        return df.limit(0)
    out = df.where(in_window(*checked.window))
    if condition is not True:
        out = out.where(condition)
    return visibility.restrict(out)


def aggregate(df: DataFrame, spec: Aggregate, compiler: Compiler) -> DataFrame:
    """key0.., n, and value for scalar aggregates. Rows with a NULL key form no group. Without keys there is one group,
    even over no rows."""
    keys = [compiler.term(t).alias(f"key{i}") for i, t in enumerate(spec.by)]
    columns = [F.count(F.lit(1)).alias("n")]
    if spec.path is not None:
        value = getattr(F, spec.function)(compiler.scalar(spec))
        columns.append(F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).alias("value"))
    if not keys:
        return df.agg(*columns)
    named = df.select("*", *keys)
    names = [f"key{i}" for i in range(len(keys))]
    return named.dropna(subset=names).groupBy(*names).agg(*columns)


def excluded(df: DataFrame, spec: Aggregate, compiler: Compiler) -> DataFrame:
    """rows: all that match; rows_excluded: those of a NULL key."""
    some_null = F.lit(False)
    for t in spec.by:
        some_null = some_null | compiler.term(t).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(some_null.cast("long")), F.lit(0)).alias("rows_excluded"))


class Logs:
    """A table of log records of one tenant, and its queries."""

    def __init__(self, df: DataFrame, tenant: str, promoted: dict[tuple[str, str], Promoted] | None = None, classes=None, bodies=None, visibility: Visibility | None = None):
        self.all, self.tenant = df, tenant
        self.df = df.where(F.col("tenant_id") == tenant)
        self.compiler = Compiler(Table.of(df, promoted or {}), classes, bodies)
        self.visibility = visibility or Visibility()

    def matching(self, query: Query, now: int) -> tuple[DataFrame, Checked]:
        checked = validate(query, now)
        self.visibility.forbid(query)
        return filtered(self.df, query, checked, self.compiler, self.visibility), checked

    def count(self, query: Query, now: int) -> DataFrame:
        return self.matching(query, now)[0].agg(F.count(F.lit(1)).alias("n"))

    def grouped(self, query: Query, now: int) -> DataFrame:
        rows, checked = self.matching(query, now)
        if checked.aggregate is None:
            raise QueryError("the query has no aggregation")
        return aggregate(rows, checked.aggregate, self.compiler)

    def tally(self, query: Query, now: int) -> DataFrame:
        rows, checked = self.matching(query, now)
        if checked.aggregate is None:
            raise QueryError("the query has no aggregation")
        return excluded(rows, checked.aggregate, self.compiler)

    def rows(self, query: Query, now: int, order: list[str] | None = None) -> DataFrame:
        """The matching records, up to the query's limit or the default; masked as the principal's view demands. A record of
        another tenant among them is an error, raised as it is read."""
        checked = validate(query, now)
        self.visibility.forbid(query)
        own = F.when(F.col("tenant_id").eqNullSafe(F.lit(self.tenant)), F.lit(True)).otherwise(F.raise_error(F.lit(FOREIGN)).cast("boolean"))
        out = self.visibility.mask(filtered(self.all, query, checked, self.compiler, self.visibility).where(own))
        return (out.orderBy(*order) if order else out).limit(row_limit(checked.limit))

    def execute(self, query: Query, now: int, most: int = MOST_GROUPS) -> dict:
        """What a server answers: groups with the rows they leave out, or rows with the count of all that match; the
        count is a job of its own only where the limit was reached. More than `most` groups are an error."""
        checked = validate(query, now)
        if checked.aggregate is not None:
            names = [f"key{i}" for i in range(len(checked.aggregate.by))]
            groups = self.grouped(query, now)
            got = [r.asDict() for r in (groups.limit(most + 1).orderBy(*names) if names else groups).collect()]
            if len(got) > most:
                raise QueryError(f"more than {most} groups")
            return {"groups": got, **self.tally(query, now).first().asDict()}
        limit = row_limit(checked.limit)
        try:
            got = [r.asDict(recursive=True) for r in self.rows(query, now).collect()]
        except PySparkException as e:
            if FOREIGN in str(e):
                raise QueryError(FOREIGN) from e
            raise
        return {"rows": len(got) if len(got) < limit else self.count(query, now).first()["n"], "records": got}
