"""Links between classes of equal rows: what the near-duplicate operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import checkpoint, components, forest

FOUND = "node long, links long, root long"


def numbered(classes: DataFrame) -> DataFrame:
    """The classes, each with a number of its own in `node`, written once so that numbers stay. Ids of rows don't tell
    classes apart where different rows share one."""
    return checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))


def found(nodes: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """For linked pairs a[i]-b[i] of positions in `nodes`: per node the rows it links with, and a root that a spanning
    forest of the pairs gives it. No more rows than nodes, however many pairs there are."""
    if not len(a):
        return None
    links = np.bincount(a, weights=weights[b], minlength=len(nodes)) + np.bincount(b, weights=weights[a], minlength=len(nodes))
    root = np.arange(len(nodes))
    below, top = forest(len(nodes), a, b)
    root[below] = top
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links[hit].astype(np.int64)), pa.array(nodes[root[hit]])], names=["node", "links", "root"])


def summed(links: DataFrame, classes: DataFrame) -> DataFrame:
    """classes (node, first: smallest id of their rows, n) with links (other rows that a row links with) and component
    (smallest id of the rows reachable), from rows of FOUND."""
    links = checkpoint(links)
    parts = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    smallest = parts.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("_first"))
    named = parts.join(smallest, "component").select("node", F.col("_first").alias("_component"))
    total = links.groupBy("node").agg(F.sum("links").alias("_links"))
    return classes.join(total, "node", "left").join(named, "node", "left").select(*classes.columns, (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("_component", "first").alias("component"))
