"""What the operators share: checkpoints, Arrow streams, sorted groups, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python slices Arrow batches to so many text characters, so that lists of tokens stay small.
SLICE_CHARS = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, from the session or its context. Where it is unset, a folder of this machine will
    do on a single machine, as in tests; on a cluster it would not, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/loglattice-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table of columns in the cluster's checkpoint folder, for rows that are read more than once and
    not always whole. `release` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application wrote; results that haven't been read yet can't be read any more.
    Checkpoints proper go when Spark's cleaner finds them unused (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so for what the driver's collector finds unused, and a
    driver with little to do rarely collects. What the last job held goes a moment later, so one collection isn't enough."""
    gc.collect()
    for wait in (0.5, 0):
        spark._jvm.java.lang.System.gc()
        time.sleep(wait)


_held: dict[str, dict] = {}


def held_by_worker(make: Callable) -> Callable:
    """Keep what `make` returned for the same arguments, for the operator of its module only: Python workers outlive
    stages, and what another operator left there would add up to more memory than an executor has."""

    def get(*args):
        if make.__module__ not in _held:
            _held.clear()
        own = _held.setdefault(make.__module__, {})
        key = (make.__name__, args)
        if key not in own:
            for old in [k for k in own if k[0] == make.__name__]:
                del own[old]
            own[key] = make(*args)
        return own[key]

    return get


def remainder(column: str, mod: int) -> Column:
    """crc32 of the value as text, modulo mod; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of column `text`; a longer text stands alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str, text: str | None = None) -> DataFrame:
    """fn over each Arrow batch; with `text`, over slices that are bounded in characters. Columns of a list are
    named by `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text) if text else batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def sorted_groups(df: DataFrame, keys: list[str], fn: Callable[[dict], pa.RecordBatch | None], schema: str, spread: int | None = None) -> DataFrame:
    """fn over the rows of each key, given as a dict of column -> numpy array or list. One streaming pass over
    sorted partitions: many small groups cost no Python call of Spark's each, and one group at a time is in
    memory (callers bound the size of a group)."""
    parts = spread or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        outs: list[pa.RecordBatch] = []
        rows = 0

        def emit(table: pa.Table, bounds: list[int]) -> None:
            nonlocal rows
            columns = {n: table.column(n).to_numpy() if pa.types.is_primitive(table.schema.field(n).type) and not table.column(n).null_count else table.column(n).to_pylist() for n in names}
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                out = fn({n: c[a:b] for n, c in columns.items()})
                if out is not None and out.num_rows:
                    outs.append(out)
                    rows += out.num_rows

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if outs:
                yield from pa.Table.from_batches(outs).combine_chunks().to_batches()
                outs.clear()
                rows = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            change = np.zeros(table.num_rows, bool)
            for k in keys:
                c = table.column(k).combine_chunks()
                c = c.to_numpy(zero_copy_only=False)
                change[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(change)
            if len(cuts):
                emit(table.slice(0, cuts[-1]), [0, *cuts.tolist()])
                held = table.slice(cuts[-1]).to_batches()
            if rows > 20_000:
                yield from flush()
        if held:
            table = pa.Table.from_batches(held)
            emit(table, [0, table.num_rows])
        yield from flush()

    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def block_pairs(df: DataFrame, group: list[str], order: str, size: int, weight: str | None = None, most: int = 1 << 26) -> DataFrame:
    """Rows of large groups split into blocks of about `size` rows, or about `most` bytes where `weight` names a column of
    bytes, by a hash of `order`; each row once for each pair of blocks (bi <= bj) that its block is part of. Columns added:
    bi, bj, side (0: of bi, 1: of bj; 2: bi = bj). Reads df twice, so callers write it before. Groups of one row have no
    pairs and are left out."""
    total = F.sum(F.length(weight)) if weight else F.lit(0)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), total.cast("long").alias("_w")).where("_n > 1")
    blocks = F.greatest(F.ceil(F.col("_n") / size), F.ceil(F.col("_w") / most)).cast("int")
    with_block = (
        df.join(sizes, group)
        .withColumn("_nb", blocks)
        .withColumn("_b", F.pmod(F.xxhash64(F.col(order)), F.col("_nb")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    )
    return with_block.select(
        *df.columns,
        F.least("_b", "_o").alias("bi"),
        F.greatest("_b", "_o").alias("bj"),
        F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1).cast("int").alias("side"),
    )


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph on 0..n-1 with edges a[i]-b[i], as (node, root of its tree)."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        live = low != high
        if not live.any():
            break
        np.minimum.at(parent, high[live], low[live])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = a[live], b[live]
    nodes = np.flatnonzero(parent != np.arange(n))
    return nodes, parent[nodes]


#: Nodes of more edges than this, or than this share of all edges, are met by a broadcast of their own: there are no more
#: of them than edges / HEAVY, and never more than 1 / HEAVY_SHARE.
HEAVY, HEAVY_SHARE = 1000, 1e-5


def starred(rows: DataFrame, centres: DataFrame, edges: int) -> DataFrame:
    """rows (a, b) with m of their centre (a, m, n rows), without dealing a heavy centre's rows to one task."""
    least = max(HEAVY, int(edges * HEAVY_SHARE))
    heavy = F.broadcast(centres.where(F.col("n") > least).select("a", "m"))
    return rows.join(heavy, "a").unionByName(rows.join(heavy.select("a"), "a", "left_anti").join(centres.where(F.col("n") <= least).select("a", "m"), "a"))


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node reachable) of every node of the undirected edges (a long, b long).
    Large-star and small-star rounds: the number of rounds follows the logarithm of the longest chain, each round
    shuffles no more rows than there are edges, and nothing is gathered on the driver but counts."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpoint(both)
    n = e.count()
    seen = None
    while n:
        # large star: each node's larger neighbours point to its smallest neighbour or itself
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = checkpoint(starred(sym.where("b > a"), low, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: each node's smaller neighbours and itself point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = starred(large, least, n).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        e = checkpoint(small)
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        seen, n = state, state["n"]
    tops = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
