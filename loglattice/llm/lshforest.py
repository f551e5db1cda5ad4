"""N-gram Jaccard join by a MinHash LSH forest (operator 8).

A document is the set of its runs of five words. Equal sets are one class. Each class has a signature of one byte per
hash function; a tree of the forest is the sorted list of the classes' labels, LABEL bytes of the signature each, which is
a prefix trie: the classes below a node stand side by side. Each class starts from its whole label in each tree and
shortens the prefix that it matches until a pair at the threshold meets in some tree with the target recall; it goes on
to shorter prefixes while it has found too few candidates and the node above is no crowd. Meetings are tested by the whole
signatures in blocks; what passes is joined to clusters, and within a cluster every pair is verified exactly, in blocks
again.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import block_pairs, checkpoint, components, fresh, held_by_worker, map_arrow, sorted_groups, strings, written
from loglattice.llm.licenses import _WORD
from loglattice.llm.links import FOUND, found, numbered, summed

WORDS = 5
SIMILARITY = 0.8
#: Trees of the forest, bytes of a label, and the share of pairs at the threshold that must meet.
TREES, LABEL, RECALL = 24, 7, 0.999
#: Beyond the target recall, a class with fewer candidates than ENOUGH at its node takes those of the next shorter prefix,
#: if there are at most CROWD of them.
ENOUGH, CROWD = 4, 16
#: Pairs that meet pass if their signatures agree within so many standard errors of the threshold.
SIGMAS = 5.0
SIGNATURE_BLOCK, SET_BLOCK = 512, 256
#: Bytes of sets that stand together in one block.
SET_BYTES = 16 << 20
REMEMBERED = 400_000
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 16_384


def target_depth(similarity: float, recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> int:
    """How far a prefix is shortened at least: to the longest one at which a pair of this similarity meets in some tree
    with the target recall."""
    m = label
    while m > 1 and 1 - (1 - similarity**m) ** trees < recall:
        m -= 1
    return m


def common_bytes(labels: np.ndarray) -> np.ndarray:
    """Of each label (a number of LABEL bytes) and the one before it in sorted order: bytes of their common prefix."""
    differ = labels[1:] ^ labels[:-1]
    return np.r_[0, LABEL - sum((differ >> np.uint64(8 * k)) > 0 for k in range(LABEL))]


def meetings(tree: np.ndarray, label: np.ndarray, depth: int, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted (tree, label) rows: to which prefix length each row's match is shortened, 0 for rows that match none; and
    whether it is part of a run that may go on beyond the rows' ends (`first`, `last`: whether rows were cut there)."""
    n = len(label)
    lcp = common_bytes(label)
    lcp[np.r_[True, tree[1:] != tree[:-1]]] = 0
    out, cut = np.zeros(n, np.int8), np.zeros(n, bool)
    begins = np.flatnonzero(lcp < depth)
    sizes = np.diff(np.r_[begins, n])
    run = np.repeat(np.arange(len(begins)), sizes)
    out[sizes[run] > 1] = depth
    ends = np.zeros(len(begins), bool)
    ends[0] |= first
    ends[-1] |= last
    cut[ends[run]] = True
    out[cut] = depth
    if depth > 1:
        # nodes one byte higher: small ones that have a class with too few candidates meet as a whole
        above = np.flatnonzero(lcp < depth - 1)
        wide = np.diff(np.r_[above, n])
        node = np.repeat(np.arange(len(above)), wide)
        fewest = np.minimum.reduceat(sizes[run], above)
        whole = (wide > 1) & (wide <= CROWD) & (fewest - 1 < ENOUGH) & (fewest < wide)
        whole[0] &= not first
        whole[-1] &= not last
        out[whole[node]] = depth - 1
    return out, cut


class Shingles:
    """Hashes of a document's runs of words. Texts shorter than a run are one run; texts without words have none."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode().translate(_WORD).split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        known.update((w, digest(w)) for w in set().union(*split) if w not in known)
        return [np.fromiter(map(known.__getitem__, s), np.uint64, len(s)) for s in split]

    def sets(self, texts: list[str], n: int = WORDS) -> list[np.ndarray]:
        out = []
        for w in self.words(texts):
            k = min(n, len(w))
            if not k:
                out.append(w)
                continue
            h = w[: len(w) - k + 1] ^ np.uint64(k)
            for i in range(1, k):
                h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))
                h = h + w[i : len(w) - k + 1 + i]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append(np.unique(h ^ (h >> np.uint64(32))))
        return out


@held_by_worker
def shingler() -> Shingles:
    return Shingles()


@lru_cache(1)
def functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return (rng.integers(0, 1 << 32, (TREES * LABEL, 1), np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, (TREES * LABEL, 1), np.uint32)


def signature(shingles: np.ndarray) -> bytes:
    """One byte of the smallest value under each hash function."""
    a, b = functions()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[None, i : i + 1024] * a + b).min(1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in left, position in right) of Jaccard similarity >= least; with `same` each once."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[inverse] > 1
    row, col = row[shared], column[inverse[shared]]
    common = np.zeros((len(left), len(right)), np.float64)
    width = int((counts > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for c in range(0, width, COLUMNS):
        x, y = np.searchsorted(col, [c, c + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, width - c)), np.float32)
        m[row[x:y], col[x:y] - c] = 1
        common += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    hit = common >= least * union - 1e-9
    return np.nonzero(np.triu(hit, 1) if same else hit)


def candidates(classes: DataFrame, least: float) -> DataFrame:
    """(meeting, node): classes that meet at a node of some tree. Labels are sorted over all partitions by (tree, label,
    node), so that a crowd below one prefix is dealt to as many tasks as it fills; runs that a partition's end cuts are put
    together by their prefix. Meetings of the same classes in several trees are one."""
    depth = target_depth(least)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, TREES, LABEL)
        labels = sum(sigs[:, :, k].astype(np.int64) << (8 * (LABEL - 1 - k)) for k in range(LABEL))
        return pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int8), len(sigs))), pa.array(labels.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), TREES))], names=["tree", "label", "node"])

    def walk(batches):
        """Whole runs of sorted rows at a time; what may go on in the next batch waits."""
        held, first, k = None, True, LABEL - max(1, depth - 1)
        for batch in itertools.chain(batches, [None]):
            rows = [batch.column(c).to_numpy() for c in ("tree", "label", "node")] if batch is not None else None
            if rows is not None and not len(rows[0]):
                continue
            if held is not None and rows is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            elif rows is None:
                rows = held
            if rows is None:
                break
            tree, label, node = rows
            n = len(label)
            if batch is not None:
                same = (tree == tree[-1]) & (label >> (8 * k) == label[-1] >> (8 * k))
                wait = n - int(same.argmax())
                if wait == n or wait > CROWD:
                    # a crowd: hand on what there is, the rest of its rows are put together by their prefix
                    done, held, crowded = n, None, True
                else:
                    done, held, crowded = n - wait, [x[n - wait :] for x in rows], False
            else:
                done, held, crowded = n, None, True
            if done:
                level, cut = meetings(tree[:done], label[:done].view(np.uint64), depth, first, crowded)
                first = crowded
                at = np.flatnonzero(level)
                if len(at):
                    shift = (8 * (LABEL - level[at])).astype(np.int64)
                    key = ((label[:done][at] >> shift) << np.int64(8)) | (tree[:done][at].astype(np.int64) * 8 + level[at])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[:done][at]), pa.array(cut[at])], names=["place", "node", "cut"])

    labels = map_arrow(classes.select("node", "sig"), spread, "tree byte, label long, node long")
    met = written(labels.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node").mapInArrow(walk, "place long, node long, cut boolean"))
    groups = met.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"), F.sum(F.col("node").cast("decimal(38,0)")).alias("h3")).where("n > 1")
    once = groups.groupBy("n", "h1", "h2", "h3").agg(F.min("place").alias("place")).select("place")
    return met.join(once, "place").select(F.col("place").alias("meeting"), "node")


def near_duplicates(df: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, class_id (smallest doc_id of those with the same set), n_links (other rows of
    similarity >= least), component_id (smallest doc_id reachable by links, itself included), kept (doc_id =
    component_id). Texts without words, null texts and rows with a null key link with nothing. Rows that repeat a key
    with different texts are told apart, each with the links of its own text. Ties: ids are the smallest ones. An empty
    table gives no rows; other columns are left out."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingler().sets(strings(batch, text))
        some = [len(s) > 0 and k for s, k in zip(sets, batch.column("doc_id").is_valid().to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if ok else None for s, ok in zip(sets, some, strict=True)], pa.binary()),
                pa.array([signature(s) if ok else None for s, ok in zip(sets, some, strict=True)], pa.binary()),
            ],
            names=["doc_id", "set_key", "sig"],
        )

    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias(text))
    signed = written(map_arrow(docs, sign, "doc_id long, set_key binary, sig binary", text))
    some = signed.where(F.col("set_key").isNotNull())
    classes = numbered(some.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("sig").alias("sig")))
    met = written(candidates(classes, least).join(classes.select("node", "sig"), "node"))
    size, need = TREES * LABEL, least - SIGMAS * np.sqrt(least * (1 - least) / (TREES * LABEL))

    def similar(g: dict) -> pa.RecordBatch | None:
        side, nodes = np.asarray(g["side"]), np.asarray(g["node"])
        sigs = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(-1, size)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        pairs_a, pairs_b = [], []
        for i in range(0, len(left), 128):
            part = left[i : i + 128]
            agree = (sigs[part][:, None, :] == sigs[right][None, :, :]).sum(2)
            a, b = np.nonzero(agree >= need * size)
            pairs_a.append(part[a])
            pairs_b.append(right[b])
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        keep = nodes[a] != nodes[b]
        return found(nodes, np.ones(len(nodes)), a[keep], b[keep])

    near = sorted_groups(block_pairs(met, ["meeting"], "node", SIGNATURE_BLOCK), ["meeting", "bi", "bj"], similar, FOUND)
    clusters = checkpoint(components(near.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingler().sets(strings(batch, text))
        raw = [s.tobytes() for s in sets]
        return pa.RecordBatch.from_arrays([batch.column("first"), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["first", "set_key", "raw"])

    # the text of one row of each class in a cluster; an id that different texts share brings them all, their sets tell
    wanted = classes.join(clusters, "node").select("first", "set_key", "node", "component", "n")
    texts = docs.withColumnRenamed("doc_id", "first").join(wanted.select("first").distinct(), "first", "left_semi").dropDuplicates()
    sets = written(map_arrow(texts, gather, "first long, set_key binary, raw binary", text).dropDuplicates(["first", "set_key"]).join(wanted, ["first", "set_key"]).select("component", "node", "n", "raw"))

    def exact(g: dict) -> pa.RecordBatch | None:
        side = np.asarray(g["side"])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return None
        a, b = verified([np.frombuffer(r, np.uint64) for r in g["raw"]], left, right, least, g["bi"][0] == g["bj"][0])
        return found(np.asarray(g["node"]), np.asarray(g["n"], float), left[a], right[b])

    pairs = sorted_groups(block_pairs(sets, ["component"], "node", SET_BLOCK, "raw", SET_BYTES), ["component", "bi", "bj"], exact, FOUND)
    own = summed(pairs, classes.select("set_key", "node", "first", "n"))
    joined = signed.select("doc_id", "set_key").join(own, "set_key", "left")
    return joined.select(
        "doc_id", F.coalesce("first", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(df: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component: that with the smallest key, among equal keys that with the smallest digest of
    its text. Rows with a null key and texts without words stay; a key may repeat, with the same text or others. Columns
    are those of df, whatever their names."""
    none, rows = df.where(F.col(key).isNull()), df.where(F.col(key).isNotNull())
    mark = fresh(df, "_row")
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        verdict = checkpoint(near_duplicates(rows, least, key, text).where("kept").select(F.col("doc_id").alias(mark)))
        return rows.join(verdict, rows[key] == verdict[mark], "left_semi").unionByName(none)
    # keys that repeat don't tell rows apart: rows get numbers of their own
    rows = checkpoint(rows.withColumn(mark, F.monotonically_increasing_id()))
    verdict = near_duplicates(rows, least, mark, text).select(F.col("doc_id").alias(mark), F.col("component_id").alias("component"))
    digests = rows.select(mark, F.struct(F.col(key).alias("key"), F.sha2(text, 256).alias("digest"), F.col(mark).alias("row")).alias("m"))
    kept = verdict.join(digests, mark).groupBy("component").agg(F.min("m").alias("m")).select(F.col("m.row").alias(mark))
    return rows.join(kept, mark, "left_semi").drop(mark).select(*df.columns).unionByName(none)
