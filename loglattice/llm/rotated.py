"""Embedding near-duplicates by randomised-rotation binary codes (operator 1).

A vector of unit length is rotated at random; the signs are its code, and the inner product of the vector with its code
is stored to correct estimates. The other vector of a pair is rounded at random to a few bits a component, so that an
estimate is a sum of bit counts and stays unbiased. An estimate has a bound; only pairs whose bound reaches the threshold
are computed again in double precision. Vectors are compared in blocks within their label by codes alone; vectors
themselves travel only for rows that some pair of a block leaves undecided. Equal vectors are one class with a weight, so
copies cost nothing, however many there are. The bound holds at SIGMAS standard errors, which is not a proof: a pair
beyond it would be lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import block_pairs, map_arrow, sorted_groups, written
from loglattice.llm.links import FOUND, found, numbered, summed

BLOCK = 2048
#: Half-width of the confidence interval in units of the estimate's standard error: beyond it lies less than one pair
#: in a hundred million.
SIGMAS = 6.0
#: Bits to which a component of a rotated vector is rounded.
PLANES = 6


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words; bits beyond the row's end are 0."""
    packed = np.packbits(bits, axis=-1)
    full = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), np.uint8)
    full[..., : packed.shape[-1]] = packed
    return full.view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: its code (signs of the rotated unit vector) in words, its inner product with its code, the rotated
    vector rounded to PLANES bits a component, as words by plane, and its least component and step. Rounding goes up with
    the probability of the remainder, by a hash of the vector, so that it is right on average and always the same."""
    turned = unit(vectors) @ rotation(vectors.shape[1]).T
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-30)
    seeds = np.abs(turned * 1e9).sum(1, keepdims=True) + np.arange(vectors.shape[1]) * 0.6180339887498949
    level = np.floor((turned - low) / step + (np.sin(seeds * 12.9898) * 43758.5453) % 1.0).astype(np.int64).clip(0, (1 << PLANES) - 1)
    planes = words((level[:, None, :] >> np.arange(PLANES)[None, :, None]) & 1 > 0)
    return words(turned > 0), np.abs(turned).sum(1) / np.sqrt(vectors.shape[1]), planes, np.concatenate([low, step], 1)


def estimates(codes: np.ndarray, factors: np.ndarray, planes: np.ndarray, scale: np.ndarray, dim: int) -> np.ndarray:
    """Estimated cosine of each code with each rounded vector, by bit counts: with signs s and levels v = low + step * l, the
    sum of s * v is that over positive signs, twice, less that over all."""
    ones = np.bitwise_count(codes).sum(1).astype(np.float32)
    weights = (1 << np.arange(PLANES)).astype(np.float32)
    whole = np.bitwise_count(planes).sum(2) @ weights
    got = np.zeros((len(codes), len(planes)), np.float32)
    for j in range(PLANES):
        count = np.zeros((len(codes), len(planes)), np.uint16)
        for w in range(codes.shape[1]):
            count += np.bitwise_count(codes[:, w, None] & planes[None, :, j, w])
        got += count * weights[j]
    low, step = scale.T.astype(np.float32)
    total = low * (2 * ones[:, None] - dim) + step * (2 * got - whole)
    return total / (np.sqrt(dim) * factors[:, None]).astype(np.float32)


def errors(factors: np.ndarray, steps: np.ndarray, dim: int) -> np.ndarray:
    """Standard error of each code's estimates with each vector: what the code leaves out, and what rounding adds, which is
    at most half a step a component."""
    left = np.maximum(0, 1 - factors**2) / factors**2 / max(1, dim - 1)
    return np.sqrt(left[:, None] + (steps[None, :] / 2 / factors[:, None]) ** 2)


def undecided(codes, factors, planes, scale, dim: int, left: np.ndarray, right: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in left, in right) whose estimate may reach the threshold; with `same`, left is right and each pair
    comes once. Each pair is estimated from either side and must pass both."""
    one = estimates(codes[left], factors[left], planes[right], scale[right], dim) + SIGMAS * errors(factors[left], scale[right, 1], dim) >= least - 1e-5
    if same:
        maybe = np.triu(one & one.T, 1)
    else:
        maybe = one & (estimates(codes[right], factors[right], planes[left], scale[left], dim) + SIGMAS * errors(factors[right], scale[left, 1], dim) >= least - 1e-5).T
    return np.nonzero(maybe)


def exact(vectors: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of each pair of rows reaches the threshold, in double precision."""
    norms = np.linalg.norm(vectors, axis=1)
    out = [np.zeros(0, bool)]
    for i in range(0, len(a), 100_000):
        x, y = a[i : i + 100_000], b[i : i + 100_000]
        out.append(np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norms[x] * norms[y]) >= least)
    return np.concatenate(out)


CODED = "label string, dim int, node long, code binary, factor double, planes binary, low double, step double"


def near_duplicates(df: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept. Links join rows of equal, not null labels and equal
    dimension with cosine >= least. Null, empty or zero vectors, vectors with null or non-finite components, and rows
    with a null label or key link with nothing and are components of their own. Repeated rows link with each other;
    different vectors of one id are told apart, and each of their rows has its own links. Ties: a component's id is the
    smallest id in it. An empty table gives no rows; other columns are left out."""
    x = F.col("_v")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"), F.col(label).alias("_label"))
    sound = F.coalesce(x.isNotNull() & F.col("_label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0), F.lit(False))
    good = rows.where(sound).withColumn("_label", F.to_json(F.struct("_label")))
    classes = numbered(good.groupBy("_label", "_v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")))

    def add_codes(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = batch.column("_v").to_pylist()
        sizes = np.array([len(v) for v in vectors])
        out: list = [None] * len(vectors)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            for i, c, f, p, (low, step) in zip(at, *encode(scaled(np.array([vectors[i] for i in at]))), strict=True):
                out[i] = c.tobytes(), f, p.tobytes(), low, step
        code, factor, planes, low, step = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(sizes, pa.int32()), batch.column("node"), pa.array(code, pa.binary()), pa.array(factor), pa.array(planes, pa.binary()), pa.array(low), pa.array(step)], names=[f.split()[0] for f in CODED.split(", ")])

    coded = written(map_arrow(classes.select("_label", "_v", "node"), add_codes, CODED))

    def arrays(g: dict) -> tuple:
        n = len(g["node"])
        codes = np.frombuffer(b"".join(g["code"]), np.uint64).reshape(n, -1)
        planes = np.frombuffer(b"".join(g["planes"]), np.uint64).reshape(n, PLANES, -1)
        side = np.asarray(g["side"])
        return codes, np.asarray(g["factor"]), planes, np.stack([g["low"], g["step"]], 1), int(g["dim"][0]), np.flatnonzero(side != 1), np.flatnonzero(side != 0), least, g["bi"][0] == g["bj"][0]

    def open_rows(g: dict) -> pa.RecordBatch | None:
        """Rows that some pair of these two blocks leaves undecided."""
        *coded, left, right, least, same = arrays(g)
        if not len(left) or not len(right):
            return None
        a, b = undecided(*coded, left, right, least, same)
        at = np.unique(np.concatenate([left[a], right[b]]))
        names = ["label", "dim", "bi", "bj", "side", "node"]
        return pa.RecordBatch.from_arrays([pa.array([g["label"][0]] * len(at), pa.string()), pa.array([g["dim"][0]] * len(at), pa.int32()), *(pa.array(np.asarray(g[c])[at].astype(np.int64 if c == "node" else np.int32)) for c in names[2:])], names=names) if len(at) else None

    by = ["label", "dim", "bi", "bj"]
    open_ = written(sorted_groups(block_pairs(coded, ["label", "dim"], "node", BLOCK), by, open_rows, "label string, dim int, bi int, bj int, side int, node long"))
    # vectors of what is undecided
    needed = open_.join(coded.drop("label", "dim"), "node").join(classes.select("node", "n", F.col("_v").alias("vector")), "node")

    def kernel(g: dict) -> pa.RecordBatch | None:
        vectors = scaled(np.array([np.asarray(v) for v in g["vector"]]))
        *coded, left, right, least, same = arrays(g)
        a, b = undecided(*coded, left, right, least, same)
        a, b = left[a], right[b]
        hit = exact(vectors, a, b, least)
        return found(np.asarray(g["node"]), np.asarray(g["n"], float), a[hit], b[hit])

    own = summed(sorted_groups(needed, by, kernel, FOUND), classes)
    joined = good.join(own, ["_label", "_v"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector divided by its largest component, so that squares neither overflow nor vanish."""
    return vectors / np.abs(vectors).max(1, keepdims=True)
