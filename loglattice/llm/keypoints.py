"""Local image descriptors (operator 4).

Corners are found at several scales, turned to the direction of their patch's centre of brightness and described by
binary tests. Tables hold each descriptor together with one that stands beside it: a part of the bits of both and how
the two lie to each other. All entries of a bucket of a table whose other bits are close as well are candidates, and
each candidate is verified: matching descriptors of the two images must agree on one turn, scale and shift. Verified
pairs join images to clusters, and within a cluster every pair is verified, in blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm import votes
from loglattice.llm.common import block_pairs, components, map_arrow, sorted_groups, swept, written
from loglattice.llm.links import FOUND, found, summed

#: Each level of the pyramid is smaller by this factor: a copy of any size between has its features on some level.
LEVELS, FACTOR = 7, 1.2
#: The strongest corners of a level that are described, and the patch around each.
CORNERS, RADIUS = 24, 12
#: Bits of a descriptor, bytes of a descriptor that are a table's key, and tables of each neighbour.
BITS, KEY, TABLES = 128, 2, 2
#: Descriptors beside each, out of its patch and out of each other's, and steps of a circle for how they lie.
BESIDE, STEPS = 2, 8
#: Bytes of both descriptors that are compared within a bucket, and how many of their bits may differ.
COMPARED, MEET = 4, 12
#: Entries of a bucket that are compared in one piece, and pairs that a task gathers before it passes them on.
LARGE, HELD = 1024, 1_000_000
#: Images whose features stand together when candidates are verified: at most, and so few only for more tasks. Copies of
#: all features that lie on disk at once, if there are more images than that.
TOGETHER, FEW, COPIES = 16_384, 4096, 4
#: Descriptors that are compared in one piece, small enough for a processor's cache, and matches that vote at once.
CACHED, VOTES = 65_536, 1 << 13
#: Images whose places are numbered at once, and those of a cluster that stand together in a block.
IMAGES, CLUSTER_BLOCK = 1024, 256
#: Rows of an Arrow batch that is passed on.
PASSED = 1 << 16
#: Different bits of descriptors that match in verification.
MATCH = 24
#: Places with a match that must agree on a transform, and the pixels that are one place.
CONSENSUS, SPOT = 9, 8.0
BLOCK = 64
#: Width of the consensus cells: a turn in steps of a circle's part, a change of scale in levels, a shift in pixels.
TURNS, LEVELS_WIDE, SHIFT = 12, 2, 12.0
#: Places are kept as whole numbers: sixteenths of a pixel, and parts of a circle.
PLACE, CIRCLE, PLACE_BYTES = 16, 1 << 15, 8


def decode(data: bytes | None) -> np.ndarray | None:
    """Brightness of a binary PGM or PPM image; None for what isn't one."""
    gap = rb"(?:\s|#[^\n]*\n)+"
    m = re.match(rb"P([56])%b(\d{1,9})%b(\d{1,9})%b(\d{1,9})(?:#[^\n]*\n)?\s" % (gap, gap, gap), data or b"")
    if not m or not 0 < int(m[4]) < 1 << 16:
        return None
    channels, width, height, most = (1 if m[1] == b"5" else 3), int(m[2]), int(m[3]), int(m[4])
    kind = np.dtype(">u2" if most > 255 else np.uint8)
    size = width * height * channels
    if not size or len(data) - m.end() < size * kind.itemsize:
        return None
    pixels = np.frombuffer(data, kind, size, m.end()).reshape(height, width, channels).astype(np.float32)
    if most != 255:
        pixels *= 255 / most
    return pixels[:, :, 0] if channels == 1 else pixels @ np.array([0.299, 0.587, 0.114], np.float32)


def encode(image: np.ndarray) -> bytes:
    """A brightness array as binary PGM."""
    x = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.tobytes()


def smooth(x: np.ndarray) -> np.ndarray:
    """A binomial filter of five taps over the last two axes."""
    for axis in (-1, -2):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (2, 2)
        p = np.moveaxis(np.pad(x, pad, "edge"), axis, 0)
        n = x.shape[axis]
        x = np.moveaxis((p[:n] + p[4 : n + 4] + 4 * (p[1 : n + 1] + p[3 : n + 3]) + 6 * p[2 : n + 2]) / 16, 0, axis)
    return x


def resized(x: np.ndarray, factor: float) -> np.ndarray:
    """Smaller by the factor: smoothed and read between pixels."""
    h, w = int(x.shape[1] / factor), int(x.shape[2] / factor)
    ys, xs = np.arange(h) * factor, np.arange(w) * factor
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(x0 + 1, x.shape[2] - 1)
    fy, fx = (ys - y0).astype(np.float32)[:, None], (xs - x0).astype(np.float32)
    s = smooth(x)
    top = s[:, y0][:, :, x0] * (1 - fx) + s[:, y0][:, :, x1] * fx
    low = s[:, y1][:, :, x0] * (1 - fx) + s[:, y1][:, :, x1] * fx
    return top * (1 - fy) + low * fy


@lru_cache(1)
def tests() -> np.ndarray:
    """Pairs of places of the binary tests: (BITS, 2, 2)."""
    rng = np.random.default_rng(4)
    return np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7).astype(np.float32)


@lru_cache(1)
def disc() -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    inside = y * y + x * x <= RADIUS * RADIUS
    return y[inside], x[inside]


def corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, column) of the strongest local maxima of the corner response, at patches within the image."""
    n, h, w = x.shape
    if h <= 2 * RADIUS + 2 or w <= 2 * RADIUS + 2:
        return (np.zeros(0, int),) * 3
    dy, dx = np.gradient(x, axis=(1, 2))
    a, b, c = smooth(dx * dx), smooth(dy * dy), smooth(dx * dy)
    response = (a * b - c * c) / (a + b + 1e-3)
    core = response[:, RADIUS : h - RADIUS, RADIUS : w - RADIUS]
    peak = core > 1.0
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if i or j:
                near = response[:, RADIUS + i : h - RADIUS + i, RADIUS + j : w - RADIUS + j]
                peak &= core > near if (i, j) > (0, 0) else core >= near
    flat = np.where(peak, core, 0).reshape(n, -1)
    k = min(CORNERS, flat.shape[1])
    at = np.argpartition(-flat, k - 1, axis=1)[:, :k]
    image = np.repeat(np.arange(n), k)
    at = at.ravel()
    ok = flat[image, at] > 0
    image, at = image[ok], at[ok]
    return image, at // core.shape[2] + RADIUS, at % core.shape[2] + RADIUS


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one size: image number, (row, column, angle, scale) and packed bits of each feature."""
    owner, place, bits = [], [], []
    level, scale = images.astype(np.float32), 1.0
    for _ in range(LEVELS):
        i, y, x = corners(level)
        if len(i):
            s = smooth(level)
            oy, ox = disc()
            patch = s[i[:, None], y[:, None] + oy, x[:, None] + ox]
            angle = np.arctan2(patch @ oy.astype(np.float32), patch @ ox.astype(np.float32))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            t = tests()
            ty = np.rint(t[None, :, :, 0] * cos + t[None, :, :, 1] * sin).astype(int)
            tx = np.rint(t[None, :, :, 1] * cos - t[None, :, :, 0] * sin).astype(int)
            v = s[i[:, None, None], y[:, None, None] + ty, x[:, None, None] + tx]
            bits.append(np.packbits(v[:, :, 0] < v[:, :, 1], axis=1))
            owner.append(i)
            place.append(np.stack([y * scale, x * scale, angle, np.full(len(i), scale)], 1))
        if min(level.shape[1:]) / FACTOR <= 2 * RADIUS + 2:
            break
        level, scale = resized(level, FACTOR), scale * FACTOR
    if not owner:
        return np.zeros(0, int), np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(owner), np.concatenate(place), np.concatenate(bits)


def packed(places: np.ndarray) -> bytes:
    """(row, column, angle, level) of each feature as whole numbers of 16 bits."""
    out = np.stack([places[:, 0] * PLACE, places[:, 1] * PLACE, places[:, 2] / (2 * np.pi) * CIRCLE, np.log(places[:, 3]) / np.log(FACTOR)], 1)
    return np.rint(out).clip(-32768, 65535).astype(np.int64).astype(np.uint16).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """(row, column, angle, scale) of each feature."""
    raw = np.frombuffer(data, np.uint16).reshape(-1, 4)
    return np.stack([raw[:, 0] / PLACE, raw[:, 1] / PLACE, raw[:, 2].astype(np.int16) * (2 * np.pi / CIRCLE), FACTOR ** raw[:, 3].astype(float)], 1)


def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and in b of descriptors of which at most MATCH bits differ. Both have a row for each word of 64 bits."""
    n, m, found_at = a.shape[1], b.shape[1], [np.zeros(0, np.int64)]
    step = min(n, max(1, CACHED // max(1, m)))
    # memory of its own for what is made again and again: no pages are asked for meanwhile
    differ, some, count, hit = (np.empty((step, m), kind) for kind in (np.uint64, np.uint8, np.uint8, bool))
    for k in range(0, n, step):
        rows = min(step, n - k)
        d, s, c = differ[:rows], some[:rows], count[:rows]
        for word, (x, y) in enumerate(zip(a, b, strict=True)):
            np.bitwise_xor(x[k : k + rows, None], y, out=d)
            np.bitwise_count(d, out=s if word else c)
            if word:
                np.add(c, s, out=c)
        found_at.append(np.flatnonzero(np.less_equal(c, MATCH, out=hit[:rows])) + k * m)
    at = np.concatenate(found_at)
    first = at // max(1, m)
    return first, at - first * m


class Features:
    """Features of many images, one image after the other: whole numbers as they are stored, and of each feature the place
    that it votes for. Corners of several levels at one place are one voter."""

    def __init__(self, bits: np.ndarray, places: np.ndarray, sizes: np.ndarray):
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.code = np.ascontiguousarray(bits.view(np.uint64).T)
        self.row, self.column, angle, level = np.ascontiguousarray(places.T)
        self.angle, self.level = angle.view(np.int16), level.astype(np.int64)
        self.voter, self.voters, self.middle = np.zeros(len(places), np.uint8), np.zeros(len(sizes), np.int64), np.zeros((2, len(sizes)))
        for k in range(0, len(sizes), IMAGES):
            starts = self.starts[k : k + IMAGES + 1]
            own, image = slice(starts[0], starts[-1]), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            spot = [np.floor(x[own] / PLACE / SPOT).astype(np.int64) for x in (self.row, self.column)]
            values, at = np.unique((image << 40) | (spot[0] << 20) | spot[1], return_inverse=True)
            first = np.searchsorted(values >> 40, np.arange(len(starts)))
            self.voter[own], self.voters[k : k + IMAGES] = at - first[image], np.diff(first)
            for axis, x in enumerate((self.row, self.column)):
                # sums of sixteenths are exact in any order
                self.middle[axis, k : k + IMAGES] = np.bincount(image, x[own] / PLACE, len(starts) - 1) / np.maximum(1, np.diff(starts))

    def of(self, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the features of these images, and which of the images each is of."""
        sizes = self.starts[images + 1] - self.starts[images]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1]) + np.repeat(self.starts[images] - ends + sizes, sizes), np.repeat(np.arange(len(images)), sizes)


def voted(f: Features, left: np.ndarray, pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs have enough places that vote for one transform; x and y are the matching features of each pair, left the
    first image of each. A transform is a turn, a scale, and where the middle of the left image's features comes to lie,
    which depends least on small errors of turn and scale."""
    unit = 2 * np.pi / CIRCLE
    turn = f.angle.take(y) * unit - f.angle.take(x) * unit
    turns = turn / (2 * np.pi) * TURNS
    turned, stepped, scales = cells_of()
    x_level, y_level = f.level.take(x), f.level.take(y)
    steps, cells = y_level - x_level + LEVELS, pair * (TURNS * (LEVELS + 2))
    # each match votes in two neighbouring cells of every measure's shifted grid, so that none falls on an edge; a turn and
    # scale with too few matches can't have enough of them at one shift, and most end there
    live, some = [], np.zeros(len(x), bool)
    for grid, shift in enumerate((0.0, 0.5)):
        cell = cells + turned.take(np.floor(turns + shift).astype(np.int64) + TURNS) + stepped[grid].take(steps)
        at = np.flatnonzero((np.bincount(cell) >= CONSENSUS).take(cell))
        live.append((shift, at, cell[at]))
        some[at] = True
    used = np.flatnonzero(some)
    if not len(used):
        return used
    number = np.cumsum(some) - 1
    x, y, turn, of = x[used], y[used], turn[used], left.take(pair[used])
    scale = scales.take(y_level[used]) / scales.take(x_level[used])
    cos, sin = np.cos(turn) * scale, np.sin(turn) * scale
    oy, ox = f.row.take(x) / PLACE - f.middle[0].take(of), f.column.take(x) / PLACE - f.middle[1].take(of)
    dy = f.row.take(y) / PLACE - (oy * cos + ox * sin)
    dx = f.column.take(y) / PLACE - (ox * cos - oy * sin)
    voter, hits = f.voter.take(x).astype(np.int64), []
    for shift, at, cell in live:
        own = number[at]
        for d in (dy, dx):
            cell = cell << 11 | (np.floor(d[own] / SHIFT + shift).astype(np.int64) + 512) & 2047
        v = np.sort(cell << 8 | voter[own])
        cell = v[np.flatnonzero(np.diff(v, prepend=-1))] >> 8  # a place votes once in a cell
        last = cell[CONSENSUS - 1 :]
        hits.append(last[last == cell[: len(last)]] // (TURNS * (LEVELS + 2) << 22))
    return np.unique(np.concatenate(hits))


@lru_cache(1)
def cells_of() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For small whole numbers: a turn's cell from one circle below zero on, a difference of levels' cell without and with
    the shift of a grid, and a level's scale."""
    steps = np.arange(2 * LEVELS + 1)
    return np.arange(-TURNS, TURNS + 2) % TURNS * (LEVELS + 2), np.stack([np.floor(steps / LEVELS_WIDE + shift).astype(np.int64) for shift in (0.0, 0.5)]), FACTOR ** np.arange(LEVELS).astype(float)


def agreed(f: Features, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Positions of the pairs left[i]-right[i] whose matching features agree on one transform. An image is compared with many
    others at once, and matches of several images vote together."""
    # too few places can't agree on a transform
    able = np.flatnonzero(f.voters[left] >= CONSENSUS)
    able = able[np.argsort(left[able], kind="stable")]
    left, right = left[able], right[able]
    out, held, count, first = [np.zeros(0, np.int64)], [], 0, 0

    def vote(end: int) -> None:
        pair, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
        out.append(able[voted(f, left[first:end], pair - first, x, y) + first])
        held.clear()

    for begin, end in itertools.pairwise(np.flatnonzero(np.diff(left, prepend=-1, append=-1)).tolist()):
        own, after = f.starts[left[begin]], f.starts[left[begin] + 1]
        for k in range(begin, end, BLOCK):
            here = min(end, k + BLOCK)
            at, of = f.of(right[k:here])
            x, y = close(f.code[:, own:after], f.code[:, at])
            if not held:
                first = k
            held.append((of[y] + k, x + own, at[y]))
            count += len(x)
            if count > VOTES:
                vote(here)
                count = 0
    if held:
        vote(len(left))
    return np.concatenate(out)


def agreeing(bits: list[np.ndarray], places: list[np.ndarray], left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in left, position in right) of images that agree. A pair counts where the left image has the lower
    rank; which image comes first can decide a close case, so ranks must not depend on how rows are dealt."""
    f = Features(np.concatenate(bits), np.frombuffer(b"".join(map(packed, places)), np.uint16).reshape(-1, 4), np.array([len(b) for b in bits]))
    a, b = np.nonzero(rank[left][:, None] < rank[right])
    hit = agreed(f, left[a], right[b])
    return a[hit], b[hit]


def ranks(bits: list[bytes], places: list[bytes]) -> np.ndarray:
    """Of each image its place in the order of features."""
    out = np.empty(len(bits), np.int64)
    out[sorted(range(len(bits)), key=lambda i: (bits[i], places[i]))] = np.arange(len(bits))
    return out


def features(df: DataFrame, image: str, carried: list[str]) -> DataFrame:
    """df's carried columns with the digest of the image, its bits and places (packed) and n_features. No image, a broken or
    a featureless one has none; no image has no digest. Equal images of a batch are described once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(image).to_pylist()
        known: dict[bytes, int] = {}
        which = [None if x is None else known.setdefault(x, len(known)) for x in raw]
        n = len(known)
        bits, places, count = [b""] * n, [b""] * n, [0] * n
        decoded = [decode(x) for x in known]
        by: dict[tuple, list[int]] = {}
        for i, x in enumerate(decoded):
            if x is not None:
                by.setdefault(x.shape, []).append(i)
        for shape, at in by.items():
            step = max(1, 200_000 // (shape[0] * shape[1]))  # small enough for a processor's cache
            for k in range(0, len(at), step):
                part = at[k : k + step]
                owner, place, code = describe(np.stack([decoded[i] for i in part]))
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(part) + 1))
                for j, i in enumerate(part):
                    own = order[cuts[j] : cuts[j + 1]]
                    bits[i], places[i], count[i] = code[own].tobytes(), packed(place[own]), len(own)
        digests = [hashlib.sha256(x).digest() for x in known]
        of = lambda values, none, kind: pa.array([none if w is None else values[w] for w in which], kind)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), of(digests, None, pa.binary()), of(bits, b"", pa.binary()), of(places, b"", pa.binary()), of(count, 0, pa.int64())], names=[*carried, "hash", "bits", "places", "n_features"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return map_arrow(df.select(*carried, image), run, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", hash binary, bits binary, places binary, n_features long")


def entries(code: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table entries of one image: keys, which hold the table, and the bits to compare."""
    width, keys, rest = BITS // 8, [], []
    free = np.hypot(place[:, None, 0] - place[None, :, 0], place[:, None, 1] - place[None, :, 1])
    reach = RADIUS * place[:, 3]
    usable = (place[:, None, 3] == place[None, :, 3]) & (free >= reach[:, None])
    for r in range(BESIDE):
        own = np.flatnonzero(usable.any(1))
        if not len(own):
            break
        beside = np.where(usable, free, np.inf).argmin(1)
        near = beside[own]
        gap = place[near, :2] - place[own, :2]
        way = np.arctan2(gap[:, 0], gap[:, 1]) - place[own, 2]
        turn = place[near, 2] - place[own, 2]
        lie = np.stack([np.floor(x / (2 * np.pi) * STEPS) % STEPS for x in (way, turn)] + [np.rint(np.log2(free[own, near] / place[own, 3]))], 1).astype(np.uint8)
        for t in range(TABLES):
            at = (t * KEY + np.arange(KEY + COMPARED)) % width
            full = np.zeros((len(own), 16), np.uint8)
            full[:, :KEY], full[:, KEY : 2 * KEY], full[:, 2 * KEY : 2 * KEY + 3] = code[own][:, at[:KEY]], code[near][:, at[:KEY]], lie
            full[:, 12], full[:, 13] = r, t
            low, high = full.view(np.uint64).T
            h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            keys.append((h ^ (h >> np.uint64(29))).view(np.int64))
            rest.append(np.ascontiguousarray(np.concatenate([code[own][:, at[KEY:]], code[near][:, at[KEY:]]], 1)).view(np.int64).ravel())
        usable &= free[beside] >= reach[:, None]
    return (np.concatenate(keys), np.concatenate(rest)) if keys else (np.zeros(0, np.int64),) * 2


def met(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(a, b) of all entries of one bucket that are close and of different images; rows are (bucket, node, rest) by bucket
    and node, sizes those of the buckets."""
    end, at, step = np.repeat(np.cumsum(sizes), sizes), np.arange(rows.shape[1]), 1
    pairs = [np.zeros((2, 0), np.int64)]
    while len(at := at[at + step < end[at]]):
        x, y = rows[:, at], rows[:, at + step]
        ok = (np.bitwise_count(x[2] ^ y[2]) <= MEET) & (x[1] != y[1])
        pairs.append(np.stack([x[1, ok], y[1, ok]]))
        step += 1
    return np.concatenate(pairs, 1)


def candidates(described: DataFrame) -> DataFrame:
    """Pairs a < b of images that meet in a table, some more than once: all entries of a bucket are compared with each
    other. Small buckets in one pass over sorted rows, which hands on the rows of large ones; those are compared in blocks."""
    width = BITS // 8

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for raw, place in zip(batch.column("bits").to_pylist(), batch.column("places").to_pylist(), strict=True):
            made.append(entries(np.frombuffer(raw, np.uint8).reshape(-1, width), unpacked(place)))
        node = np.repeat(batch.column("node").to_numpy(), [len(k) for k, _ in made])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in made])) for i in (0, 1)] + [pa.array(node)], names=["bucket", "rest", "node"])

    def out(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, pairs.shape[1], PASSED):
            some = pairs[:, k : k + PASSED]
            none = pa.nulls(some.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in some), none, none, none], names=["a", "b", "bucket", "node", "rest"])

    def distinct(pairs: list[np.ndarray]) -> np.ndarray:
        p = np.concatenate(pairs, 1)
        p = p[:, np.lexsort(p[::-1])]
        return p[:, np.r_[True, (p[:, 1:] != p[:, :-1]).any(0)][: p.shape[1]]]

    def meet(batches):
        held, large = np.zeros((3, 0), np.int64), None
        pairs, count = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("bucket", "node", "rest")])], 1)
            if not held.shape[1]:
                continue
            starts = np.flatnonzero(np.r_[True, held[0, 1:] != held[0, :-1]])
            sizes = np.diff(np.r_[starts, held.shape[1]])
            on = (sizes > LARGE) | (held[0, starts] == large if large is not None else False)
            last = held[0, -1]
            # the last bucket may go on in the next batch
            wait = 0 if batch is None or on[-1] else int(sizes[-1])
            large = last if on[-1] else None
            done, held = held[:, : held.shape[1] - wait], held[:, held.shape[1] - wait :]
            rows_on = np.repeat(on, sizes)[: done.shape[1]]
            if rows_on.any():
                some = done[:, rows_on]
                none = pa.nulls(some.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x) for x in some)], names=["a", "b", "bucket", "node", "rest"])
            whole = sizes[: len(sizes) - (wait > 0)]
            pairs.append(met(done[:, ~rows_on], whole[~on[: len(whole)]]))
            count += pairs[-1].shape[1]
            if count > HELD:
                pairs = [distinct(pairs)]
                count = pairs[0].shape[1]
                if count > HELD // 2:
                    yield from out(pairs[0])
                    pairs, count = [], 0
        if pairs:
            yield from out(distinct(pairs))

    def blocks(g: dict) -> pa.RecordBatch | None:
        side, node, rest = np.asarray(g["side"]), np.asarray(g["node"]), np.asarray(g["rest"])
        left, right, pairs = np.flatnonzero(side != 1), np.flatnonzero(side != 0), []
        for i in left:
            j = right[right > i] if side[i] == 2 else right
            j = j[(np.bitwise_count(rest[j] ^ rest[i]) <= MEET) & (node[j] != node[i])]
            pairs.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]))
        if not pairs:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x) for x in distinct(pairs)], names=["a", "b"])

    keyed = map_arrow(described.select("node", "bits", "places"), spread, "bucket long, rest long, node long")
    parts = int(described.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows are in the order of their nodes within a bucket, so a < b
    got = written(keyed.repartition(parts, "bucket").sortWithinPartitions("bucket", "node").mapInArrow(meet, "a long, b long, bucket long, node long, rest long"))
    swept(described.sparkSession)
    hot = block_pairs(got.where(F.col("bucket").isNotNull()).select("bucket", "node", "rest"), ["bucket"], "node", LARGE)
    return got.where(F.col("bucket").isNull()).select("a", "b").union(written(sorted_groups(hot, ["bucket", "bi", "bj"], blocks, "a long, b long")))


def in_jvm(rows: DataFrame, clusters: bool, schema: str) -> DataFrame:
    """Rows of pairs or of clusters as `votes` judges them."""
    return votes.judged(rows, clusters, HELD, (MATCH, CONSENSUS, TURNS, LEVELS, LEVELS_WIDE, CIRCLE, PLACE, SPOT, SHIFT, FACTOR), schema)


def verified(pairs: DataFrame, described: DataFrame, jvm: bool = False) -> DataFrame:
    """The pairs a < b whose matching features agree on one transform. Images are dealt to blocks; pairs of two blocks
    meet the features of their images once, however many pairs an image has. Many images are verified in rounds, so that
    not all copies of their features are on disk at once; every pair is in one round. Pairs are judged by NumPy or in the JVM,
    which gives of the linked pairs of two blocks only those that join images that others haven't joined."""
    spark, width = described.sparkSession, BITS // 8
    parts, images = int(spark.conf.get("spark.sql.shuffle.partitions")), described.count()
    # enough pairs of blocks for all tasks, and small ones where there are many and Python holds them
    n = max(-(-images // TOGETHER), 0 if jvm else min(math.isqrt(12 * parts), -(-images // FEW)), math.isqrt(2 * parts) + 1)
    rounds = -(-n // COPIES) if images > TOGETHER else 1
    tasks = min(n * (n + 1) // 2, (1 if rounds == 1 else 8) * parts)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = pairs.select(F.least(of("a"), of("b")).alias("bi"), F.greatest(of("a"), of("b")).alias("bj"), "a", "b")
    needed = dealt.select("bi", "bj", F.explode(F.array("a", "b")).alias("node")).distinct().groupBy("node").agg(F.collect_list(F.struct("bi", "bj")).alias("blocks"))
    held = written(needed.join(described.select("node", "bits", "places"), "node"))
    swept(spark)

    def judged(pairs: np.ndarray, nodes: np.ndarray, f: Features, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = np.divmod(np.unique(pairs), len(nodes))
        hit = agreed(f, left, right)
        left, right = nodes[left[hit]], nodes[right[hit]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each two blocks, features come first and are held as they came; pairs are verified some at a time."""
        block, known, nodes, bits, places, pairs, count = None, None, [], [], [], [], 0
        for batch in batches:
            bi, bj, a, b = (batch.column(c).to_numpy() for c in ("bi", "bj", "a", "b"))
            cuts = np.flatnonzero((np.diff(bi) != 0) | (np.diff(bj) != 0) | np.diff(a == b)) + 1
            for begin, end in itertools.pairwise([0, *cuts.tolist(), len(a)] if len(a) else []):
                if block != (bi[begin], bj[begin]):
                    if pairs:
                        yield from judged(np.concatenate(pairs), *known)
                    block, known, nodes, bits, places, pairs, count = (bi[begin], bj[begin]), None, [], [], [], [], 0
                if a[begin] == b[begin]:
                    nodes.append(a[begin:end])
                    bits += batch.column("bits").slice(begin, end - begin).to_pylist()
                    places += batch.column("places").slice(begin, end - begin).to_pylist()
                    continue
                if known is None:
                    sizes = np.array([len(p) // PLACE_BYTES for p in places])
                    f = Features(np.frombuffer(b"".join(bits), np.uint8).reshape(-1, width), np.frombuffer(b"".join(places), np.uint16).reshape(-1, 4), sizes)
                    known = np.concatenate(nodes), f, ranks(bits, places)
                    bits, places = [], []
                    order = np.argsort(known[0])
                    ordered = known[0][order]
                left, right = (order[np.searchsorted(ordered, x[begin:end])] for x in (a, b))
                turned = known[2][left] > known[2][right]
                pairs.append(np.where(turned, right, left) * len(order) + np.where(turned, left, right))
                count += end - begin
                if count > HELD:
                    yield from judged(np.concatenate(pairs), *known)
                    pairs, count = [], 0
        if pairs:
            yield from judged(np.concatenate(pairs), *known)

    def part(number: int) -> DataFrame:
        own = (F.col("bi") + F.col("bj")) % rounds == number
        none = F.lit(None).cast("binary")
        # rows with features have a = b
        features_of = held.select(F.explode(F.filter("blocks", lambda at: (at["bi"] + at["bj"]) % rounds == number)).alias("at"), F.col("node").alias("a"), F.col("node").alias("b"), "bits", "places").select("at.bi", "at.bj", "a", "b", "bits", "places")
        rows = dealt.select("*", none.alias("bits"), none.alias("places")).unionByName(features_of).where(own)
        # a hash would deal several pairs of blocks to one task and none to others
        of_pair = (F.col("bj") * (F.col("bj") + 1) / 2 + F.col("bi")).cast("int") % tasks
        ordered = rows.repartitionById(tasks, of_pair).sortWithinPartitions("bi", "bj", F.col("bits").isNull())
        return in_jvm(ordered, False, "a long, b long") if jvm else ordered.mapInArrow(run, "a long, b long")

    if rounds == 1:
        return part(0)
    done = []
    for number in range(rounds):
        done.append(written(part(number)))
        swept(spark)
    return reduce(DataFrame.union, done)


def near_duplicates(df: DataFrame, key: str = "image_id", image: str = "image") -> DataFrame:
    """One row per row of df: image_id, n_features, n_links (other images it is a cropped, turned, resized or edited copy of),
    component_id (smallest id reachable), kept (image_id = component_id). Equal images are one class with a weight; different
    images of one id are told apart, and each of their rows has its own links. Null, broken and featureless images link with
    nothing, and so do rows with a null id. Ties: ids are the smallest ones. An empty table gives no rows; other columns are
    left out."""
    made = features(df.select(F.col(key).cast("long").alias("image_id"), F.col(image).alias("image")), "image", ["image_id"])
    # features are kept once: a class is described by the first of its rows, whose number is its node
    rows = written(made.withColumn("node", F.monotonically_increasing_id()))
    some = rows.where(F.col("image_id").isNotNull() & (F.col("n_features") > 0))
    classes = written(some.groupBy("hash").agg(F.min("image_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("node").alias("node")))
    more = written(some.select("hash", "node").join(classes.where("n > 1").select("hash", F.col("node").alias("_node")), "hash").where("node <> _node").select("node"))
    described, width = some.select("node", "bits", "places").join(more, "node", "left_anti"), BITS // 8
    jvm = votes.ready(df.sparkSession)
    linked = written(verified(candidates(described), described, jvm))
    swept(df.sparkSession)
    clusters = written(components(linked).join(classes.select("node", "n"), "node"))
    sets, parts = written(clusters.join(described, "node").select("component", "node", "n", "bits", "places")), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verify(g: dict) -> pa.RecordBatch | None:
        side = np.asarray(g["side"])
        bits = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in g["bits"]]
        places = [unpacked(x) for x in g["places"]]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return None
        rank = ranks(g["bits"], g["places"])
        a, b = agreeing(bits, places, left, right, rank)
        a, b = left[a], right[b]
        if g["bi"][0] != g["bj"][0]:
            c, d = agreeing(bits, places, right, left, rank)
            a, b = np.concatenate([a, right[c]]), np.concatenate([b, left[d]])
        return found(np.asarray(g["node"]), np.asarray(g["n"], float), a, b)

    blocks, keys = block_pairs(sets, ["component"], "node", CLUSTER_BLOCK), ["component", "bi", "bj"]
    if jvm:
        links = in_jvm(blocks.select(*keys, "side", "node", "n", "bits", "places").repartition(4 * parts, *keys).sortWithinPartitions(*keys), True, FOUND)
    else:
        links = sorted_groups(blocks, keys, verify, FOUND, 4 * parts)
    own = summed(links, classes.select("hash", "node", "first", "n"))
    keyed = rows.select("image_id", "n_features", F.when(F.col("image_id").isNotNull() & (F.col("n_features") > 0), F.col("hash")).alias("hash"))
    return (
        keyed.join(own, "hash", "left")
        .select("image_id", "n_features", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "image_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("image_id") == F.col("component_id"), F.lit(True)))
    )


def drawn(vector: Column, side: int = 8, cell: int = 10) -> Column:
    """An image for a vector, since no table has any: its components are brightness values of a grid of square cells,
    scaled to the vector's range and written as binary PGM. DataFrame functions only. Null for a null vector, for null
    or non-finite components and for fewer than side * side of them."""
    low, high = F.array_min(vector), F.array_max(vector)
    # a lambda evaluates what it refers to again for every element, except its own variable: a list of one holds a value
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    # 20 levels: vectors that differ little give images that differ little
    level = once(F.struct(low.alias("low"), high.alias("high")), lambda r: F.transform(F.slice(vector, 1, side * side), lambda v: F.format_string("%02x", F.round((v - r["low"]) / (r["high"] - r["low"]) * 19).cast("int") * 13)))
    rows = once(level, lambda level: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.repeat(F.array_join(F.transform(F.slice(level, r * side + 1, side), lambda x: F.repeat(x, cell)), ""), cell)))
    body = F.unhex(F.array_join(rows, ""))
    head = F.lit(f"P5 {side * cell} {side * cell} 255\n").cast("binary")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) >= side * side) & ~bad & (high > low), F.concat(head, body))
