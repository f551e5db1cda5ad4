"""Hierarchical multi-length packing (operator 7).

Documents are routed to tiers of context sizes (powers of two up to the longest). A document longer than the longest
tier fills windows of its own; what is left goes to the smallest tier that holds it. Within a tier windows take the
largest piece that fits; a gap that no whole piece of this or a shorter tier fits is filled by cutting a piece. What
fills no window is carried to the next batch of the partition; at its end it is cut at powers of two, which need no
padding. Each partition packs its own documents: no shuffle, and memory bounded by one batch.
"""

from __future__ import annotations

import itertools
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.bpe import byte_table
from loglattice.llm.common import held_by_worker, slices, strings

TIERS = (256, 512, 1024, 2048, 4096)
END = 2
#: A step group holds so many tokens, whatever the size of its windows.
STEP_TOKENS = 65_536
#: Runs whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000


class WordIds:
    """Ids of texts by a tokenizer file whose splitter never matches white space. The library encodes each different
    run between white space once; the ids of a text are those of its runs, one after the other."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the library finds these before it lower-cases and splits: texts that hold one are left to it as a whole
        self.added = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        # the same model for what needs neither normaliser nor splitter: words whose bytes are mapped already
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.table = byte_table()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.tok.get_vocab_size())])
        self.marks = {m: self.whole(m) for m in ",."}
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def learn(self, runs: list[str]) -> None:
        """A run of letters, or of letters and one comma or stop, is one match or two: its word is encoded with many
        others in one call, and told from them by the id that ends it. All other runs go to the library, each by itself."""
        words, plain, own, rest = {}, [], [], []
        for r in runs:
            w = r[:-1] if r[-1] in self.marks else r
            ascii_ = w.isascii()
            # runs are lower-cased, but not all that the library would change
            if w.isalpha() and (w.islower() if ascii_ else is_normalized("NFC", w) and w.lower() == w):
                plain.append(r)
                own.append(w)
                if w not in self.words:
                    words[w] = w if ascii_ else "".join(map(self.table.__getitem__, w.encode()))
            else:
                rest.append(r)
        names = list(words)
        for i in range(0, len(names), 5000):
            part = names[i : i + 5000]
            ids = np.array(self.plain.encode(" ".join(map(words.__getitem__, part)), add_special_tokens=False).ids, np.uint32)
            at = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            self.words.update((w, data[a:b]) for w, a, b in zip(part, at[:-1], at[1:], strict=True))
        known, of = self.known, self.words
        for r, w in zip(plain, own, strict=True):
            known[r] = of[w] if len(w) == len(r) else of[w] + self.marks[r[-1]]
        for i in range(0, len(rest), 1000):
            part = rest[i : i + 1000]
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each hold memory of their own
            got = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            data, at = np.fromiter(itertools.chain.from_iterable(got), np.uint32).tobytes(), list(itertools.accumulate((4 * len(g) for g in got), initial=0))
            known.update((r, data[a:b]) for r, a, b in zip(part, at[:-1], at[1:], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # str.split() also splits at four separators that the library keeps; Python lower-cases sigma by its place
        lower = [t.lower() for t in texts]
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") or any(a in t for a in self.added) for t in lower]
        # runs are numbered and their ids joined by Arrow, so that Python sees each run of these texts once
        split = pc.utf8_split_whitespace(pa.array(["" if o else t if "Σ" in t else w for t, w, o in zip(texts, lower, odd, strict=True)], pa.large_string()))
        coded = split.values.dictionary_encode()
        runs = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
            self.words.clear()
        self.learn([r for r in runs if r not in self.known])
        made = pa.array(list(map(self.known.__getitem__, runs)), pa.large_binary()).take(coded.indices)
        ends, data = np.frombuffer(made.buffers()[1], np.int64, len(made) + 1), memoryview(made.buffers()[2] or b"")
        cuts, end = ends[split.offsets.to_numpy()].tolist(), np.array([END], np.uint32).tobytes()
        return [np.frombuffer((self.whole(t) if o else bytes(data[a:b])) + end, np.uint32) for a, b, t, o in zip(cuts[:-1], cuts[1:], texts, odd, strict=True)]


@held_by_worker
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Packs (document, start, length) pieces into windows; emit(pieces, size) gets each closed window."""

    def __init__(self, tiers: tuple[int, ...], emit):
        self.tiers, self.emit, self.longest = tiers, emit, tiers[-1]
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), sorted

    def add(self, doc: int, length: int) -> None:
        whole = length // self.longest
        for i in range(whole):
            self.emit([(doc, i * self.longest, self.longest)], self.longest)
        if length % self.longest:
            self.pool.append((length % self.longest, doc, whole * self.longest))

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def pack(self) -> None:
        """Close every window that can be filled; the rest stays in the pool."""
        pool = self.pool
        pool.sort()
        total = sum(x[0] for x in pool)
        while pool:
            size = self.tier(pool[-1][0])
            if total < size:
                break
            gap, pieces = size, []
            while gap:
                k = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if k >= 0:
                    n, doc, start = pool.pop(k)
                else:  # every piece is larger than the gap: cut the shortest
                    n, doc, start = pool.pop(0)
                    insort(pool, (n - gap, doc, start + gap))
                    n = gap
                pieces.append((doc, start, n))
                gap -= n
            total -= size
            self.emit(pieces, size)

    def finish(self) -> None:
        """Cut what is left at powers of two."""
        self.pack()
        left = sum(x[0] for x in self.pool)
        while self.pool:
            size = 1 << (left.bit_length() - 1)
            gap, pieces = size, []
            while gap:
                n, doc, start = self.pool.pop()
                if n > gap:
                    self.pool.append((n - gap, doc, start + gap))
                    n = gap
                pieces.append((doc, start, n))
                gap -= n
            left -= size
            self.emit(pieces, size)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context (window size),
    step_group. A null text is empty and packs its end id alone; a null key stays null; repeated rows are packed each.
    An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = word_ids(path), TaskContext.get().partitionId()
        docs: dict[int, tuple[object, np.ndarray]] = {}
        made, steps, rows = 0, {}, []

        def emit(pieces: list[tuple[int, int, int]], size: int) -> None:
            nonlocal made
            tokens = steps.get(size, 0)
            steps[size] = tokens + size
            group = (part << 33) | ((tokens // STEP_TOKENS) << 13) | size
            at = 0
            for doc, start, n in pieces:
                name, ids = docs[doc]
                rows.append((name, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), (part << 33) | made, at, size, group))
                at += n
            made += 1

        def flush() -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            live = {x[1] for x in packer.pool}
            for d in [d for d in docs if d not in live]:
                del docs[d]
            return out

        packer, count = Packer(tiers, emit), 0
        for batch in slices(batches, text):
            for name, ids in zip(batch.column(key).to_pylist(), enc.encode(strings(batch, text)), strict=True):
                docs[count] = (name, ids)
                packer.add(count, len(ids))
                count += 1
            packer.pack()
            if rows:
                yield flush()
        packer.finish()
        if rows:
            yield flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group"]
    schema = ", ".join(f"`{n}` {'int' if n == 'context' else 'long'}" for n in names)
    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, schema)
