"""Byte-level BPE encoding and decoding with the tokenizers library (operator 10).

A rank file gives each token's bytes. The library works on characters, so every byte is written as one printable
character (the byte table); merges are recovered from the ranks. A text is split by a pattern, each match is encoded by
itself. Matches repeat, so those of an Arrow batch are encoded once and the ids are looked up. Ids of a batch lie one
after the other as whole numbers of 32 bits; their bytes and decimals are taken from tables of all tokens.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import held_by_worker, map_arrow, strings

#: Matches whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            token, _, rank = line.strip().partition(b" ")
            if token:
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def split_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that makes token: merge by rank, below the token's own rank, until two parts are left."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(itertools.pairwise(parts))), default=(limit, 0))
        if best[0] >= limit:
            return None
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.ranks = load_ranks(path)
        self.table = byte_table()
        self.back = {c: b for b, c in enumerate(self.table)}
        self.find = regex.compile(pattern).findall
        self.iter = regex.compile(pattern).finditer
        chars = lambda token: "".join(self.table[b] for b in token)
        merges = [(chars(pair[0]), chars(pair[1])) for token, _ in sorted(self.ranks.items(), key=lambda x: x[1]) if len(token) > 1 and (pair := split_of(token, self.ranks))]
        self.model = Tokenizer(models.BPE(vocab={chars(t): i for t, i in self.ranks.items()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.bytes_of = dict((i, bytes(self.back[c] for c in chars(t))) for t, i in self.ranks.items())
        every = range(max(self.bytes_of, default=-1) + 1)
        self.tokens = pa.array([self.bytes_of.get(i) for i in every], pa.binary())
        self.decimals = pa.array([b"%d," % i for i in every], pa.binary())
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces, each by itself: many in one call, joined by spaces (the byte table has none) and told apart
        by the word that each id is of."""
        for i in range(0, len(pieces), 4000):
            part = pieces[i : i + 4000]
            mapped = ["".join(map(self.table.__getitem__, p.encode())) for p in part]
            got = self.model.encode(" ".join(mapped), add_special_tokens=False)
            at = (4 * np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            ids = np.array(got.ids, np.int32).tobytes()
            self.known.update((p, ids[a:b]) for p, a, b in zip(part, at[:-1], at[1:], strict=True))

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and the last one's end."""
        split = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn([p for p in set(itertools.chain.from_iterable(split)) if p not in self.known])
        known = self.known.__getitem__
        made = [b"".join(map(known, s)) for s in split]
        return np.frombuffer(b"".join(made), np.int32), np.cumsum([0, *(len(m) // 4 for m in made)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, cuts = self.encoded(texts)
        return [ids[a:b].tolist() for a, b in itertools.pairwise(cuts.tolist())]

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Of each id the characters it touches, as (start, end). Ids that split a character share it. Texts and
        ids must belong together; text outside of all matches has no id."""
        starts, at = [], []
        for m in self.iter(text):
            for k, c in enumerate(m.group(), m.start()):
                n = len(c.encode())
                starts += [k] * n
        pos = 0
        for i in ids:
            n = len(self.bytes_of[i])
            at.append((starts[pos], starts[pos + n - 1] + 1))
            pos += n
        return at

    def spelled(self, table: pa.BinaryArray, ids: np.ndarray, cuts: np.ndarray) -> list[memoryview]:
        """What a table holds for the ids, joined for each text. An id without a token is an error, as in decode_bytes."""
        got = table.take(pa.array(ids))
        if got.null_count:
            raise KeyError(int(ids[got.is_null().to_numpy(zero_copy_only=False)][0]))
        data, ends = memoryview(got.buffers()[2] or b""), np.frombuffer(got.buffers()[1], np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
        return [data[a:b] for a, b in itertools.pairwise(ends[cuts].tolist())]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Characters whose bytes are split over ids come back whole; bytes that end in the middle of a character
        become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@held_by_worker
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """df with an array of token ids, and if asked of offsets. A null text counts as empty: an empty array. Any
    other columns are carried; a column named as an output is replaced."""
    src = df.drop(*[c for c in (ids, offsets) if c and c in df.columns])
    names = [*src.columns, ids, *([offsets] if offsets else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, texts = codec(path, pattern), strings(batch, text)
        got = c.encode(texts)
        arrays = [*batch.columns, pa.array(got, pa.list_(pa.int32()))]
        if offsets:
            at = [c.offsets(t, i) for t, i in zip(texts, got, strict=True)]
            arrays.append(pa.array([[{"start": a, "end": b} for a, b in x] for x in at], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields) + f", `{ids}` array<int>" + (f", `{offsets}` array<struct<start:int,end:int>>" if offsets else "")
    return map_arrow(src, run, schema, text)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text of an array of ids; a null array gives the empty text."""
    src = df.drop(text) if text in df.columns else df
    names = [*src.columns, text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        got = pa.array([c.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, got], names=names)

    return map_arrow(src, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields) + f", `{text}` string")


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, sha256 of the ids and of the decoded bytes. Encodes, then decodes the ids, batch by
    batch, so that no list of ids leaves its worker. Nulls: a null text is empty, a null key stays null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        ids, cuts = c.encoded(strings(batch, text))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(key),
                pa.array(np.diff(cuts), pa.int64()),
                pa.array([sha(x[:-1]) for x in c.spelled(c.decimals, ids, cuts)], pa.string()),
                pa.array([sha(x) for x in c.spelled(c.tokens, ids, cuts)], pa.string()),
            ],
            names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(df.select(F.col(key).cast("long").alias(key), text), run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string", text)
