"""Language ID by segmentation-marginalised unigrams (operator 9).

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, computed by a forward pass over its letters; a text's is the product over its words.
Training counts the pieces of each word's best segmentation by the public vocabulary, over a bounded sample of labelled
rows (TRAINING_ROWS); prediction sums over all segmentations. The model is bounded by vocabulary times languages.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import held_by_worker, map_arrow, slices, strings

UNDETERMINED = "und"
#: Pieces are at most so long; runs of letters over LONGEST are taken in parts.
PIECE, LONGEST = 12, 40
#: Each letter's factor in the forward pass: sums over words of LONGEST letters then neither vanish nor overflow, whether
#: all letters are unknown (1e-9 * 1e4 each) or all pieces likely (at most 1e4 each).
SCALE = 1e4
#: Added to each piece's count in each language, and the probability of a letter that no piece has.
SMOOTH, UNKNOWN = 0.05, 1e-9
REMEMBERED = 400_000
#: The classifier is fitted on about so many labelled rows at most.
TRAINING_ROWS = 50_000
START = "▁"
words_of = re.compile(r"[^\W\d_]+").findall


def words(text: str) -> list[str]:
    got = words_of(text.lower())
    if any(len(w) > LONGEST for w in got):
        got = [w[i : i + LONGEST] for w in got for i in range(0, len(w), LONGEST)]
    return got


@held_by_worker
def vocabulary(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return sp, pieces


def train(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAINING_ROWS) -> bytes:
    """The model, as bytes, from rows with a text and a language. The classifier is fitted on a bounded sample: about
    `rows` rows, chosen by a hash of the key; fewer are all taken. No such rows: a model without languages."""
    labelled = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    share = min(1.0, rows / max(1, labelled.count()))
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, pieces = vocabulary(path)
        counts: dict[tuple[str, str], float] = defaultdict(float)
        segmented: dict[str, list[int]] = {}
        for batch in slices(batches, text):
            by: dict[str, Counter] = defaultdict(Counter)
            for t, name in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), strict=True):
                by[name].update(words(t))
            for name, seen in by.items():
                new = [w for w in seen if w not in segmented]
                segmented.update(zip(new, sp.encode(new, num_threads=1) if new else [], strict=True))
                total = np.zeros(len(pieces))
                flat = [segmented[w] for w in seen]
                np.add.at(total, np.fromiter(itertools.chain.from_iterable(flat), np.int64), np.repeat(np.fromiter(seen.values(), float), [len(x) for x in flat]))
                for i in np.flatnonzero(total):
                    counts[name, pieces[i]] += total[i]
                letters: dict[str, int] = defaultdict(int)
                for w, n in seen.items():
                    for c in w:
                        letters[c] += n
                for c, n in letters.items():
                    counts[name, "\n" + c] += n
            if len(segmented) > REMEMBERED:
                segmented.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(counts.values(), pa.float64())], names=["lang", "item", "n"])

    got = labelled.select(F.col(text), F.col(lang).cast("string").alias(lang)).mapInArrow(run, "lang string, item string, n double").groupBy("lang", "item").agg(F.sum("n").alias("n")).toArrow()
    return build(zip(got["lang"].to_pylist(), got["item"].to_pylist(), got["n"].to_pylist(), strict=True))


def build(counts) -> bytes:
    """Model from (language, piece, count); items that begin with a new line count letters."""
    table: dict[str, Counter] = defaultdict(Counter)
    letters: dict[str, set] = defaultdict(set)
    for name, item, n in counts:
        if item.startswith("\n"):
            letters[name].add(item[1:])
            table[name][item[1:]] += 0  # a letter is always a piece
        elif all(c.isalpha() for c in item.removeprefix(START)) and len(item) <= PIECE:
            table[name][item.lower()] += n
    langs = sorted(letters)
    pieces = sorted({p for t in table.values() for p in t})
    probs = np.zeros((len(pieces) + 2, len(langs)))
    probs[1] = UNKNOWN
    for k, name in enumerate(langs):
        total = sum(table[name].values()) + SMOOTH * len(pieces)
        probs[2:, k] = [(table[name][p] + SMOOTH) / total for p in pieces]
    return pickle.dumps((langs, pieces, probs, [sorted(letters[name]) for name in langs]))


class Model:
    """Row 0 of the table: no such piece; row 1: a letter that no piece has."""

    def __init__(self, data: bytes):
        self.langs, pieces, self.probs, letters = pickle.loads(data)
        self.row = {p: i + 2 for i, p in enumerate(pieces)}
        self.letters = [frozenset(x) for x in letters]
        self.logs = np.zeros((0, len(self.langs)))
        self.known: dict[str, int] = {}

    def word_logs(self, group: list[str]) -> np.ndarray:
        """Log probability of words of one length in each language, summed over all segmentations."""
        n, get = len(group[0]) + 1, self.row.get
        spans = [(i, j) for i in range(n) for j in range(i + 1, min(i + PIECE, n) + 1)]
        rows = np.empty((len(spans), len(group)), np.int32)
        marked = [START + w for w in group]
        for k, (i, j) in enumerate(spans):
            none = 1 if j == i + 1 else 0
            rows[k] = [get(w[i:j], none) for w in marked]
        alpha = np.zeros((n + 1, len(group), len(self.langs)))
        alpha[0] = 1
        for k, (i, j) in enumerate(spans):
            hit = np.flatnonzero(rows[k])
            alpha[j, hit] += alpha[i, hit] * (self.probs[rows[k, hit]] * SCALE ** (j - i))
        return np.log(alpha[n]) - n * np.log(SCALE)

    def learn(self, new: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.logs = self.logs[:0]
        new = [w for w in new if w not in self.known]
        parts, by = [self.logs], defaultdict(list)
        for w in new:
            by[len(w)].append(w)
        for group in by.values():
            for a in range(0, len(group), 20_000):
                part = group[a : a + 20_000]
                base = len(self.known)
                self.known.update((w, base + i) for i, w in enumerate(part))
                parts.append(self.word_logs(part))
        self.logs = np.concatenate(parts)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text: the posterior under equal priors, times the share of its letters that
        training has seen in that language. No letter: und and 0. Equal posteriors: the first language by name."""
        split = [words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.logs = self.logs[:0]
        if self.langs:
            self.learn([*set(itertools.chain.from_iterable(split))])
        out = []
        for text, got in zip(texts, split, strict=True):
            if not got or not self.langs or not any(c.isalpha() for c in text):
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.logs[np.fromiter(map(self.known.__getitem__, got), np.int64, len(got))].sum(0)
            best = int(total.argmax())
            posterior = 1 / np.exp(np.maximum(total - total[best], -700)).sum()
            strange = set(text.lower()) - self.letters[best]
            letters = sum(map(len, got))
            missing = sum(got.count(c) if len(c) > 1 else sum(w.count(c) for w in got) for c in strange if c.isalpha())
            out.append((self.langs[best], float(posterior * (1 - missing / letters))))
        return out


@held_by_worker
def model(data: bytes) -> Model:
    return Model(data)


def predict(df: DataFrame, data: bytes, text: str = "text", lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """df with the language and its score; columns of these names are replaced. A null text gives und and 0."""
    src = df.drop(*[c for c in (lang, score) if c in df.columns])
    shared, names = df.sparkSession.sparkContext.broadcast(data), [*src.columns, lang, score]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = model(shared.value).predict(strings(batch, text))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields]
    return map_arrow(src, run, ", ".join([*fields, f"`{lang}` string", f"`{score}` double"]), text)


def accepted(lang: str = "lang_pred", score: str = "lang_score", least: float = 0.5) -> Column:
    """Whether a document has a language: some letters, mostly of a script that the language was seen in, and one
    language likelier than all others together."""
    return (F.col(lang) != UNDETERMINED) & (F.col(score) >= least)
