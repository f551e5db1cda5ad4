"""License scan by ordered signature rules (operator 3).

Signatures (signatures.py) are regular expressions over a text's words joined by single spaces. One is tried only if the
text has its keywords. Detections are intervals of words; one that lies within an interval of a rule of higher priority,
or of equal priority and greater length, is suppressed. Time grows with the text and with n log n of its detections.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import map_arrow, strings
from loglattice.llm.signatures import BASE, rules

#: All bytes but digits, letters and those beyond ASCII separate words; A-Z are lower-cased.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@lru_cache(1)
def compiled():
    out = [(re.compile(b"(?<= )(?:%b)(?= )" % r.pattern.encode()).finditer, [frozenset(w.encode() for w in k) for k in r.keywords]) for r in rules()]
    return out, frozenset(w for _, keys in out for k in keys for w in k)


@lru_cache(1)
def base_phrases():
    return [(label, re.compile(b"(?<= )%b(?= )" % phrase.encode()).finditer) for phrase, label in BASE.items()]


class Detections(NamedTuple):
    """Intervals of words, and the number of the rule that found each."""

    start: np.ndarray
    end: np.ndarray
    rule: np.ndarray


NONE = Detections(*(np.zeros(0, np.int64),) * 3)


def resolve(found: Detections, priority: np.ndarray) -> Detections:
    """Without each interval that lies within one of higher priority, or of equal priority and greater length, or of
    both equal and found by an earlier rule. What suppresses need not stand itself: what suppresses it lies around both."""
    falling = -priority[found.rule]
    kept, starts, reach = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for level in np.unique(falling):
        at = np.flatnonzero(falling == level)
        at = at[np.lexsort((found.rule[at], -found.end[at], found.start[at]))]
        # within a level, what begins no later and reaches at least as far stands before
        far = np.maximum.accumulate(found.end[at])
        ok = np.r_[True, far[:-1] < found.end[at][1:]]
        if len(starts):
            k = np.searchsorted(starts, found.start[at], side="right") - 1
            ok &= np.where(k >= 0, reach[np.maximum(k, 0)], -1) < found.end[at]
        at = at[ok]
        kept.append(at)
        all_starts, all_ends = np.concatenate([starts, found.start[at]]), np.concatenate([reach, found.end[at]])
        order = np.argsort(all_starts, kind="stable")
        starts, reach = all_starts[order], np.maximum.accumulate(all_ends[order])
    at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    at = at[np.lexsort((found.end[at], found.start[at]))]
    return Detections(found.start[at], found.end[at], found.rule[at])


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORD).split()


def scan(text: str) -> tuple[int, np.ndarray, list[str], Detections]:
    """Number of words, starts of base phrases, their labels, and the detections that stand."""
    got = words(text)
    table, keys = compiled()
    present = keys.intersection(got)
    if not present:
        return len(got), NONE.start, [], NONE
    joined = b" " + b" ".join(got) + b" "
    begins = None

    def spans(find) -> np.ndarray:
        """Intervals of words of all matches, as (start, end) rows."""
        nonlocal begins
        at = np.array([m.span() for m in find(joined)], np.int64).reshape(-1, 2)
        if len(at) and begins is None:
            begins = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1
        return np.searchsorted(begins, at) if len(at) else at

    starts, ends, which = [], [], []
    for n, (find, some) in enumerate(table):
        if any(k <= present for k in some):
            at = spans(find)
            if len(at):
                starts.append(at[:, 0])
                ends.append(at[:, 1])
                which.append(np.full(len(at), n))
    places, labels = [], []
    for label, find in base_phrases():
        at = spans(find)
        if len(at):
            places.append(at[:, 0])
            labels.append(label)
    found = resolve(Detections(np.concatenate(starts), np.concatenate(ends), np.concatenate(which)), np.array([r.priority for r in rules()])) if starts else NONE
    return len(got), np.concatenate(places) if places else NONE.start, labels, found


def licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    detections as (start, end, label, confidence) in words. score is the largest confidence of a detection or 0.
    A null or empty text has no words and no labels; a null key stays null; repeated rows are scanned each; an empty table
    gives no rows; other columns are left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [scan(t) for t in strings(batch, text)]
        known = rules()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))
        kinds = [np.unique(d.rule).tolist() for *_, d in got]
        columns = [
            batch.column(key),
            pa.array([n for n, *_ in got], pa.int64()),
            pa.array([len(p) for _, p, *_ in got], pa.int64()),
            pa.array([int(p.min()) if len(p) else None for _, p, *_ in got], pa.int64()),
            pa.array([int(p.max()) if len(p) else None for _, p, *_ in got], pa.int64()),
            pa.array([",".join(sorted(b)) for _, _, b, _ in got], pa.string()),
            pa.array([",".join(sorted({*b, *(known[k].label for k in ks)})) for (_, _, b, _), ks in zip(got, kinds, strict=True)], pa.string()),
            pa.array([max([known[k].confidence for k in ks] + [0.9] * bool(b), default=0.0) for (_, _, b, _), ks in zip(got, kinds, strict=True)], pa.float64()),
            pa.array([[{"start": a, "end": e, "label": known[k].label, "confidence": known[k].confidence} for a, e, k in zip(*(x.tolist() for x in d), strict=True)] for *_, d in got], spans),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,confidence:double>>"
    return map_arrow(df.select(F.col(key).cast("long").alias(key), text), run, schema, text)
