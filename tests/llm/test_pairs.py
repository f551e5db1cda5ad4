"""Operators on pairs against brute force."""

import random

import numpy as np
import pytest

from loglattice.llm import common, lshforest, rotated
from loglattice.llm.common import components
from loglattice.llm.licenses import words


def reachable(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    want = reachable(600, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_heavy_centres(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 5)
    monkeypatch.setattr(common, "HEAVY_SHARE", 0)
    rng = random.Random(4)
    pairs = [(rng.choice([0, 700, 701]), i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 430)] + [(700, 430), (701, 299)]
    want = reachable(702, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: want[x] for p in pairs for x in p}


def test_rotated_codes_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(rotated, "BLOCK", 40)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 64))
    x = np.concatenate([centres[rng.integers(30, size=300)] + rng.standard_normal((300, 64)) * rng.uniform(0, 0.4, (300, 1)), centres[:20], centres[:5] * 3]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    rows = [(i, [float(c) for c in v], int(k), "other") for i, (v, k) in enumerate(zip(x, label, strict=True))]
    n = len(rows)
    rows += [(n, None, 0, ""), (n + 1, [0.0] * 64, 0, ""), (n + 2, [float("nan")] + [1.0] * 63, 0, ""), (n + 3, rows[0][1], None, ""), (n + 4, [None] + [1.0] * 63, 1, ""), (n + 5, [], 1, ""), (n + 6, [1.0, 0.0], 1, ""), (None, rows[0][1], 0, "")]
    got = {r.vec_id: r for r in rotated.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = reachable(n, zip(*np.nonzero(link), strict=True))
    assert len(got) == len(rows)
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), want[i], want[i] == i)
    for i in range(n, n + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert link.sum() > 1000
    assert got[None].n_links == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    for dim in (64, 100, 7):
        a, b = rng.standard_normal((400, dim)), rng.standard_normal((300, dim))
        (codes, factors, _, _), (_, _, planes, scale) = rotated.encode(a), rotated.encode(b)
        guess = rotated.estimates(codes, factors, planes, scale, dim)
        true = rotated.unit(a) @ rotated.unit(b).T
        assert abs((guess - true).mean()) < (2e-3 if dim > 7 else 2e-2)
        if dim > 7:
            assert (np.abs(guess - true) <= rotated.SIGMAS * rotated.errors(factors, scale[:, 1], dim)).all()
    same = rotated.encode(a)
    assert all((x == y).all() for x, y in zip(same, rotated.encode(a), strict=True))


def test_different_vectors_of_one_id(spark):
    rows = [(5, [1.0, 0.0, 0.0], 0), (5, [0.0, 1.0, 0.0], 0), (6, [1.0, 0.01, 0.0], 0), (7, [0.0, 1.0, 0.01], 0), (8, [0.0, 0.0, 1.0], 0), (8, [0.0, 0.0, 1.0], 0), (8, [0.0, 0.0, 1.0], 1)]
    got = rotated.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect())) == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (8, 0, 8, True), (8, 1, 8, True), (8, 1, 8, True)]


def jaccard_rows(texts):
    sets = []
    for t in texts:
        w = words(t or "")
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return pairs


def test_forest_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "SIGNATURE_BLOCK", 8)
    monkeypatch.setattr(lshforest, "SET_BLOCK", 6)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)] + ["é1", "ß"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120, 400]))] for _ in range(40)]
    texts = []
    for doc in base:
        texts.append(" ".join(doc))
        for _ in range(rng.choice([0, 1, 4, 12])):
            new = list(doc)
            for _ in range(rng.randrange(1 + len(new) // 30)):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", ", ", "!! "]).join(new))
    texts += [texts[0]] * 30 + ["", "  ", "!?", None, "one", "One!", "a b c d e", "A b c d e."]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, texts[0], 0)]
    got = {r.doc_id: r for r in lshforest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node long")).collect()}
    pairs = jaccard_rows(texts)
    want = reachable(len(texts), pairs)
    degree = [0] * len(texts)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    assert len(got) == len(rows) and max(degree) > 25
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(d, c, c == i) for i, (d, c) in enumerate(zip(degree, want, strict=True))]
    assert got[None].n_links == 0 and got[None].kept


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lshforest.near_duplicates(none).count() == 0
    assert rotated.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_links, r.kept) for r in lshforest.near_duplicates(twice).collect()) == [(1, 1, True), (1, 1, True), (2, 0, True)]
    assert lshforest.deduplicate(twice).count() == 2


def test_deduplicate_keeps_null_keys_and_texts_of_repeated_keys(spark):
    same, other = "a b c d e f", "u v w x y z"
    rows = [(None, same), (None, same), (None, other), (1, same), (1, other), (1, same), (2, other), (3, "!"), (4, "k l m n o p")]
    want = sorted([(0, same), (0, same), (0, other), (1, same), (1, other), (3, "!"), (4, "k l m n o p")])
    for order in (rows, rows[::-1]):
        got = lshforest.deduplicate(spark.createDataFrame(order, "doc_id long, text string"))
        assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == want


def test_prefix_reaches_the_recall():
    m = lshforest.target_depth(0.8)
    assert 1 - (1 - 0.8**m) ** lshforest.TREES >= lshforest.RECALL
    assert 1 - (1 - 0.8 ** (m + 1)) ** lshforest.TREES < lshforest.RECALL


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_classes_meet_below_the_nodes_of_a_trie(spark, monkeypatch, parts):
    """All pairs of classes that share a prefix of the target depth in some tree meet, whatever the partitions; no pair meets
    that shares less than one byte fewer."""
    rng = np.random.default_rng(11)
    n, t, w = 400, lshforest.TREES, lshforest.LABEL
    sigs = rng.integers(0, 2, (n, t, w), np.uint8)  # short alphabets, so that prefixes are shared
    sigs[:, 3:] = rng.integers(0, 256, (n, t - 3, w), np.uint8)
    sigs[:150, 0, :6] = 9  # a crowd below one prefix
    m = lshforest.target_depth(0.8)
    same = (np.cumprod(sigs[:, None] == sigs[None, :], 3).sum(3)).max(2)
    must = {(i, j) for i, j in zip(*np.nonzero(np.triu(same >= m, 1)), strict=True)}
    may = {(i, j) for i, j in zip(*np.nonzero(np.triu(same >= m - 1, 1)), strict=True)}
    classes = spark.createDataFrame([(i, bytes(s.tobytes())) for i, s in enumerate(sigs)], "node long, sig binary")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        groups = {}
        for r in lshforest.candidates(classes, 0.8).collect():
            groups.setdefault(r.meeting, []).append(r.node)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {tuple(sorted((a, b))) for g in groups.values() for i, a in enumerate(g) for b in g[:i]}
    assert must <= got <= may and len(got) > len(must)


def test_recall_against_brute_force(spark):
    """Of pairs of random sets at similarities just above the threshold, nearly all are linked; none below it."""
    rng = random.Random(8)
    texts, want = [], []
    for k in range(300):
        words_ = [f"x{rng.randrange(10**9)}" for _ in range(124)]
        other = list(words_)
        for at in rng.sample(range(10, 110, 9), 2):  # two words changed: ten of 120 runs differ
            other[at] = f"y{rng.randrange(10**9)}"
        if k % 3 == 0:
            other[118] = "z"  # and some more near the end
        texts += [" ".join(words_), " ".join(other)]
        want.append(jaccard_rows(texts[-2:]) != [])
    got = {r.doc_id: r.n_links for r in lshforest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hit = [got[2 * k] == 1 for k in range(300)]
    assert sum(want) >= 190 and sum(h for h, w in zip(hit, want, strict=True) if w) >= 0.99 * sum(want) and not any(h for h, w in zip(hit, want, strict=True) if not w)


def test_clashing_names_and_different_texts_of_one_id(spark):
    same, other = "a b c d e f", "u v w x y z"
    rows = [(1, same, 1, 1, 1, 1), (1, other, 1, 1, 1, 1), (2, same, 1, 1, 1, 1), (3, other, 1, 1, 1, 1), (4, "x " * 400_000, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, _kept long, component_id long, node long")
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in lshforest.near_duplicates(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]
    assert sorted((r.doc_id, r.text[:20]) for r in lshforest.deduplicate(df).collect()) == [(1, same), (1, other), (4, ("x " * 10))] and lshforest.deduplicate(df).columns == df.columns
