"""Operators on single texts against plain implementations and round trips."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loglattice.llm import bpe, hmm, hostpaths, keypoints, langid, licenses, packing, signatures, surrogates
from loglattice.llm.catalog import BYTE_BPE, PIECES, WORD_BPE

TEXTS = ["", None, "Hello  world's 123 don't\n\n x", "für die ñandú é 中文 😀", " a", "a " * 50, "x" * 3000, "tab\tand space ... ,. !!,", "Under the MIT License. CC-BY-NC, Apache License, Version 2.0"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "x", "y")], "doc_id long, text string, n_tokens string")


def test_bpe_equals_tiktoken_and_round_trips(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE_BPE), special_tokens={})
    rows = bpe.encode(docs(spark), BYTE_BPE, P.PATTERN, offsets="offsets").collect()
    assert len(rows) == len(TEXTS) + 1
    c = bpe.codec(BYTE_BPE, P.PATTERN)
    for r in rows:
        text = r.text or ""
        assert r.ids == enc.encode_ordinary(text) and c.decode(r.ids) == text
        assert all(text[o.start : o.end] and c.bytes_of[i] in text[o.start : o.end].encode() for i, o in zip(r.ids, r.offsets, strict=True))
    assert c.decode(enc.encode_ordinary("😀")[:1]).startswith("�")
    assert bpe.digests(docs(spark), BYTE_BPE, P.PATTERN).count() == len(rows)
    assert bpe.digests(docs(spark).limit(0), BYTE_BPE, P.PATTERN).count() == 0


def test_packing_keeps_every_id_once(spark):
    texts = TEXTS + ["word " * n for n in (5000, 300, 800, 12000)] + ["Σίσυφος ΣΑΣ", "a\x1cb", "hello <|endoftext|> world", "hello<|startoftext|>world", "Hello <|ENDOFTEXT|> World", "<|endof text|>"]
    got = packing.pack(docs(spark, texts), WORD_BPE).collect()
    tok = Tokenizer.from_file(WORD_BPE)  # as the file has it
    assert tok.encode(texts[-4], add_special_tokens=False).ids == [3306, 49407, 1002]
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(docs(spark).limit(0), WORD_BPE).count() == 0


def test_packing_encodes_odd_runs_as_the_library_does_and_in_few_calls():
    path = P.path("word_bpe_49k.json")
    enc, tok = packing.WordIds(path), Tokenizer.from_file(path)
    space = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    texts = ["", " ", space, space.join(["Ab", "été", "e\u0301te\u0301,", "x1.", "don't", "ΑΣ", "ΑΣ. Σ", "İstanbul", "ß", "中文。", "a,b", "…", "😀!"]), "a\x1cb", "<|endoftext|> a", "A" * 300, "one, one. one"]
    calls, whole = [], enc.whole
    enc.whole = lambda text: calls.append(text) or whole(text)
    for _ in range(2):
        got = enc.encode(texts)
        assert [x.tolist() for x in got] == [[*tok.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]
    # only texts that are left to the library as a whole take calls of their own; runs went there one by one
    assert len(calls) == 2 * sum(any(c in t for c in ("\x1c", "<|endoftext|>")) or any(c in t for c in "\x1d\x1e\x1f") for t in texts)


def test_bpe_digests_are_those_of_lists_and_bytes(spark):
    path, texts = P.path("byte_bpe_multi_50k.tiktoken"), ["", "it's 12 été\n\n  x", None, "😀 中文", " ", "a" * 500, "x y"]
    c = bpe.Codec(path, P.PATTERN)
    rows = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, P.PATTERN).collect()}
    for i, (t, ids) in enumerate(zip(texts, c.encode([t or "" for t in texts]), strict=True)):
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert tuple(rows[i])[1:] == want
    flat, cuts = c.encoded([t or "" for t in texts])
    assert flat.dtype.itemsize == 4 and [bytes(x) for x in c.spelled(c.tokens, flat, cuts)] == [(t or "").encode() for t in texts]


def test_licenses(spark):
    rows = {r.doc_id: r for r in licenses.licenses(docs(spark)).collect()}
    r = rows[8]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (12, 3, 0, 7, "apache-2,cc-by-nc,mit") and 0 < r.score <= 1
    assert rows[1].n_words == 0 and rows[1].labels == "" and rows[1].first_word is None
    assert licenses.licenses(docs(spark).limit(0)).count() == 0 and licenses.licenses(docs(spark)).count() == len(TEXTS) + 1
    found = licenses.Detections(*np.array([[0, 9, 0], [2, 5, 1], [8, 12, 2], [2, 5, 3], [0, 9, 4]]).T)
    assert licenses.resolve(found, np.array([5, 4, 9, 4, 5])).rule.tolist() == [0, 2]


def test_base_places_equal_brute_force(spark):
    rng = random.Random(7)
    pool = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "CC-BY-NC", "Under The MIT License", "x", "\n", "é", "mité", "2.0", "Ä"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", " ", "-", ", ", "", "\x00"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    rows = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    some = 0
    for i, t in enumerate(texts):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        got = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        hits = [(k, label) for phrase, label in signatures.BASE.items() for k in range(len(got)) if got[k : k + len(phrase.split())] == phrase.split()]
        some += bool(hits)
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(got), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and {x for _, x in hits} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert some > 100


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.integers(0, 5)), max_size=40))
def test_suppression_equals_brute_force(items):
    priority = np.array([3, 3, 2, 2, 1, 0])
    found = sorted({(a, a + n, k) for a, n, k in items})
    inside = lambda f, g: g[0] <= f[0] and f[1] <= g[1]
    stronger = lambda f, g: (priority[g[2]], g[1] - g[0], -g[2]) > (priority[f[2]], f[1] - f[0], -f[2])
    want = sorted(f for f in found if not any(inside(f, g) and stronger(f, g) for g in found))
    arrays = np.array(found, np.int64).reshape(-1, 3).T
    got = licenses.resolve(licenses.Detections(*arrays), priority)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == want


@pytest.mark.parametrize("n", range(0, 320, 20))
def test_every_signature_passes_its_own_gate(n):
    """A text that a signature matches has one of its sets of keywords."""
    rules = signatures.rules()
    assert len(rules) >= 200 and len({r.pattern for r in rules}) == len(rules)
    for rule in rules[n : n + 20]:

        @settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(rule.pattern, fullmatch=True, alphabet=st.characters(codec="latin-1")))
        def check(text):
            assert any(k <= set(text.split(" ")) for k in rule.keywords), (rule, text)
            found = licenses.scan(text)[3]
            assert len(found.rule), (rule, text)

        check()


def test_long_texts_of_one_phrase_scan_in_time():
    for phrase in ("under the mit license ", "all rights reserved ", "licensed under the apache license version 2 0 "):
        text = phrase * (10_000_000 // len(phrase))
        began = time.time()
        n, places, _, found = licenses.scan(text)
        assert time.time() - began < 15 and n == text.count(" ")
        assert len(found.rule) == n // len(phrase.split()) or "apache" in phrase


def brute_word(word, probs):
    w = langid.START + word
    alpha = [1.0] + [0.0] * len(w)
    for j in range(1, len(w) + 1):
        alpha[j] = sum(alpha[i] * probs.get(w[i:j], 1e-9 if j == i + 1 else 0.0) for i in range(max(0, j - langid.PIECE), j))
    return math.log(alpha[-1])


def test_language_model_sums_all_segmentations(spark):
    rng = random.Random(1)
    en, fr = ["the house", "of water", "and then this"], ["la maison", "le été où", "une forêt"]
    rows = [(i, " ".join(rng.choices(en if i % 2 else fr, k=8)), "en" if i % 2 else "fr") for i in range(60)]
    data = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES)
    m = langid.Model(data)
    probs = [{p: m.probs[r, k] for p, r in m.row.items()} for k in range(2)]
    for w in ("house", "forêt", "zzz", "a"):
        assert np.allclose(m.word_logs([w])[0], [brute_word(w, p) for p in probs])
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(0, "the water house"), (1, "une maison"), (2, None), (3, "12 !?"), (4, "中文字"), (5, "x" * 500)], "doc_id long, text string"), data).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["en", "fr", "und", "und"] and got[4].lang_score < 0.5
    assert langid.Model(langid.build([])).predict(["some text"]) == [("und", 0.0)]
    for text in ("漢" * 40, "漢" * 4000, "x" * 41, "é漢" * 20, "the " * 50_000):
        ((lang, score),) = m.predict([text])
        assert lang in ("en", "fr") and 0 <= score <= 1, text[:9]
    long = "".join(rng.choices("houseéàt", k=langid.LONGEST))
    assert np.allclose(m.word_logs([long])[0], [brute_word(long, p) for p in probs])
    unknown = langid.predict(spark.createDataFrame([(0, "漢" * 40, 1.0)], "doc_id long, text string, _score double"), data, lang="_lang", score="_score")
    assert unknown.where(langid.accepted("_lang", "_score")).count() == 0
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), data).count() == 0


def test_forward_and_expected_counts_equal_brute_force():
    rng = np.random.default_rng(0)
    k, v = 3, 4
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T.copy()
    sequences = [np.array([0, 1, 3], np.int32), np.array([2], np.int32), np.array([1, 1, 0, 2], np.int32)]
    paths = lambda n: np.array(np.meshgrid(*[range(k)] * n, indexing="ij")).reshape(n, -1).T
    firsts, emits = np.zeros(k), np.zeros((v, k))
    logs = []
    for s in sequences:
        p = {tuple(z): start[z[0]] * math.prod(move[a, b] for a, b in zip(z[:-1], z[1:], strict=True)) * math.prod(emit[x, a] for x, a in zip(s, z, strict=True)) for z in paths(len(s))}
        total = sum(p.values())
        logs.append(math.log10(total))
        for z, q in p.items():
            firsts[z[0]] += q / total
            for x, a in zip(s, z, strict=True):
                emits[x, a] += q / total
    assert np.allclose(hmm.forward(sequences, start, move, emit), logs)
    got = hmm.expected(sequences, start, move, emit)
    assert np.allclose(got[0], firsts, atol=1e-4) and np.allclose(got[2], emits, atol=1e-4) and abs(got[1].sum() - 5) < 1e-3


def test_blocks_of_long_documents_give_the_same_sums(monkeypatch):
    rng = np.random.default_rng(1)
    k, v = 4, 30
    model = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T.copy()
    docs = [rng.integers(0, v, n).astype(np.uint16) for n in (1, 700, 30, 2, 333, 64, 65, 1)]
    whole, want = hmm.forward(docs, *model), hmm.expected(docs, *model)
    monkeypatch.setattr(hmm, "LONG", 60)
    monkeypatch.setattr(hmm, "BLOCK", 16)
    monkeypatch.setattr(hmm, "SIDE_BY_SIDE", 200)
    assert np.allclose(hmm.forward(docs, *model), whole, rtol=1e-12)
    for a, b in zip(hmm.expected(docs, *model), want, strict=True):
        assert np.allclose(a, b, rtol=2e-4, atol=1e-3)
    assert hmm.forward([], *model).shape == (0,)


def test_base_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HELD", 6)
    monkeypatch.setattr(hmm, "EMITTED", 3)
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["The", "the", "a", "É", "é", *(f"w{i}" for i in range(30))], k=rng.randrange(40))) for _ in range(50)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    from loglattice.llm.common import remainder

    rows = hmm.score_corpus(df, remainder("doc_id", 10) == 0).collect()
    words = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    train = [w for i, w in enumerate(words) if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(x for w in train for x in w)
    n = sum(c.values())
    assert len(rows) == len(texts)
    for r in rows:
        w = words[r.doc_id]
        want = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - want) < 1e-5 and r.score < 0
    assert hmm.score_corpus(df.limit(0), remainder("doc_id", 10) == 0).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1), (3, "x " * 30_000, 1), (3, "x", 1)], "doc_id long, text string, held_out int")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in hmm.score_corpus(odd, remainder("doc_id", 10) == 0).collect()) == [(0, 3), (3, 2), (3, 30_001)]


def test_words_of_a_slice_are_looked_up_once_and_as_bytes_split_them(spark, monkeypatch):
    """Each distinct word of a slice is looked up once, however often it occurs; all else is as by tokens()."""
    import pyarrow as pa

    every = "".join(f"x{chr(i)}" for i in range(1, 0x3100) if chr(i) not in " \n")
    texts = [every, None, "", "   ", " a  B\tb ", "\x0bÉ\x0c\r\né\u0085\u00a0 \x1c a", "A " * 50, "\x00 a\x00"]
    before = ["é" * 5000 + " skipped"] * 3
    distinct, numbers, cuts = hmm.words(pa.array([*before, *texts, *before])[3:-3])
    distinct.validate(full=True)
    assert len(set(distinct.to_pylist())) == len(distinct)
    names = [*(w.encode() for w in distinct.to_pylist()), None]
    for t, begin, end in zip(texts, cuts[:-1], cuts[1:], strict=True):
        assert [names[k] for k in numbers[begin:end]] == [*hmm.tokens(t or ""), None]
    monkeypatch.setattr(hmm, "HELD", 2)
    monkeypatch.setattr(hmm, "EMITTED", 1)
    # what a task counts is passed on in pieces
    monkeypatch.setattr(hmm, "COUNTED", 3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = collections.Counter(x.decode() for t in texts for x in hmm.tokens(t or "")) + collections.Counter({None: len(texts)})
    assert {r["token"]: r["c"] for r in hmm.count_words(df, "text").collect()} == want
    looked = []
    voc = hmm.Vocabulary(hmm.build_vocabulary(hmm.count_words(df, "text")))
    monkeypatch.setattr(hmm.Vocabulary, "look_up", lambda self, got, real=hmm.Vocabulary.look_up: looked.append(list(got)) or real(self, got))
    monkeypatch.setattr(hmm, "vocabulary", lambda data: voc)
    seen = []
    monkeypatch.setattr(hmm, "map_arrow", lambda df, fn, *more: seen.append(fn))
    hmm.numbered(df, "text", type("Shared", (), {"value": b""}))
    got = seen[0](pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    real = [voc.model_ids(w, np.array([voc.ids.get(x, -1) for x in w], np.int64)).tobytes() for w in map(hmm.tokens, (t or "" for t in texts))]
    assert got["ids"].to_pylist() == real and got["state"].to_pylist() == [zlib.crc32((t or "").encode()) % hmm.STATES for t in texts]
    assert len(looked) == 1 and len(looked[0]) == len(set(looked[0]))


def test_a_round_gathers_the_emissions_of_each_token_once(monkeypatch):
    """The backward direction takes what the forward one has gathered, and padding has none."""
    rng = np.random.default_rng(5)
    model = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3).T.copy()
    docs = [rng.integers(0, 9, n).astype(np.uint16) for n in (50, 3, 1, 7, 20)]
    gathered = []
    monkeypatch.setattr(hmm, "columns", lambda rows, ids, one, real=hmm.columns: gathered.append(len(ids)) or real(rows, ids, one))
    hmm.expected(docs, *model)
    assert sum(gathered) == sum(map(len, docs))


def test_only_words_that_are_not_held_are_hashed_again(monkeypatch):
    words = [f"w{i}".encode() for i in range(20)]
    voc = hmm.Vocabulary(hmm.pickle.dumps((words, list(range(40, 20, -1)), 5, np.full(4, 9.0), np.full(4, 3.0), 700, 30, 7)))
    text = [*words, b"new", *words[::-1], b"newer"]
    want = [i if (i := int(w[1:]) if w in words else 20) < 5 else 5 + zlib.crc32(w) % 4 for w in text] + [9]
    hashed = []
    monkeypatch.setattr(hmm.zlib, "crc32", lambda w, real=zlib.crc32: hashed.append(w) or real(w))
    assert voc.look_up(text).tolist() == [int(w[1:]) if w in words else -1 for w in text]
    assert voc.model_ids(text, voc.look_up(text)).tolist() == want and hashed == [b"new", b"newer"]
    assert voc.model_ids([], voc.look_up([])).tolist() == [9]


def test_probabilities_of_next_words_sum_to_one(spark, monkeypatch):
    """A share of each class is left for words that training hasn't seen; all else sums to one."""
    monkeypatch.setattr(hmm, "HELD", 30)
    monkeypatch.setattr(hmm, "EMITTED", 10)
    monkeypatch.setattr(hmm, "LEAST_CLASSES", 4)
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(" ".join(rng.choices(pool, weights=[1 / (i + 1) for i in range(60)], k=20)),) for _ in range(80)], "text string")
    _, held, model = hmm.train(df)
    voc = hmm.Vocabulary(held)
    start, move, emit = hmm.pickle.loads(model)
    assert voc.classes == 4 and np.allclose(emit.sum(0), 1) and np.allclose(move.sum(1), 1) and np.isclose(start.sum(), 1)
    for c in range(4):
        seen = [w for w in pool if w.encode() in voc.ids and voc.ids[w.encode()] >= voc.emitted and zlib.crc32(w.encode()) % 4 == c]
        assert sum(10 ** voc.share[voc.ids[w.encode()]] for w in seen) < 1


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">Accept</div>
<div id="wrap-12"><article class="post-7"><h1>A &amp; B</h1><p>One  long\n paragraph of text.<br>More<p>Two <b>bold</b> words<script>var x="</p>"</script> here
<ul><li>item<li>other</ul><div class="comments"><p>Reader says</p></div></article><aside>Ads</aside></div><form><p>Mail</p></form><footer>Foot</footer>"""


def test_html_main_text(spark):
    want = "A & B\n\nOne long paragraph of text. More\n\nTwo bold words here\n\nitem\n\nother"
    pages = [(0, "http://a.example/1", PAGE), (1, "http://a.example/2", PAGE.replace("12", "13").replace("post-7", "post-9")), (2, "http://a.example/3", "<body><p>Only this"), (3, None, None), (4, "odd", "<nav>x</nav>"), (5, "http://b.example", "plain text"), (0, "http://a.example/1", PAGE)]
    rows = hostpaths.main_text(spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")).collect()
    got = sorted((r.page_id, r.text, r.n_chars) for r in rows)
    assert got == sorted((i, t, len(t)) for i, t in [(0, want), (0, want), (1, want), (2, "Only this"), (3, ""), (4, ""), (5, "plain text")])


def test_nested_items_end_each_other():
    texts = hostpaths.parsed("<ul><li><p>a<li><b>b<p>c</ul><p>d<table><tr><td>e<td>f<tr><td>g</table><dl><dt>h<dd>i<dt>j").texts
    assert texts == list("abcdefghij")
    p = hostpaths.parsed("<ul><li>a<li>b</ul>")
    assert [p.names[k] for k in p.at] == ["li", "li"] and len({p.parents[k] for k in p.at}) == 1


def brute_scores(p):
    """Scores by walking up from each block."""
    total = {k: 0.0 for k in range(len(p.names))}
    for text, linked, at in zip(p.texts, p.linked, p.at, strict=True):
        weight = max(0, len(text) - 2 * linked)
        k = at if p.names[at].split(".")[0] in ("", "body", "html", "div", "section", "article", "main", "td") else p.parents[at]
        while k >= 0:
            total[k] += weight
            weight, k = weight / 2, p.parents[k]
    for k, name in enumerate(p.names):
        tag, _, label = name.partition(".")
        total[k] *= 4 if tag in ("article", "main") else 2 if hostpaths.GOOD & set(re.split("[^a-z]+", label.lower())) else 1
    return [total[k] for k in range(len(p.names))]


@given(st.lists(st.sampled_from(["<div class=post-1>", "<div>", "</div>", "<p>", "</p>", "<ul><li>", "</ul>", "text here ", "<a href=x>link</a>", "<article>", "</article>", "<nav>", "</nav>", "<b>", "</i>", "<br>", "&amp;", "<td>", "<!-- x -->", "<script>a</script>"]), max_size=60))
def test_scores_equal_brute_force(parts):
    p = hostpaths.parsed("".join(parts))
    assert np.allclose(hostpaths.scores(p), brute_scores(p)) and all(a < k for k, a in enumerate(p.parents))


def test_votes_and_extraction_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    pages = []
    for i in range(120):
        site = i % 3
        body = "".join(f"<p>{' '.join(rng.choices(['some', 'words', 'here'], k=rng.randrange(3, 30)))}</p>" for _ in range(rng.randrange(4)))
        pages.append((i, f"http://h{site}.example/{i}", f"<div class='c{site}-{i}'><div class='box{site}'>{body}</div><div class=x{rng.randrange(3)}><div>{'other words ' * rng.randrange(20)}</div></div></div>"))
    pages.append((500, None, "<p>no host"))
    votes = collections.defaultdict(collections.Counter)
    for _, url, page in pages:
        p = hostpaths.parsed(page)
        s = brute_scores(p)
        for k in range(len(s)):
            if s[k]:
                path, up = [], k
                while up > 0:
                    path.append(p.names[up])
                    up = p.parents[up]
                votes[(url or "").split("/")[2:3][0] if url else ""][tuple(path[::-1])] += round(hostpaths.POINTS * s[k] / sum(s))
    want = {}
    for i, url, page in pages:
        p = hostpaths.parsed(page)
        own = votes[url.split("/")[2] if url else ""]
        path = min(own, key=lambda x: (-own[x], len(x)))
        names = []
        for k in range(len(p.names)):
            names.append(() if not k else names[p.parents[k]] + (p.names[k],))
        got = [t for t, at in zip(p.texts, p.at, strict=True) if names[at][: len(path)] == path]
        if not got and p.texts:
            s = brute_scores(p)
            top = names[s.index(max(s))]
            first = s.index(max(s))
            inside = lambda k: k == first or k > 0 and inside(p.parents[k])  # noqa: E731, B023
            got = [t for t, at in zip(p.texts, p.at, strict=True) if inside(at) and top is not None]
        want[i] = "\n\n".join(got)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for hosts in (hostpaths.HOSTS, 1):  # the second joins by salted hosts
        monkeypatch.setattr(hostpaths, "HOSTS", hosts)
        assert {r.page_id: r.text for r in hostpaths.main_text(df).collect()} == want
    assert hostpaths.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>x " * 150_000, "<b>" * 100_000 + "<p>x" * 100_000, "<div>" * 50_000 + "</span>" * 50_000, "<a " * 300_000, "<li><p>x" * 100_000, "<script>" + "</script" * 100_000, "<!--" * 200_000, "<p class='a" + "<p " * 100_000, "text &amp; " * 100_000, "<ul><li>" * 60_000])
def test_odd_long_pages_take_linear_time(page):
    began = time.time()
    p = hostpaths.parsed(page)
    total = hostpaths.scores(p)
    hostpaths.extract(np.array(p.parents), np.array(p.paths), hostpaths.best(total), p.texts, np.array(p.at, int), None)
    assert time.time() - began < 10


def test_surrogates(spark):
    text = "Mrs Anna Schmidt <anna.s@mail1.example.com>, +1 (207) 555-7294 or +12075557294, 10.1.2.3, 4111 1111 1111 1111, password=abc123def4. Frau Schmidt."
    key = b"k"
    new, spans = surrogates.replaced(text, key)
    assert [s[2] for s in spans] == ["name", "email", "phone", "phone", "ip", "card", "credential", "name"]
    assert all(old not in new for *_, old, _ in spans if len(old) > 8) and spans[0][4].split()[1] == spans[-1][4]
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(spans[2][4]) == digits(spans[3][4]) and surrogates.luhn([int(c) for c in digits(spans[5][4])[:-1]]) == int(spans[5][4][-1])
    for size in (2, 7, 26, 1000):
        assert sorted(surrogates.permute(i, size, key, "t") for i in range(size)) == list(range(size))
    df = spark.createDataFrame([(0, text, 1), (1, None, 1), (2, "", 1), (None, "nothing here", 1)], "doc_id long, text string, entities int")
    got = {r.doc_id: r for r in surrogates.replace(df, key).collect()}
    assert got[0].text == new and got[1].text is None and got[None].text == "nothing here" and got[2].entities == []
    assert surrogates.checked_key(df, key) == key and surrogates.collisions(surrogates.entities(df), key).count() == 0
    assert surrogates.replace(df.limit(0), key).count() == 0 and surrogates.checked_key(df.limit(0), key) == key


KEYS = st.binary(min_size=1, max_size=40)


@given(st.text("0123456789", min_size=7, max_size=12), st.lists(st.sampled_from(["", " ", "-", "."]), min_size=12, max_size=12), KEYS)
def test_numbers_in_any_format_have_one_surrogate(digits, marks, key):
    plain, spaced = "+" + digits, "+" + "".join(d + m for d, m in zip(digits, marks, strict=False)).rstrip(" -.")
    new = surrogates.surrogate(plain, "phone", key)
    assert new != plain and len(new) == len(plain)
    again = surrogates.surrogate(spaced, "phone", key)
    assert [c for c in again if c.isdigit()] == list(new[1:]) and [c for c in again if not c.isdigit()] == [c for c in spaced if not c.isdigit()]


@given(st.lists(st.text("abcxyzéßабв漢字", min_size=2, max_size=6).map(str.title), min_size=2, max_size=30, unique_by=str.lower), KEYS, st.sampled_from(["f", "m", ""]))
def test_names_keep_apart_and_move(names, key, gender):
    for new in ([surrogates.surname(n, key) for n in names], [surrogates.given(n, gender, key) for n in names]):
        assert len({x.lower() for x in new}) == len({x.lower() for x in names}) and all(a.lower() != b.lower() for a, b in zip(names, new, strict=True))


def test_no_listed_name_stays_and_genders_match():
    for key in (b"synthetic tables only", b"k"):
        for (gender, script), names in surrogates.GIVEN.items():
            new = [surrogates.given(n, gender, key) for n in names]
            assert sorted(new) == sorted(names) and all(a != b for a, b in zip(names, new, strict=True)), (gender, script)


def test_one_entity_in_several_formats(spark):
    texts = ["ring +49 170 1234567 and +491701234567", "DE89 3704 0044 0532 0130 00 and DE89370400440532013000", "(207) 555-7294, 207.555.7294, +1 207 555 7294", "2001:db8:0:0:0:0:0:1 and 2001:0DB8:0000:0000:0000:0000:0000:0001", "Anna.S@Mail.example.com and anna.s@mail.example.com"]
    key = b"synthetic tables only"
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert surrogates.entities(df).count() == len(texts) and surrogates.checked_key(df, key) == key
    for t in texts:
        new, spans = surrogates.replaced(t, key)
        assert len({surrogates.canonical(n, k) for _, _, k, _, n in spans}) == 1 and len(spans) == t.count(",") + t.count("and") + 1


def test_names_are_replaced_wherever_they_stand():
    key = b"synthetic tables only"
    new, spans = surrogates.replaced("Mr John Smith met John Smith. Smith said hi to SMITH and smith. Dr J. Smith-Jones, Frau Anna van Beek; Beek.", key)
    assert not any(w in new for w in ("John", "Smith", "SMITH", "Anna", "Beek")) and "smith" in new and "van" in new
    first, last = new.split()[1:3]
    assert new.startswith(f"Mr {first} {last} met {first} {last}. {last} said hi to {last.upper()} and smith.") and surrogates._gender[first] == "m"
    assert surrogates.replaced("Mrs Kimiko Tanaka", key)[0].split()[1].endswith("ina") and surrogates.replaced("Mr Kimiko Tanaka", key)[0].split()[1].endswith("on")
    man, woman = (surrogates.replaced(t, key)[0].split()[-1] for t in ("Г-н Иванов", "Г-жа Иванова"))
    assert man.endswith("ов") and woman == man + "а"
    assert "田" not in surrogates.replaced("Dr 田中 太郎", key)[0] and "Yılmaz" not in surrogates.replaced("Mr Ahmed Yılmaz", key)[0]


def test_many_and_long_entities_take_linear_time():
    key = b"k"
    for text in ("write to a.b@c.org, " * 50_000, "Mr John Smith " * 50_000, "token=" + "a1" * 3000):
        began = time.time()
        assert surrogates.replaced(text, key)[0] != text
        assert time.time() - began < 20


def test_image_copies(spark):
    rng = np.random.default_rng(0)
    big = lambda: np.kron(rng.integers(0, 255, (14, 14)), np.ones((9, 9)))
    images = [big() for _ in range(6)]
    edited = np.clip(images[0] * 0.9 + 12, 0, 255)
    rows = [(i, keypoints.encode(x)) for i, x in enumerate(images)] + [(6, keypoints.encode(images[1][9:117, 18:117])), (7, keypoints.encode(edited)), (8, keypoints.encode(images[2])), (9, None), (10, b"broken"), (11, keypoints.encode(np.zeros((60, 60)))), (None, keypoints.encode(images[3]))]
    got = {r.image_id: r for r in keypoints.near_duplicates(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert {i: r.component_id for i, r in got.items() if i is not None} == {**{i: i for i in range(12)}, 6: 1, 7: 0, 8: 2}
    assert got[0].n_links == got[1].n_links == got[2].n_links == 1 and got[11].n_links == 0
    assert keypoints.near_duplicates(spark.createDataFrame([], "image_id long, image binary")).count() == 0
    twice = spark.createDataFrame([(1, keypoints.encode(images[0]), 1, 1), (1, keypoints.encode(images[1]), 1, 1), (2, keypoints.encode(images[1]), 1, 1)], "image_id long, image binary, hash int, node int")
    assert sorted((r.image_id, r.n_links, r.component_id) for r in keypoints.near_duplicates(twice).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_image_headers():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    for head in (b"P5 4 3 255\n", b"P5\n# a comment\n4 3\n# more\n255\n"):
        assert (keypoints.decode(head + x.tobytes()) == x).all()
    assert np.allclose(keypoints.decode(b"P5 4 3 65535\n" + (x.astype(">u2") * 257).tobytes()), x)
    for bad in (b"P5 4 3 255\n123", b"P5 0 3 255\n", b"P5 4 3 70000\n" + x.tobytes(), b"", b"P4 1 1\n0", None):
        assert keypoints.decode(bad) is None


def seen_at(image, ys, xs):
    """Brightness between pixels."""
    h, w = image.shape
    ys, xs = np.clip(ys, 0, h - 1.001), np.clip(xs, 0, w - 1.001)
    a, b = ys.astype(int), xs.astype(int)
    fy, fx = ys - a, xs - b
    return image[a, b] * (1 - fy) * (1 - fx) + image[a, b + 1] * (1 - fy) * fx + image[a + 1, b] * fy * (1 - fx) + image[a + 1, b + 1] * fy * fx


def edited(image, kind, rng):
    h, w = image.shape
    ys, xs = np.mgrid[:h, :w].astype(float)
    if kind[0] == "scale":
        ys, xs = np.mgrid[: int(h * kind[1]), : int(w * kind[1])]
        return seen_at(image, (ys + 0.5) / kind[1] - 0.5, (xs + 0.5) / kind[1] - 0.5)
    if kind[0] == "turn":
        a, cy, cx = np.deg2rad(kind[1]), (h - 1) / 2, (w - 1) / 2
        return seen_at(image, cy + (ys - cy) * np.cos(a) - (xs - cx) * np.sin(a), cx + (ys - cy) * np.sin(a) + (xs - cx) * np.cos(a))
    if kind[0] == "crop":
        n = int(h * kind[1])
        y, x = rng.integers(0, h - n + 1, 2)
        return image[y : y + n, x : x + n]
    return np.rot90(image) if kind[0] == "quarter" else image * 0.85 + 20 if kind[0] == "bright" else image + rng.normal(0, 5, image.shape)


#: Edits and the share of their copies that is found at least.
EDITS = [(("bright",), 0.95), (("noise",), 0.95), (("quarter",), 0.95), (("turn", 10), 0.9), (("crop", 0.8), 0.9), (("scale", 0.8), 0.9), (("scale", 1.25), 0.9), (("scale", 1.5), 0.9), (("crop", 0.6), 0.7)]


def test_recall_of_edited_copies(spark):
    """Images of a seed of their own, 12 smooth ones and 12 of cells, and one copy of each for each edit."""
    rng = np.random.default_rng(78)
    f = np.fft.fftfreq(200)
    far = np.hypot(f[:, None], f)

    def soft():
        x = sum(np.real(np.fft.ifft2(np.fft.fft2(rng.standard_normal((200, 200))) * np.exp(-((far / s) ** 2)))) / s for s in (0.02, 0.05, 0.1))
        return (x - x.min()) / (x.max() - x.min()) * 255

    base = [soft() for _ in range(12)] + [np.kron(rng.integers(0, 256, (20, 20)), np.ones((10, 10))) for _ in range(12)]
    rows = [(i, keypoints.encode(x)) for i, x in enumerate(base)]
    rows += [(1000 * (e + 1) + i, keypoints.encode(edited(x, kind, rng))) for e, (kind, _) in enumerate(EDITS) for i, x in enumerate(base)]
    got = {r.image_id: r.component_id for r in keypoints.near_duplicates(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert all(got[i] == i for i in range(len(base)))
    assert all(c in (i, i % 1000) for i, c in got.items()), "different images are linked"
    share = {kind: np.mean([got[1000 * (e + 1) + i] == i for i in range(len(base))]) for e, (kind, _) in enumerate(EDITS)}
    print(share)
    assert all(share[kind] >= least for kind, least in EDITS), share


def families(spark):
    """Images of two features that share one bucket of the first table; families of three, their ids interleaved."""
    rng = np.random.default_rng(6)
    place = keypoints.packed(np.array([[30, 30, 0, 1], [30, 60, 0, 1]]))
    base = rng.integers(0, 256, (3, 2, 16), np.uint8)
    base[:, :, : keypoints.KEY] = 7
    rows = []
    for i in range(9):
        bits = base[i % 3].copy()
        for t in range(1, keypoints.TABLES):
            bits[0, t * keypoints.KEY] ^= 1 << (i // 3)  # the keys of all other tables differ
        rows.append((i, bits.tobytes(), place, 2))
    return spark.createDataFrame(rows, "node long, bits binary, places binary, n_features long"), {(i, j) for i in range(9) for j in range(i + 3, 9, 3)}


def test_pairs_of_images_agree_in_one_order_and_as_by_brute_force():
    rng = np.random.default_rng(8)
    base = [keypoints.smooth(np.kron(rng.integers(0, 20, (10, 10)) * 13.0, np.ones((9, 9)))[None])[0] for _ in range(6)]
    images = np.stack([np.clip(x + rng.normal(0, s, x.shape), 0, 255) for s in (0, 12, 24) for x in base])
    owner, place, code = keypoints.describe(images)
    bits, places = ([x[owner == i] for i in range(len(images))] for x in (code, place))
    for x, y in ((0, 1), (3, 9)):
        differ = np.unpackbits(bits[x][:, None] ^ bits[y], axis=2).sum(2)
        assert set(zip(*keypoints.close(*(np.ascontiguousarray(b.view(np.uint64).T) for b in (bits[x], bits[y]))), strict=True)) == set(zip(*np.nonzero(differ <= keypoints.MATCH), strict=True))
    every = np.arange(len(images))
    rank = keypoints.ranks([b.tobytes() for b in bits], [keypoints.packed(p) for p in places])
    pairs = lambda left, right: {frozenset((left[a], right[b])) for a, b in zip(*keypoints.agreeing(bits, places, left, right, rank), strict=True)}
    whole = pairs(every, every)
    assert whole and all(a % 6 == b % 6 for a, b in whole)
    for left in (every[::-1], rng.permutation(every)):  # however images are dealt to blocks and numbered
        some, others = left[:7], left[7:]
        assert pairs(some, some) | pairs(others, others) | pairs(some, others) | pairs(others, some) == whole


def test_matches_of_many_images_vote_together_as_one_by_one(monkeypatch):
    """Pairs in any order and pieces of any size, against votes that are counted match by match."""
    rng = np.random.default_rng(9)
    base = [keypoints.smooth(np.kron(rng.integers(0, 20, (8, 8)) * 13.0, np.ones((10, 10)))[None])[0] for _ in range(4)]
    images = np.stack([np.clip(np.rot90(x, k) + rng.normal(0, s, x.shape), 0, 255) for k, s in ((0, 0), (1, 6), (0, 25), (3, 40)) for x in base] + [np.zeros((80, 80))])
    owner, place, code = keypoints.describe(images)
    raw = np.frombuffer(b"".join(keypoints.packed(place[owner == i]) for i in range(len(images))), np.uint16).reshape(-1, 4)
    bits = np.concatenate([code[owner == i] for i in range(len(images))])
    sizes = np.bincount(owner, minlength=len(images))
    places = np.split(keypoints.unpacked(raw.tobytes()), np.cumsum(sizes)[:-1])
    codes = np.split(np.unpackbits(bits, axis=1), np.cumsum(sizes)[:-1])

    def agree(i, j):
        p, q, cells = places[i], places[j], {}
        for a, b in zip(*np.nonzero((codes[i][:, None] != codes[j]).sum(2) <= keypoints.MATCH), strict=True):
            turn, scale = q[b, 2] - p[a, 2], q[b, 3] / p[a, 3]
            y, x = p[a, :2] - p[:, :2].mean(0)
            cos, sin = np.cos(turn) * scale, np.sin(turn) * scale
            at = turn / (2 * np.pi) * keypoints.TURNS, (np.rint(np.log(scale) / np.log(keypoints.FACTOR)) + keypoints.LEVELS) / keypoints.LEVELS_WIDE, (q[b, 0] - (y * cos + x * sin)) / keypoints.SHIFT, (q[b, 1] - (x * cos - y * sin)) / keypoints.SHIFT
            for shift in (0.0, 0.5):
                t, *rest = (int(np.floor(v + shift)) for v in at)
                cells.setdefault((shift, t % keypoints.TURNS, *rest), set()).add(tuple(p[a, :2] // keypoints.SPOT))
        return any(len(v) >= keypoints.CONSENSUS for v in cells.values())

    left, right = np.nonzero(~np.eye(len(images), dtype=bool))
    order = rng.permutation(len(left))
    left, right = left[order], right[order]
    want = {(i, j) for i, j in zip(left, right, strict=True) if agree(i, j)}
    assert len(want) > 8
    for votes, block, some in ((1 << 13, 64, 1024), (50, 3, 5)):
        monkeypatch.setattr(keypoints, "VOTES", votes)
        monkeypatch.setattr(keypoints, "BLOCK", block)
        monkeypatch.setattr(keypoints, "IMAGES", some)
        hit = keypoints.agreed(keypoints.Features(bits, raw, sizes), left, right)
        assert {(left[k], right[k]) for k in hit} == want and len(hit) == len(want)


def test_pairs_of_blocks_are_dealt_evenly(spark, monkeypatch):
    """No task gets two pairs of blocks while others have none."""
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(keypoints, "TOGETHER", 2)
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, schema, real=kind.mapInArrow: seen.append(self) or real(self, fn, schema))
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, keypoints.encode(np.kron(rng.integers(0, 255, (14, 14)), np.ones((9, 9))))) for i in range(12)], "node long, image binary")
    keypoints.verified(spark.createDataFrame([(i, j) for i in range(12) for j in range(i + 1, 12)], "a long, b long"), keypoints.features(rows, "image", ["node"]))
    for dealt in [d for d in seen if "bi" in d.columns]:
        got = dealt.select(F.spark_partition_id().alias("task"), "bi", "bj").distinct().groupBy("task").count().collect()
        assert max(r["count"] for r in got) <= -(-sum(r["count"] for r in got) // dealt.rdd.getNumPartitions())


def test_image_copies_keep_features_once(spark, tmp_path, monkeypatch):
    """Pairs that wait for verification and features of all images are on disk once, as compressed tables."""
    from loglattice.llm import common

    kept = []
    monkeypatch.setattr(common, "checkpoint", lambda df, real=common.checkpoint: kept.append(df.columns) or real(df))
    monkeypatch.setattr(keypoints, "checkpoint", common.checkpoint, raising=False)
    monkeypatch.setattr("loglattice.llm.links.checkpoint", common.checkpoint)
    rng = np.random.default_rng(3)
    images = [np.kron(rng.integers(0, 255, (14, 14)), np.ones((9, 9))) for _ in range(4)]
    rows = [(i, keypoints.encode(images[i % 4])) for i in range(8)] + [(8, keypoints.encode(images[0][9:, 18:]))]
    got = {r.image_id: (r.n_links, r.component_id) for r in keypoints.near_duplicates(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert got == {0: (2, 0), 4: (2, 0), 8: (2, 0)} | {i: (1, i % 4) for i in (1, 2, 3, 5, 6, 7)}
    assert not any({"bits", "bucket"} & set(c) for c in kept)


def test_image_candidates_are_all_close_entries_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(keypoints, "MEETINGS", 1, raising=False)
    described, want = families(spark)
    assert {tuple(r) for r in keypoints.candidates(described).collect()} == want
    monkeypatch.setattr(keypoints, "LARGE", 4, raising=False)
    monkeypatch.setattr(keypoints, "HELD", 2, raising=False)
    assert {tuple(r) for r in keypoints.candidates(described).collect()} == want


def test_one_shared_entry_makes_a_candidate_and_blocks_verify_alike(spark, monkeypatch):
    described, want = families(spark)
    assert {tuple(r) for r in keypoints.candidates(described).collect()} == want
    rng = np.random.default_rng(2)
    big = lambda: np.kron(rng.integers(0, 255, (14, 14)), np.ones((9, 9)))
    images = [big() for _ in range(4)]
    images += [x[9:, 18:] for x in images]
    rows = spark.createDataFrame([(i, keypoints.encode(x)) for i, x in enumerate(images)], "image_id long, image binary")
    pairs = spark.createDataFrame([(i, j) for i in range(8) for j in range(i + 1, 8)], "a long, b long")
    for together in (8192, 2):
        monkeypatch.setattr(keypoints, "TOGETHER", together, raising=False)
        got = keypoints.verified(pairs, keypoints.features(rows, "image", ["image_id"]).withColumnRenamed("image_id", "node"))
        assert {tuple(r) for r in got.collect()} == {(i, i + 4) for i in range(4)}


def test_pairs_of_a_block_are_verified_before_all_have_come(spark, monkeypatch):
    """A task holds the features of two blocks and HELD pairs, not all pairs of the blocks."""
    seen = []
    monkeypatch.setattr(keypoints, "HELD", 2)
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, schema, real=kind.mapInArrow: seen.append((self, fn)) or real(self, fn, schema))
    rng = np.random.default_rng(2)
    images = [np.kron(rng.integers(0, 255, (14, 14)), np.ones((9, 9))) for _ in range(4)]
    images += [x[9:, 18:] for x in images]
    rows = spark.createDataFrame([(i, keypoints.encode(x)) for i, x in enumerate(images)], "node long, image binary")
    pairs = spark.createDataFrame([(i, j) for i in range(8) for j in range(i + 1, 8)], "a long, b long")
    got = keypoints.verified(pairs, keypoints.features(rows, "image", ["node"]))
    assert sorted(tuple(r) for r in got.collect()) == [(i, i + 4) for i in range(4)]
    dealt, run = seen[-1]
    table = dealt.toArrow()
    block = np.array(table["bi"]) * 100 + np.array(table["bj"])
    most = np.bincount(block[np.array(table["a"]) != np.array(table["b"])]).argmax()
    batches = table.filter(block == most).combine_chunks().to_batches(max_chunksize=1)
    taken = []
    next(run(taken.append(1) or b for b in batches))
    assert len(taken) < len(batches)


def test_rounds_of_verification_find_the_same_pairs(spark, monkeypatch):
    """Many images are verified in rounds, each with a part of the blocks and every pair in one of them."""
    tables = []
    monkeypatch.setattr(keypoints, "written", lambda df, real=keypoints.written: tables.append(df) or real(df))
    monkeypatch.setattr(keypoints, "TOGETHER", 2)
    monkeypatch.setattr(keypoints, "COPIES", 2, raising=False)
    rng = np.random.default_rng(2)
    images = [np.kron(rng.integers(0, 255, (14, 14)), np.ones((9, 9))) for _ in range(4)]
    images += [x[9:, 18:] for x in images]
    rows = spark.createDataFrame([(i, keypoints.encode(x)) for i, x in enumerate(images)], "node long, image binary")
    pairs = spark.createDataFrame([(i, j) for i in range(8) for j in range(i + 1, 8)], "a long, b long")
    got = keypoints.verified(pairs, keypoints.features(rows, "image", ["node"]))
    assert sorted(tuple(r) for r in got.collect()) == [(i, i + 4) for i in range(4)]
    assert [t.columns for t in tables] == [["node", "blocks", "bits", "places"], ["a", "b"], ["a", "b"]]


def test_the_jvm_verifies_as_numpy_does(spark, monkeypatch):
    """Links and components are the same, and linked pairs join the same images without growing as their square, whatever is
    compared at once and however often a pair comes."""
    from loglattice.llm import common, votes

    rng = np.random.default_rng(12)
    base = [np.kron(rng.integers(0, 20, (8, 8)) * 13.0, np.ones((10, 10))) for _ in range(5)]
    images = [np.clip(np.rot90(x, k) + rng.normal(0, s, x.shape), 0, 255) for k, s in ((0, 0), (1, 6), (0, 25), (3, 40), (0, 10)) for x in base]
    images += [base[0][:70, 10:], np.kron(base[1], np.ones((2, 2))), np.zeros((80, 80)), base[2]]
    n = len(images)
    rows = spark.createDataFrame([(i, keypoints.encode(x)) for i, x in enumerate(images)], "image_id long, image binary")
    described = keypoints.features(rows, "image", ["image_id"]).withColumnRenamed("image_id", "node").where("n_features > 0").cache()
    nodes = [r.node for r in described.select("node").collect()]
    pairs = spark.createDataFrame([(i, j) for i in nodes for j in nodes if i < j] + [(0, n - 3)] * (n - 3 in nodes) + [(0, 5)] * 3, "a long, b long")
    want = sorted(map(tuple, keypoints.verified(pairs, described).collect()))
    assert len(want) > 10 and (0, 5) in want
    for held, together in ((1_000_000, 16_384), (2, 16_384), (3, 4)):
        monkeypatch.setattr(keypoints, "HELD", held)
        monkeypatch.setattr(keypoints, "TOGETHER", together)
        dealt = keypoints.verified(pairs, described, True)
        got = sorted(map(tuple, dealt.collect()))
        assert set(got) <= set(want) and common.forest(n, *np.array(got).T)[1].tolist() == common.forest(n, *np.array(want).T)[1].tolist()
        assert together == 4 or len(got) < len(want)
    monkeypatch.setattr(keypoints, "CLUSTER_BLOCK", 3)
    assert votes.ready(spark)
    whole = sorted(map(tuple, keypoints.near_duplicates(rows).collect()))
    monkeypatch.setattr(votes, "ready", lambda spark: False)
    assert whole == sorted(map(tuple, keypoints.near_duplicates(rows).collect())) and len(whole) == n
    assert max(r[2] for r in whole) > 2


def test_swept_lets_go_of_shuffle_files(spark):
    import gc

    from loglattice.llm import common

    files = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) - {""}
    common.swept(spark)
    before = files()
    gc.disable()
    try:
        common.written(spark.range(1000).repartition(3, "id"))
        made = files() - before
        assert made
        common.swept(spark)
        for _ in range(50):
            if not made & files():
                break
            time.sleep(0.1)
        assert not made & files()
    finally:
        gc.enable()


def test_states_start_from_all_rows_and_rounds_go_on_until_they_settle(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"{'ab'[i // 100]}{k}" for k in range(40)], k=30)) for i in range(200)]
    scores = []
    for order in (texts, texts[::-1]):
        df = spark.createDataFrame([(t,) for t in order], "text string")
        _, held, model = hmm.train(df)
        voc, now = hmm.Vocabulary(held), hmm.pickle.loads(model)
        docs = [voc.model_ids(hmm.tokens(t), voc.look_up(hmm.tokens(t))) for t in texts]
        scores.append(hmm.forward(docs, *now))
        again = hmm.forward(docs, *hmm.estimate(*hmm.expected(docs, *now)[:3], voc.single))
        assert (again - scores[-1]).sum() * math.log(10) < 1e-3 * voc.n
    assert np.allclose(*scores, atol=0.01)
