"""Hidden Markov language model (operator 5).

Words are counted exactly over all training documents. States emit the most frequent words and the end of a text by
themselves, all other words through classes to which a hash deals them; a word of a class has a smoothed share of it by its
own count, and the number of classes grows with the vocabulary. Each Baum-Welch round computes expected counts in every
partition and sums them in Spark; scores come from the scaled forward recursion. Long documents are cut into blocks whose
transfer matrices are computed side by side and then chained, which gives the same sums in fewer steps. Tables that reach
the workers have bounded sizes; counts of all other words are met by a join on the word.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import held_by_worker, map_arrow, slices, written

STATES = 8
#: Words that states emit by themselves, and words whose counts every worker holds; fixed sizes, whatever the corpus.
EMITTED, HELD = 16_384, 100_000
#: All other words are dealt to classes, about so many words to each; between so many classes.
TO_CLASS, LEAST_CLASSES, MOST_CLASSES = 128, 256, 131_072
#: Rounds go on until one raises the log likelihood (natural logarithm) of a token by less than this.
SETTLED = 1e-3
#: Padded tokens of the documents that one recursion takes side by side; distinct words counted before they are passed on.
SIDE_BY_SIDE, COUNTED = 1_000_000, 300_000
#: Rows of an Arrow batch that is passed on.
PASSED = 1 << 16
#: Documents of more tokens are cut into blocks of so many.
LONG, BLOCK = 1024, 256
#: Expected counts are summed as whole numbers of this unit, so that sums don't depend on their order.
UNIT = 1 << 20


def tokens(text: str) -> list[bytes]:
    """Words without their end token: bytes.lower and bytes.split do just A-Z and the six ASCII spaces."""
    return text.encode().lower().split()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of many texts, of all texts one after the other the number of each word, where an end counts as the
    word behind the last, and where each text begins and ends among them. The same words as by `tokens`."""
    # no cast before: Arrow's ascii_lower reads past the texts of a slice that was cast
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = parts.flatten().dictionary_encode()
    numbers, cuts = flat.indices.to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy())]
    distinct = flat.dictionary
    # white space at either end of a text leaves an empty word there
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        some = numbers != empty
        cuts, numbers = np.r_[0, np.cumsum(some)][cuts], numbers[some]
        numbers = numbers - (numbers > empty)
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1 :]])
    out, cuts = np.full(len(numbers) + len(texts), len(distinct), np.int64), cuts + np.arange(len(cuts))
    word = np.ones(len(out), bool)
    word[cuts[1:] - 1] = False
    out[word] = numbers
    return distinct, out, cuts


def groups(docs: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences by falling length: their numbers, ids as a (time, sequence) array, and how many have a token at each
    time."""
    sizes = np.array([len(d) for d in docs])
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, sizes[order[at]])
        part = order[at : at + max(1, most // longest)]
        ids = np.zeros((longest, len(part)), np.int32)
        for k, i in enumerate(part):
            ids[: sizes[i], k] = docs[i]
        yield part, ids, np.searchsorted(-sizes[part], -np.arange(longest), side="left")
        at += len(part)


def columns(rows: np.ndarray, ids: np.ndarray, one: np.ndarray) -> np.ndarray:
    """rows[ids] turned; the product with the unit matrix is the fastest way to turn narrow rows."""
    return one @ rows.take(ids, axis=0).T


def sweep(ids: np.ndarray, live: np.ndarray, begin: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The scaled forward recursion of sequences side by side, one row for each state; emit has one row for each id. `begin`
    holds the distributions over states before the first token. Returns the logs of all scales by sequence."""
    scales = np.ones(ids.shape, begin.dtype)
    turned, one, ones = np.ascontiguousarray(move.T), np.eye(len(move), dtype=begin.dtype), np.ones(len(move), begin.dtype)
    a = begin
    for t, n in enumerate(live.tolist()):
        a = (a if t == 0 else turned @ a[:, :n]) * columns(emit, ids[t, :n], one)
        s = ones @ a
        a /= s
        scales[t, :n] = s
    return np.log(scales).sum(0, dtype=float)


class Steps:
    """Sequences side by side without padding: one column for each token, those of a time beside each other. `emits` holds
    what states emit there, `alphas` is space of the same shape."""

    ROWS = 32_768

    def __init__(self, ids: np.ndarray, live: np.ndarray, emit: np.ndarray, space: np.ndarray):
        self.ids = ids[np.arange(ids.shape[1]) < live[:, None]].astype(np.intp)
        ends, states = np.cumsum(live).tolist(), emit.shape[1]
        self.at = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.alphas, self.emits = (x[: len(self.ids) * states].reshape(states, -1) for x in space)
        one = np.eye(states, dtype=emit.dtype)
        for k in range(0, len(self.ids), self.ROWS):
            self.emits[:, k : k + self.ROWS] = columns(emit, self.ids[k : k + self.ROWS], one)

    def forward(self, begin: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, float]:
        """Fills alphas with the scaled distributions and divides emits by their scales. Returns the last distribution of
        each sequence and the sum of the scales' logs."""
        ends, turned, ones = begin.copy(), np.ascontiguousarray(move.T), np.ones(len(move), move.dtype)
        scales = np.empty(len(self.ids), move.dtype)
        for t, at in enumerate(self.at):
            n, now, emits, s = at.stop - at.start, self.alphas[:, at], self.emits[:, at], scales[at]
            if t:
                np.matmul(turned, last[:, :n], out=now)
                now *= emits
                ends[:, n : last.shape[1]] = last[:, n:]
            else:
                np.multiply(begin, emits, out=now)
            np.matmul(ones, now, out=s)
            now /= s
            emits /= s
            last = now
        ends[:, : last.shape[1]] = last
        return ends, float(np.log(scales).sum(dtype=float))


class Cut:
    """Documents as blocks: each block's document, whether it's the document's first, and the ids."""

    def __init__(self, docs: list[np.ndarray]):
        self.docs, self.blocks, self.of = docs, [], []
        for i, d in enumerate(docs):
            parts = [d] if len(d) <= LONG else [d[k : k + BLOCK] for k in range(0, len(d), BLOCK)]
            self.blocks += parts
            self.of += [i] * len(parts)
        self.of = np.array(self.of, np.int64)
        self.first = np.r_[True, self.of[1:] != self.of[:-1]] if len(docs) else np.zeros(0, bool)
        self.last = np.r_[self.first[1:], True] if len(docs) else self.first
        self.long = np.flatnonzero(~(self.first & self.last))

    def matrices(self, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each block of a long document its transfer matrix, from states before its first token to states at its last,
        and the log of its scale. All matrices of a group are one array (state at the end, state at the begin, block)."""
        k = len(move)
        out, scale = np.zeros((len(self.blocks), k, k)), np.zeros(len(self.blocks))
        turned, one = np.ascontiguousarray(move.T), np.eye(k, dtype=move.dtype)
        top = emit.max(1) if len(self.long) else np.ones(len(emit))
        emit, tops = emit / top[:, None], np.log(top)
        for part, ids, live in groups([self.blocks[i] for i in self.long], SIDE_BY_SIDE // k):
            now, logs = np.repeat(one[:, :, None], len(part), 2), np.zeros(len(part))
            at, counts = self.long[part], [*live.tolist(), 0]
            for t, n in enumerate(counts[:-1]):
                if t:
                    now = (turned @ now[:, :, :n].reshape(k, k * n)).reshape(k, k, n)
                now *= columns(emit, ids[t, :n], one)[:, None, :]
                logs[:n] += tops.take(ids[t, :n])
                if t % 4 == 3 or counts[t + 1] < n:
                    s = now.reshape(k * k, n).sum(0)
                    now /= s
                    logs[:n] += np.log(s)
                if counts[t + 1] < n:
                    done = slice(counts[t + 1], n)
                    out[at[done]] = now[:, :, done].transpose(2, 1, 0)
            scale[at] = logs
        return out, scale

    def chained(self, start: np.ndarray, move: np.ndarray, matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each block the distribution before its first token, the backward vector at its last, up to scale, and of those
        of long documents the log of the sum that its matrix leaves of that distribution. Documents go side by side."""
        k, n = len(start), len(self.blocks)
        begin, back, logs = np.tile(start[:, None], n), np.ones((k, n)), np.zeros(n)
        firsts = self.long[self.first[self.long]]
        sizes = self.long[self.last[self.long]] - firsts + 1
        firsts, sizes = firsts[order := np.argsort(-sizes, kind="stable")], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0) + 1), side="left")
        for r, m in enumerate(live[:-1]):
            i = firsts[:m] + r
            a = np.einsum("kn,nkj->jn", begin[:, i], matrices[i])
            total = a.sum(0)
            logs[i] = np.log(total)
            on = live[r + 1]
            begin[:, i[:on] + 1] = move.T @ (a / total)[:, :on]
        for r in range(len(live) - 3, -1, -1):
            i = firsts[: live[r + 1]] + r
            b = move @ np.einsum("nkj,jn->kn", matrices[i + 1], back[:, i + 1])
            back[:, i] = b / b.max(0)
        return begin, back, logs


def forward(docs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 likelihood of each id sequence. emit has one row for each id."""
    cut, out = Cut(docs), np.zeros(len(docs))
    matrices, scale = cut.matrices(move, emit)
    whole = np.flatnonzero(cut.first & cut.last)
    for part, ids, live in groups([cut.blocks[i] for i in whole], SIDE_BY_SIDE):
        out[cut.of[whole[part]]] = sweep(ids, live, np.tile(start[:, None], len(part)), move, emit)
    out += np.bincount(cut.of[cut.long], (scale + cut.chained(start, move, matrices)[2])[cut.long], len(docs))
    return out / np.log(10)


def expected(docs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected counts: of first states, of moves, and of emissions (id, state); the log likelihood."""
    # single precision: each step is scaled to one, and sums are kept in double precision
    emit32, move32 = np.ascontiguousarray(emit, np.float32), move.astype(np.float32)
    k = len(start)
    firsts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(emit)))
    cut = Cut(docs)
    begin, back, _ = cut.chained(start, move, cut.matrices(move32, emit32)[0])
    ends, weights = np.zeros((k, len(cut.blocks))), np.zeros((k, len(cut.blocks)))
    total, space = 0.0, np.empty((2, 0), np.float32)
    for part, ids, live in groups(cut.blocks, SIDE_BY_SIDE):
        if space.shape[1] < live.sum() * k:
            space = np.empty((2, live.sum() * k), np.float32)
        steps = Steps(ids, live, emit32, space)
        last, logs = steps.forward(begin[:, part].astype(np.float32), move32)
        total += logs
        ends[:, part] = last
        final = back[:, part]
        beta = (final / (last * final).sum(0)).astype(np.float32)
        for t in range(len(live) - 1, -1, -1):
            now, b = steps.alphas[:, steps.at[t]], beta[:, : live[t]]
            weight = steps.emits[:, steps.at[t]] * b
            now *= b
            if t:
                moves += steps.alphas[:, steps.at[t - 1]][:, : live[t]] @ weight.T
                np.matmul(move32, weight, out=b)
            else:
                weights[:, part[: live[t]]] = weight
                firsts += now[:, cut.first[part[: live[t]]]].sum(1, dtype=float)
        # what was a distribution is now what is expected of it
        for j in range(k):
            emits[j] += np.bincount(steps.ids, steps.alphas[j], len(emit))
    inner = np.flatnonzero(~cut.first)
    moves += ends[:, inner - 1] @ weights[:, inner].T
    return firsts, moves * move, np.ascontiguousarray(emits.T), total


def estimate(firsts: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters from expected counts; `prior` are the emissions of a single state, worth one token in each."""
    start = (firsts + 1) / (firsts.sum() + len(firsts))
    move = (moves + 1) / (moves.sum(1, keepdims=True) + len(firsts))
    emit = (emits + prior[:, None]) / (emits.sum(0) + 1)
    return start, move, emit


class Vocabulary:
    """Words by falling count. Ids below `emitted` are emitted by states; then come the classes of all others, then the
    end of a text."""

    def __init__(self, data: bytes):
        words, counts, self.emitted, rest, kinds, self.n, self.v, self.end_count = pickle.loads(data)
        self.ids = {w: i for i, w in enumerate(words)}
        counts = np.array(counts, float)
        self.classes = len(rest)
        self.base = np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1))) if self.n else np.zeros(0)
        self.end_base = np.log10((self.end_count + 0.1) / (self.n + 0.1 * (self.v + 1)))
        self.class_of = np.array([zlib.crc32(w) % self.classes for w in words], np.int64)
        #: What states emit for each held word, and a last place that stands for all others.
        self.model_id = np.append(np.where(np.arange(len(words)) < self.emitted, np.arange(len(words)), self.emitted + self.class_of), 0)
        self.log_class = np.log10(rest + 0.1 * (kinds + 1))
        self.share = np.log10(counts + 0.1) - self.log_class[self.class_of]
        single = np.concatenate([counts[: self.emitted], rest + 0.1, [self.end_count + 0.1]]) + 1e-3
        self.single = single / single.sum()
        self.kind = np.uint16 if len(single) <= 1 << 16 else np.int32

    def model_ids(self, got: list[bytes], ids: np.ndarray) -> np.ndarray:
        """What states emit for words, whose ids are -1 where they aren't held, with the end."""
        out = np.empty(len(ids) + 1, self.kind)
        out[:-1] = self.model_id[ids]
        for i in np.flatnonzero(ids < 0).tolist():
            out[i] = self.emitted + zlib.crc32(got[i]) % self.classes
        out[-1] = self.emitted + self.classes
        return out

    def look_up(self, got: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, got, itertools.repeat(-1)), np.int64, len(got))


@held_by_worker
def vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


@held_by_worker
def parameters(data: bytes):
    return pickle.loads(data)


def count_words(df: DataFrame, text: str) -> DataFrame:
    """token, c: each word's count in all texts; the null token counts the texts, hence the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"})

        for batch in slices(batches, text):
            distinct, numbers, _ = words(batch.column(text))
            held.append(pa.table({"token": distinct, "c": np.bincount(numbers, minlength=len(distinct))[: len(distinct)]}))
            ends += batch.num_rows
            if sum(map(len, held)) > 2 * COUNTED:
                held = [summed()]
                if len(held[0]) > COUNTED:
                    yield from passed(held[0])
                    held = []
        if held:
            yield from passed(summed())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([ends], pa.int64())], names=["token", "c"])

    def passed(counts: pa.Table) -> list[pa.RecordBatch]:
        return counts.select(["token", "c"]).to_batches(PASSED)

    return df.select(text).mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def threshold(levels: list[tuple[int, int]], most: int) -> int:
    """The smallest level from which on there are at most `most` words; levels are (level, words), any order."""
    total, least = 0, None
    for level, n in sorted(levels, reverse=True):
        total += n
        if total > most:
            break
        least = level
    return least if least is not None else 1 << 62


def build_vocabulary(counts: DataFrame) -> bytes:
    """What workers hold. Counts below 4096 are levels of their own, larger ones go by their logarithm, so that the
    number of levels is bounded too."""
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2(F.col("c").cast("double") / 4096) * 64)).cast("long")
    words = counts.where(F.col("token").isNotNull()).withColumn("level", level)
    stats = words.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    ends = counts.where(F.col("token").isNull()).agg(F.sum("c")).first()[0] or 0
    levels = [(r["level"], r["n"]) for r in stats]
    held, emitted = threshold(levels, HELD), threshold(levels, EMITTED)
    got = words.where(F.col("level") >= held).select("token", "c", "level").toArrow()
    order = sorted(zip(got["token"].to_pylist(), got["c"].to_pylist(), got["level"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    n, v = sum(r["c"] for r in stats) + ends, sum(r["n"] for r in stats) + (ends > 0)
    others = sum(r["n"] for r in stats if r["level"] < emitted)
    classes = min(MOST_CLASSES, max(LEAST_CLASSES, (1 << (others // TO_CLASS).bit_length()) // 2))
    dealt = words.where(F.col("level") < emitted).groupBy(class_of(F.col("token"), classes).alias("class")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
    rest, kinds = np.zeros(classes), np.zeros(classes)
    at = dealt["class"].to_numpy().astype(np.int64)
    rest[at], kinds[at] = dealt["c"].to_numpy(), dealt["n"].to_numpy()
    return pickle.dumps(([w.encode() for w, *_ in order], [c for _, c, _ in order], sum(x >= emitted for *_, x in order), rest, kinds, n, v, ends))


def class_of(word: Column, classes: int) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), F.lit(classes))


def first_parameters(emits: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where Baum-Welch starts: emissions of the documents dealt to each state, and states that rarely change."""
    stay = np.full((STATES, STATES), 0.05 / max(1, STATES - 1)) + np.eye(STATES) * (0.95 - 0.05 / max(1, STATES - 1))
    return np.full(STATES, 1 / STATES), stay, (emits + prior[:, None]) / (emits.sum(0) + 1)


def train(df: DataFrame, text: str = "text") -> tuple[DataFrame, bytes, bytes]:
    """Counts of all words, what workers hold, and the model, from all rows of df. Null texts count as empty."""
    spark = df.sparkSession
    counts = written(count_words(df, text))
    held = build_vocabulary(counts)
    voc = Vocabulary(held)
    rows = written(numbered(df, text, spark.sparkContext.broadcast(held)))
    now, last = first_parameters(baum_welch(rows, len(voc.single))[2], voc.single), None
    while True:
        *sums, logs = baum_welch(rows, len(voc.single), now)
        now = estimate(*sums, voc.single)
        if last is not None and logs - last < SETTLED * voc.n or not voc.n:
            return counts, held, pickle.dumps(now)
        last = logs


def numbered(df: DataFrame, text: str, shared) -> DataFrame:
    """ids (packed, what states emit) of each row, and the state to which a hash of its text deals it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        voc, texts = vocabulary(shared.value), batch.column(text)
        distinct, numbers, cuts = words(texts)
        got = distinct.cast(pa.binary()).to_pylist()
        ids = voc.model_ids(got, voc.look_up(got))[numbers]
        packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(cuts * ids.itemsize), pa.py_buffer(ids)])
        states = [zlib.crc32(t or b"") % STATES for t in texts.cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([packed.cast(pa.binary()), pa.array(states, pa.int32())], names=["ids", "state"])

    return map_arrow(df.select(text), run, "ids binary, state int", text)


def baum_welch(rows: DataFrame, size: int, now=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One round's expected counts and log likelihood over all rows; without parameters, counts of the states to which
    rows are dealt. Rows of the sums: first states at -1, moves from state i at -2-i, the likelihood at -2-STATES, else
    emissions of an id."""
    params = rows.sparkSession.sparkContext.broadcast(pickle.dumps(now))
    cols = [f"s{j}" for j in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = parameters(params.value), None
        kind = np.uint16 if size <= 1 << 16 else np.int32
        for batch in slices(batches, "ids"):
            docs = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            if model is None:
                state = np.repeat(batch.column("state").to_numpy(), [len(d) for d in docs])
                emits = np.bincount(np.concatenate(docs).astype(np.int64) * STATES + state, minlength=size * STATES).reshape(size, STATES)
                got = np.zeros(STATES), np.zeros((STATES, STATES)), emits.astype(float), 0.0
            else:
                got = expected(docs, *model)
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            ids = np.concatenate([[-1], -2 - np.arange(STATES + 1), np.arange(size)])
            likelihood = np.eye(1, STATES) * total[3]
            values = np.rint(np.concatenate([total[0][None], total[1], likelihood, total[2]]) * UNIT).astype(np.int64)
            some = values.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some].astype(np.int64)), *(pa.array(values[some, j]) for j in range(STATES))], names=["id", *cols])

    sums = rows.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in cols)).groupBy("id").agg(*(F.sum(c).alias(c) for c in cols)).toArrow()
    full = np.zeros((2 + STATES + size, STATES))
    ids = sums["id"].to_numpy()
    full[np.where(ids < 0, -1 - ids, 2 + STATES + ids)] = np.stack([sums[c].to_numpy() for c in cols], 1) / UNIT if len(ids) else np.zeros((0, STATES))
    params.unpersist()
    return full[0], full[1 : 1 + STATES], full[2 + STATES :], full[1 + STATES, 0]


def score(df: DataFrame, counts: DataFrame, held: bytes, model: bytes, key: str = "doc_id", text: str = "text", flag: str = "held_out") -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null text is
    empty: its end is its only token. Repeated keys are scored each; a null key stays null."""
    sc = df.sparkSession.sparkContext
    shared, params = sc.broadcast(held), sc.broadcast(model)
    voc = Vocabulary(held)
    n, v = voc.n, voc.v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, model = vocabulary(shared.value), parameters(params.value)
        for batch in slices(batches, text):
            distinct, numbers, cuts = words(batch.column(text))
            got = distinct.cast(pa.binary()).to_pylist()
            ids = voc.look_up(got)
            model_ids = voc.model_ids(got, ids)[numbers]
            whole = forward([model_ids[a:b] for a, b in itertools.pairwise(cuts.tolist())], *model)
            # of each distinct word and the end: whether it's known, and logarithms, which are zero for words that aren't held
            have = np.append(ids >= 0, voc.end_count > 0)
            base, share = np.append(np.zeros(len(ids)), voc.end_base), np.zeros(len(have))
            held = np.flatnonzero(ids >= 0)
            base[held], share[held] = voc.base[ids[held]], np.where(ids[held] < voc.emitted, 0, voc.share[ids[held]])
            known, base, share = (np.add.reduceat(x[numbers], cuts[:-1], dtype=kind) for x, kind in ((have, np.int64), (base, float), (share, float)))
            # rare words of each text and how often it has them
            at = np.flatnonzero(np.append(ids < 0, False)[numbers])
            row = np.searchsorted(cuts, at, side="right") - 1
            pairs, times = np.unique(row * len(have) + numbers[at], return_counts=True)
            row, word = np.divmod(pairs, len(have))
            rare = pa.StructArray.from_arrays([distinct.take(pa.array(word)), pa.array(times, pa.int64())], names=["token", "tf"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), rare)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(flag), pa.array(np.diff(cuts)), pa.array(known), pa.array(base), pa.array(whole + share), rare],
                names=[key, flag, "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    schema = f"{key} long, {flag} boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<token:string,tf:long>>"
    scored = written(df.select(F.col(key).cast("long").alias(key), flag, text).mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))
    c = F.coalesce("c", F.lit(0))
    # words that workers don't hold: their counts, and the totals of their classes, of which there is a bounded number
    totals = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(voc.log_class.tolist())), "class long, log_class double"))
    rare = scored.select("_row", F.explode("rare").alias("w")).select("_row", "w.token", "w.tf").join(counts.where(F.col("token").isNotNull()), "token", "left")
    rare = rare.withColumn("class", class_of(F.col("token"), voc.classes)).join(totals, "class")
    # summed as whole numbers of 2^-30, so that the order of rows doesn't show in the result
    whole = lambda x: F.sum(F.round(x * (1 << 30)).cast("long"))
    per_row = rare.groupBy("_row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("_known"),
        whole(F.col("tf") * F.log10((c + 0.1) / (n + 0.1 * (v + 1)))).alias("_base"),
        whole(F.col("tf") * (F.log10(c + 0.1) - F.col("log_class"))).alias("_share"),
    )
    plus = lambda name, extra: (F.col(name) + F.coalesce(F.col(extra), F.lit(0)) / (1 << 30)).alias(name)
    return scored.join(per_row, "_row", "left").select(
        F.col(key).alias("doc_id"), F.col(flag).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base_score", "_base"), plus("score", "_share")
    )


def score_corpus(df: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows for which held_out is false and score all rows."""
    docs = df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text), held_out.alias("held_out"))
    counts, held, model = train(docs.where(~F.col("held_out")), text)
    return score(docs, counts, held, model, key, text)


