"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class given what stands before it, times that of its slot within the class
given the same, times its share of the slot by smoothed training counts. Both softmaxes have weights for hashed n-gram
and skip features, of preceding words and of their classes. Frequent words have slots of their own; which class a word
falls into is learned from the company it keeps: the frequent words are clustered by their neighbourhoods, and every
other word joins the group that most of its occurrences stand next to.

Training: weights start at what the counts of features with classes say, and then take gradient steps. Each step sums
expected counts over all training tokens, so it does not depend on how the tokens are dealt to tasks.

Texts are turned into arrays of ids once, in chunks that know their own words (by 64-bit hashes); only the words of
chunks are shuffled, to be counted and to get their counts back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Staged, ship, table

#: Classes, slots of each, and groups of words that keep like company.
CLASSES, SLOTS, GROUPS = 32, 32, 8
#: Frequent words that are clustered, and slots of a class that they may have for themselves.
HEADS, OWN = 256, 16
#: Weight rows of each feature: one for so many training tokens, within these bounds (weights are broadcast: 1 KB a row).
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 1 << 14, 1 << 12, 1 << 15
#: Distances of the preceding words, and of the preceding words' classes, that the features of a class combine.
WORD_FEATURES = ((1,), (2, 1), (2,), (3,))
CLASS_FEATURES = ((1, 2, 3), (4, 5, 6))
#: Those of a slot, each together with the class.
SLOT_FEATURES = ((1,), (2, 1))
#: Gradient steps, and the share of a full diagonal step that each takes.
ROUNDS, RATE = 2, 0.4
#: UTF-8 bytes of a chunk, tokens that are worked on at once, bytes of ids for one training task, words of chunks that
#: are counted together.
CHUNK, STEP, TASK_BYTES, BATCH_WORDS = 8 << 20, 1 << 15, 256 << 20, 2 << 20
#: Tokens whose scores are made at once, so that they stay in a core's cache, and the largest score of which exp(), and the
#: sum of 32 of these, is a 32-bit float of full precision.
BLOCK, PLAIN = 1 << 11, 80.0
END = b"\n"

_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


class _Before(dict):
    """The values at a distance before each token. place: the token's number in its text; what stands before a text's
    beginning counts as one and the same value."""

    def __init__(self, values: np.ndarray, place: np.ndarray):
        self.values, self.place = values, place

    def __missing__(self, d: int) -> np.ndarray:
        n = len(self.values)
        self[d] = back = np.ones(n, np.uint64)
        back[d:] = self.values[: max(n - d, 0)]
        back[self.place < d] = 1
        return back


def context_rows(before: _Before, distances: tuple[int, ...], salt: int, rows: int) -> np.ndarray:
    """A row for each token, hashed from the values at these distances before it."""
    h = before[distances[0]] ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for i, d in enumerate(distances):
        if i:
            h ^= before[d]
        h *= _MIX
        h ^= h >> np.uint64(32)
    h = h & np.uint64(rows - 1) if rows & (rows - 1) == 0 else h % np.uint64(rows)
    return h.view(np.int64)


def feature_rows(hashes: np.ndarray, classes: np.ndarray, place: np.ndarray, rows: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the class features and of the slot features (each class has rows of its own), for tokens laid end to end."""
    named = classes.astype(np.uint64) + np.uint64(2)
    words, groups = _Before(hashes, place), _Before(named, place)
    first = [context_rows(words, d, i + 1, rows) for i, d in enumerate(WORD_FEATURES)]
    first += [context_rows(groups, d, i + 11, rows) for i, d in enumerate(CLASS_FEATURES)]
    own = rows // CLASSES
    return first, [classes * own + context_rows(words, d, i + 21, own) for i, d in enumerate(SLOT_FEATURES)]


def plain(bias: np.ndarray, weights: np.ndarray) -> bool:
    """Whether no score can be beyond PLAIN."""
    return bool(np.abs(bias).max() + sum(np.abs(w).max() for w in weights) <= PLAIN)


def _scores(bias: np.ndarray, of: np.ndarray | None, weights: np.ndarray, rows: list[np.ndarray], powers: bool) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores (tokens x outcomes) up to a constant for each token, the largest 0, for BLOCK tokens at a time, in memory
    that the next ones take over. bias: of outcomes, or row and outcome (of: each token's row); weights: feature, row,
    outcome. powers: bias and weights are exp() of what they were, and so are the scores."""
    n, many = len(rows[0]), weights.shape[2]
    whole, other = np.empty((2, min(BLOCK, n), many), weights.dtype)
    join = np.multiply if powers else np.add
    for a in range(0, n, BLOCK):
        part = slice(a, min(a + BLOCK, n))
        z, more = whole[: part.stop - a], other[: part.stop - a]
        weights[0].take(rows[0][part], axis=0, out=z, mode="clip")
        for w, r in zip(weights[1:], rows[1:], strict=True):
            join(z, w.take(r[part], axis=0, out=more, mode="clip"), out=z)
        join(z, bias if of is None else bias.take(of[part], axis=0), out=z)
        if not powers:
            z -= z.max(axis=1, keepdims=True)
        yield part, z


def log_scores(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray], outcomes: np.ndarray, of: np.ndarray | None = None, powers: bool = False) -> np.ndarray:
    """Log probability of each token's outcome."""
    out, ones = np.empty(len(outcomes), weights.dtype), np.ones(weights.shape[2], weights.dtype)
    for part, z in _scores(bias, of, weights, rows, powers):
        own = z[np.arange(len(z)), outcomes[part]]
        out[part] = np.log(own) - np.log(z @ ones) if powers else own - np.log(np.exp(z, out=z) @ ones)
    return out


def shares(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray], of: np.ndarray | None = None, powers: bool = False, room: np.ndarray | None = None) -> np.ndarray:
    """Probabilities (outcomes x tokens). room: where they may lie, for as many tokens at least."""
    out = (np.empty((weights.shape[2], len(rows[0]))) if room is None else room)[:, : len(rows[0])]
    ones = np.ones(weights.shape[2], weights.dtype)
    for part, z in _scores(bias, of, weights, rows, powers):
        if not powers:
            np.exp(z, out=z)
        out[:, part] = z.T
        out[:, part] *= 1 / (z @ ones).astype(np.float64)
    return out


class Model:
    """Weights of both softmaxes. bias: class; inner: class and slot. powers: whether the first and the second are exp() of
    their weights."""

    def __init__(self, bias: np.ndarray, inner: np.ndarray, outer_weights: np.ndarray, inner_weights: np.ndarray, powers: tuple[bool, bool] = (False, False)):
        self.bias, self.inner, self.outer_weights, self.inner_weights, self.powers = bias, inner, outer_weights, inner_weights, powers

    def settled(self) -> Model:
        """The same model to score with: where no score is large, weights are multiplied instead of added, which spares
        exp() of every token's 32 scores."""
        one, two = (self.bias, self.outer_weights), (self.inner, self.inner_weights)
        powers = (plain(*one), plain(*two))
        (bias, outer), (inner, slots) = ([np.exp(x) for x in w] if p else w for w, p in zip((one, two), powers, strict=True))
        return Model(bias, inner, outer, slots, powers)

    def expected(self, first: list[np.ndarray], second: list[np.ndarray], classes: np.ndarray, room: np.ndarray) -> Iterator[np.ndarray]:
        """Probabilities of classes, then in the same room of slots in each token's class."""
        yield shares(self.bias, self.outer_weights, first, None, self.powers[0], room)
        yield shares(self.inner, self.inner_weights, second, classes, self.powers[1], room)

    def leaf_scores(self, first: list[np.ndarray], second: list[np.ndarray], classes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Log probability of each token's class and slot."""
        outer = log_scores(self.bias, self.outer_weights, first, classes, None, self.powers[0])
        return outer + log_scores(self.inner, self.inner_weights, second, slots, classes, self.powers[1])


def _counts(rows: list[np.ndarray], mass: np.ndarray, into: np.ndarray) -> None:
    """Add each token's mass (outcomes x tokens) to the rows of its features (into: feature, outcome, row)."""
    for f, r in enumerate(rows):
        for c in range(len(mass)):
            into[f, c] += np.bincount(r, mass[c], into.shape[2])


def _observed(rows: list[np.ndarray], outcomes: np.ndarray, into: np.ndarray) -> None:
    size, many = into.shape[1:]
    for f, r in enumerate(rows):
        into[f] += np.bincount(outcomes * many + r, minlength=many * size).reshape(size, many)


def initial_weights(observed: np.ndarray, share: np.ndarray, damp: float = 4.0) -> np.ndarray:
    """Weights by which each feature alone moves the outcomes from their share (of all, or for each row) towards what was
    observed with it, taken in parts as features agree with each other."""
    total = observed.sum(axis=2, keepdims=True)
    seen = (observed + damp * share) / (total + damp)
    return (np.log(seen / share) * (1.5 / len(observed))).astype(np.float32)


def stepped(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray, rate: float = RATE, damp: float = 4.0) -> np.ndarray:
    """Weights after a step along the gradient of the log likelihood (observed less expected counts), each scaled by its
    curvature, which the expected count stands for."""
    return (weights + np.clip(rate * (observed - expected) / (expected + damp), -1.0, 1.0)).astype(np.float32)


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _coded(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Chunks of texts as ids of the chunk's own words."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    nth, size = 0, 0
    keys: list[pa.Array] = []
    held: list[bool] = []
    sizes: list[int] = []
    ids: list[np.ndarray] = []
    index = _Numbers({END: 0})

    def made() -> pa.RecordBatch:
        nonlocal nth
        flat, each = np.concatenate(ids), np.array(sizes, np.int64)
        learned = np.repeat(~np.array(held), each)
        n = np.bincount(flat[learned], minlength=len(index))
        hashes = np.fromiter(map(word_hash, index), np.uint64, len(index))
        often = np.flatnonzero(n * 10_000 >= max(1, learned.sum()))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, list) else values)
        columns = [
            pa.array([task << 32 | nth], pa.int64()), one(pa.concat_arrays(keys), None), one(held, pa.bool_()),
            pa.array([each.astype("<i4").tobytes()], pa.binary()), pa.array([flat.astype("<i4").tobytes()], pa.binary()),
            pa.array([n.astype("<i4").tobytes()], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
            one(pa.array(hashes[often].view(np.int64)), None), one(pa.array(n[often], pa.int64()), None),
        ]
        nth += 1
        return pa.RecordBatch.from_arrays(columns, ["chunk", "keys", "held", "sizes", "ids", "n", "hashes", "often", "often_n"])

    for batch in batches:
        values, begin = batch.column("text").cast(pa.binary()), 0
        for i, (t, h) in enumerate(zip(values, batch.column("held").to_pylist(), strict=True)):
            words = (t.as_py() or b"").lower().split()
            words.append(END)
            ids.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            held.append(h)
            sizes.append(len(words))
            size += len(t.as_py() or b"") + 1
            if size >= chunk_bytes:
                keys.append(batch.column("key").slice(begin, i + 1 - begin))
                yield made()
                begin, size, index = i + 1, 0, _Numbers({END: 0})
                keys, held, sizes, ids = [], [], [], []
        if begin < len(batch):
            keys.append(batch.column("key").slice(begin))
    if ids:
        yield made()


def _counted(least: int, named: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of a chunk's words that occur so often there, of all or of those that are named."""
    for batch in batches:
        for row in batch.to_pylist():
            words, n = np.frombuffer(row["hashes"], "<i8"), np.frombuffer(row["n"], "<i4").astype(np.int64)
            some = n >= least
            if named is not None:
                some &= np.isin(words, named)
            yield pa.RecordBatch.from_arrays([pa.array(words[some]), pa.array(n[some])], ["word", "n"])


def frequent(coded: DataFrame, most: int, named: int = 1 << 16) -> np.ndarray:
    """The hashes of the `most` words that training tokens hold most often, of equally frequent ones those with the
    smaller hash (as a signed number).

    Chunks list the words that are frequent there; so many words have the sums of these at least, the smallest of which is
    a bound. A word of that count has its share of it in one chunk or more, so words that reach the share nowhere are out,
    and so are those that cannot reach the bound with what the other chunks may hold. What is left, some more than `most`,
    is counted in all chunks; if more than `named` are left, then all words are.
    """
    chunks = coded.count()
    best = lambda df: [r["n"] for r in df.orderBy(F.desc("n")).limit(most).collect()]

    def counts(least: int, names: np.ndarray | None = None) -> DataFrame:
        rows = coded.select("hashes", "n").mapInArrow(lambda b: _counted(least, names, b), "word long, n long")
        return rows.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks"))

    listed = coded.select(F.explode(F.arrays_zip("often", "often_n")).alias("x")).groupBy("x.often").agg(F.sum("x.often_n").alias("n"))
    sums = best(listed)
    bound = sums[-1] if len(sums) == most else 0
    least = max(1, -(-bound // max(1, chunks)))
    names = None
    if least > 1:
        may = counts(least).filter(F.col("n") + (chunks - F.col("chunks")) * (least - 1) >= bound)
        left = [r["word"] for r in may.select("word").limit(named + 1).collect()]
        names = np.array(left, np.int64) if len(left) <= named else None
    top = counts(1, names).orderBy(F.desc("n"), "word").limit(most).collect()
    return np.array([r["word"] for r in top], np.int64).view(np.uint64)


def _laid(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, text of each token, place in it, and whether it is learned from."""
    ids, sizes = np.frombuffer(row["ids"], "<i4"), np.frombuffer(row["sizes"], "<i4").astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return ids, of, np.arange(len(ids)) - (np.cumsum(sizes) - sizes)[of], ~np.array(row["held"], bool)[of]


def _numbered(hashes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Where each hash stands in a list, -1 if it does not."""
    if not len(listed):
        return np.full(len(hashes), -1)
    order = np.argsort(listed)
    at = order[np.minimum(np.searchsorted(listed[order], hashes), len(listed) - 1)]
    return np.where(listed[at] == hashes, at, -1)


def _neighbours(model, batches: Iterator[pa.RecordBatch], reach: int = 4) -> Iterator[pa.RecordBatch]:
    """How often two frequent words stand within reach of each other."""
    total = np.zeros((HEADS, HEADS))
    for batch in batches:
        for row in batch.to_pylist():
            ids, of, _, learned = _laid(row)
            head = _numbered(np.frombuffer(row["hashes"], np.uint64), model.value)[ids]
            head[~learned] = -1
            for d in range(1, reach + 1):
                both = np.flatnonzero((head[d:] >= 0) & (head[:-d] >= 0) & (of[d:] == of[:-d]))
                total += np.bincount(head[both] * HEADS + head[both + d], minlength=HEADS**2).reshape(HEADS, HEADS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["raw"])


def grouped(near: np.ndarray, groups: int = GROUPS, rounds: int = 25) -> np.ndarray:
    """A group for each frequent word: k-means of the directions of their rows of surprising neighbours."""
    near = near + near.T + 1e-9
    by = near.sum(axis=1, keepdims=True)
    x = np.maximum(np.log(near * near.sum() / (by * by.T)), 0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = [x[0]]
    for _ in range(groups - 1):  # each further centre is the word farthest from those before
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for g in range(groups):
            if (own == g).any():
                c = x[own == g].mean(axis=0)
                centres[g] = c / max(np.linalg.norm(c), 1e-12)
    return own


def _asked(model, batches: Iterator[pa.RecordBatch], reach: int = 8) -> Iterator[pa.RecordBatch]:
    """A chunk's words, dealt by hash: hashes, training counts, and the group that most of a word's occurrences there
    stand next to, with their number. No more rows than words."""
    heads, groups, many_batches = model.value
    for batch in batches:
        for row in batch.to_pylist():
            ids, of, _, learned = _laid(row)
            hashes = np.frombuffer(row["hashes"], np.uint64)
            head = _numbered(hashes, heads)
            many, n = len(hashes), len(ids)
            group = np.where(head >= 0, groups[head], -1)[ids]
            at = np.arange(n)
            mark = np.where(group >= 0, at, -1)
            before, after = np.full(n, -1), np.full(n, n)
            before[1:] = np.maximum.accumulate(mark)[:-1]
            after[:-1] = np.minimum.accumulate(np.where(mark >= 0, mark, n)[::-1])[::-1][1:]
            left = np.where((before >= 0) & (of[before] == of), at - before, n)
            right = np.where((after < n) & (of[np.minimum(after, n - 1)] == of), after - at, n)
            nearest = np.where(left <= right, before, np.minimum(after, n - 1))
            some = np.flatnonzero(learned & (np.minimum(left, right) <= reach))
            votes = np.bincount(ids[some].astype(np.int64) * GROUPS + group[nearest[some]], minlength=many * GROUPS).reshape(many, GROUPS)
            n, g, v = np.frombuffer(row["n"], "<i4"), votes.argmax(axis=1).astype(np.uint8), votes.max(axis=1).astype("<i4")
            for b, own in _dealt(hashes, many_batches):
                raw = [hashes[own].tobytes(), n[own].tobytes(), g[own].tobytes(), v[own].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["chunk"]], pa.int64()), *[pa.array([x], pa.binary()) for x in raw]], ["b", "chunk", "h", "n", "g", "v"])


def _dealt(hashes: np.ndarray, many: int) -> Iterator[tuple[int, np.ndarray]]:
    """(batch, words in it) of the words with these hashes."""
    of = ((hashes >> np.uint64(20)) % np.uint64(many)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    for own in np.split(order, cuts):
        yield int(of[own[0]]), own


def _answered(model, table_: pa.Table) -> pa.Table:
    """Counts of all words of a batch and their leaves, for each chunk in the order in which it asked; and in a row
    without a chunk, tokens and words of each leaf."""
    heads, own_leaf = model.value
    b = table_.column("b")[0].as_py()
    h, n, g, v = (np.frombuffer(b"".join(table_.column(c).to_pylist()), k) for c, k in (("h", np.uint64), ("n", "<i4"), ("g", np.uint8), ("v", "<i4")))
    words, of = np.unique(h, return_inverse=True)
    total = np.bincount(of, n, len(words)).astype(np.int64)
    votes = np.bincount(of * GROUPS + g, v, len(words) * GROUPS).reshape(-1, GROUPS)
    group = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), (words >> np.uint64(40)) % np.uint64(GROUPS)).astype(np.int64)
    spread, mixed = CLASSES // GROUPS, words * _MIX
    leaf = (group * spread + (mixed >> np.uint64(60)).astype(np.int64) % spread) * SLOTS + OWN + (mixed >> np.uint64(32)).astype(np.int64) % (SLOTS - OWN)
    head = _numbered(words, heads)
    leaf = np.where(head >= 0, own_leaf[head], leaf)
    leaf = np.where(leaf >= 0, leaf, group * spread * SLOTS + OWN)
    known = total > 0
    sums = np.stack([np.bincount(leaf, total, CLASSES * SLOTS), np.bincount(leaf, known, CLASSES * SLOTS)]).astype("<i8")
    chunks, sizes = table_.column("chunk").to_pylist(), [len(x) // 8 for x in table_.column("h").to_pylist()]
    ends = np.cumsum(sizes)
    counts = [total[of[e - k : e]].astype("<i8").tobytes() for e, k in zip(ends.tolist(), sizes, strict=True)]
    leaves = [leaf[of[e - k : e]].astype("<i2").tobytes() for e, k in zip(ends.tolist(), sizes, strict=True)]
    many = len(chunks) + 1
    return pa.table({"of": pa.array([*chunks, None], pa.int64()), "b": pa.array([b] * many, pa.int32()), "counts": pa.array([*counts, sums.tobytes()], pa.binary()), "leaves": pa.array([*leaves, None], pa.binary())})


def _gathered(many_batches: int):
    def gather(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """The chunk with the counts and leaves of its words, in the order of its list."""
        hashes = np.frombuffer(chunk.column("hashes")[0].as_py(), np.uint64)
        found = {b: (c, x) for b, c, x in zip(*[answers.column(c).to_pylist() for c in ("b", "counts", "leaves")], strict=True)}
        counts, leaves = np.zeros(len(hashes), "<i8"), np.zeros(len(hashes), "<i2")
        for b, own in _dealt(hashes, many_batches):
            counts[own], leaves[own] = np.frombuffer(found[b][0], "<i8"), np.frombuffer(found[b][1], "<i2")
        return chunk.append_column("counts", pa.array([counts.tobytes()], pa.binary())).append_column("leaves", pa.array([leaves.tobytes()], pa.binary()))

    return gather


def _pieces(row: dict, rows: int, only_learned: bool):
    """(first rows, second rows, classes, slots, token numbers) for STEP tokens of a chunk at a time."""
    ids, _, place, learned = _laid(row)
    leaf = np.frombuffer(row["leaves"], "<i2").astype(np.int64)
    of_word = np.frombuffer(row["hashes"], np.uint64), leaf // SLOTS, leaf % SLOTS
    context = max(d for f in (*WORD_FEATURES, *CLASS_FEATURES, *SLOT_FEATURES) for d in f)
    for a in range(0, len(ids), STEP):
        b, start = min(a + STEP, len(ids)), max(0, a - context)
        hashes, classes, slots = (x[ids[start:b]] for x in of_word)  # of a piece only, as they take 8 bytes a token each
        pieces = feature_rows(hashes, classes, place[start:b], rows)
        if only_learned and not learned[a:b].all():
            pick = np.flatnonzero(learned[a:b]) + a - start
        else:
            pick = slice(a - start, None)
        yield [r[pick] for r in pieces[0]], [r[pick] for r in pieces[1]], classes[pick], slots[pick], np.arange(start, b)[pick]


def _summed(model, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of features with outcomes: observed ones, or those that a model expects."""
    given = model.value
    outer = np.zeros((len(WORD_FEATURES) + len(CLASS_FEATURES), CLASSES, rows))
    inner = np.zeros((len(SLOT_FEATURES), SLOTS, rows))
    room = np.empty((max(CLASSES, SLOTS), STEP + 8))  # outcomes a power of two apart would crowd the same lines of the cache
    for batch in batches:
        for row in batch.to_pylist():
            for first, second, classes, slots, _ in _pieces(row, rows, True):
                if not len(classes):
                    continue
                if given is None:
                    _observed(first, classes, outer)
                    _observed(second, slots, inner)
                else:
                    for rows_of, mass, into in zip((first, second), given.expected(first, second, classes, room), (outer, inner), strict=True):
                        _counts(rows_of, mass, into)
    flat = np.concatenate([x.transpose(0, 2, 1).astype(np.float32).ravel() for x in (outer, inner)])
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    blocks = [flat[i : i + (1 << 18)].tobytes() for i in range(0, len(flat), 1 << 18)]
    n = len(blocks)
    yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([task % 32] * n, pa.int32()), pa.array(blocks, pa.binary())], ["block", "salt", "raw"])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["raw"].iloc[0]) // 4)
    for raw in pdf["raw"]:
        total += np.frombuffer(raw, np.float32)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "salt": [0], "raw": [total.astype(np.float32).tobytes()]})


def _sums(ready: DataFrame, model: Model | None, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all training tokens: feature, row, outcome, for classes and for slots."""
    given = ready.sparkSession.sparkContext.broadcast(model and model.settled())  # of MOST_ROWS at most
    kind = "block int, salt int, raw binary"
    told = ready.select("held", "sizes", "ids", "hashes", "leaves").mapInArrow(lambda b: _summed(given, rows, b), kind)
    # Added up in two steps, so that no task gets the counts of all tasks.
    some = told.groupBy("block", "salt").applyInPandas(_added, kind)
    got = sorted(some.groupBy("block").applyInPandas(_added, kind).collect())  # as many as blocks of weights
    given.destroy()
    flat = np.concatenate([np.frombuffer(r["raw"], np.float32) for r in got]).astype(np.float64)
    outer = (len(WORD_FEATURES) + len(CLASS_FEATURES)) * rows * CLASSES
    return flat[:outer].reshape(-1, rows, CLASSES), flat[outer:].reshape(-1, rows, SLOTS)


def _scored(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    given, rows, n_all, n_words, leaf_mass = model.value
    for batch in batches:
        for i, row in enumerate(batch.drop_columns(["keys"]).to_pylist()):
            ids, of, _, _ = _laid(row)
            counts, leaves = np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["leaves"], "<i2")
            base = np.log10((counts + 1) / (n_all + n_words + 1))
            inside = np.log10((counts + 1) / leaf_mass[leaves])
            score = np.empty(len(ids))
            for first, second, classes, slots, at in _pieces(row, rows, False):
                score[at] = given.leaf_scores(first, second, classes, slots)
            score = score / math.log(10) + inside[ids]
            many = len(row["held"])
            sums = [np.bincount(of, minlength=many), np.bincount(of, counts[ids] > 0, many).astype(np.int64), np.bincount(of, base[ids], many), np.bincount(of, score, many)]
            columns = [batch.column("keys")[i].values, pa.array(row["held"], pa.bool_()), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "held", "n_tokens", "n_known", "base", "score"])


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 2, folds: int = 7) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32 of the key as text leaves `fold` modulo `folds` are held out; a null key counts as an empty text,
    and a null text is empty (one end token). All other rows are learned from, in every gradient step. Scores are log10
    probabilities. Counts are of all training tokens (words that share a 64-bit hash would count as one). Repeated rows
    count each time. An empty table gives no rows. Of equally frequent words that with the smaller hash comes first.
    """
    spark = docs.sparkSession
    ship(spark)
    context = spark.sparkContext
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("key"),
        (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == fold).alias("held"),
        F.col(text).alias("text"),
    )
    shape = f"chunk long, keys array<{kind}>, held array<boolean>, sizes binary, ids binary, n binary, hashes binary, often array<long>, often_n array<long>"
    staged = Staged(rows.mapInArrow(_coded, shape), "coded")
    coded = staged.df

    top = frequent(coded, HEADS)
    heads = context.broadcast(top)
    near = coded.select("held", "sizes", "ids", "hashes").mapInArrow(lambda b: _neighbours(heads, b), "raw binary")
    near = near.groupBy(F.pmod(F.xxhash64("raw"), F.lit(32)).alias("salt")).applyInPandas(_squares, "raw binary").collect()  # 32 at most
    group = grouped(sum((np.frombuffer(r["raw"]) for r in near), np.zeros(HEADS**2)).reshape(HEADS, HEADS))
    own, used = np.full(max(1, len(top)), -1), dict.fromkeys(range(CLASSES), 0)
    for i, g in enumerate(group[: len(top)].tolist()):
        c = g * (CLASSES // GROUPS) + i % (CLASSES // GROUPS)
        if used[c] < OWN:
            own[i] = c * SLOTS + used[c]
            used[c] += 1

    listed = coded.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    many = max(context.defaultParallelism, -(-listed // (8 * BATCH_WORDS)))
    asking, answering = context.broadcast((top, group, many)), context.broadcast((top, own))
    told = coded.select("chunk", "held", "sizes", "ids", "hashes", "n").mapInArrow(lambda b: _asked(asking, b), "b int, chunk long, h binary, n binary, g binary, v binary")
    answers = told.groupBy("b").applyInArrow(lambda t: _answered(answering, t), "of long, b int, counts binary, leaves binary")
    answers = Staged(answers, "answers")
    sums = np.zeros((2, CLASSES * SLOTS))
    for r in answers.df.filter("of IS NULL").select("counts").toLocalIterator():  # 16 KB for each batch of words
        sums += np.frombuffer(r["counts"], "<i8").reshape(2, -1)
    mass, leaf_mass = sums[0], sums[0] + sums[1] + 1
    n_all, n_words = int(mass.sum()), int(sums[1].sum())
    body = coded.select("chunk", "keys", "held", "sizes", "ids", "hashes")
    shape = f"chunk long, keys array<{kind}>, held array<boolean>, sizes binary, ids binary, hashes binary, counts binary, leaves binary"
    ready = body.groupBy("chunk").cogroup(answers.df.filter("of IS NOT NULL").groupBy("of")).applyInArrow(_gathered(many), shape)
    ready = Staged(ready, "ready").df
    size = coded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    staged.drop()
    answers.drop()
    learning = ready.coalesce(max(context.defaultParallelism, -(-size // TASK_BYTES)))

    many = min(MOST_ROWS, max(LEAST_ROWS, 1 << (n_all // TOKENS_A_ROW).bit_length()))
    share = (mass.reshape(CLASSES, SLOTS).sum(axis=1) + 1) / (mass.sum() + CLASSES)
    inner = (mass.reshape(CLASSES, SLOTS) + 1) / (mass.reshape(CLASSES, SLOTS).sum(axis=1, keepdims=True) + SLOTS)
    model = Model(np.log(share).astype(np.float32), np.log(inner).astype(np.float32), np.zeros((len(WORD_FEATURES) + len(CLASS_FEATURES), many, CLASSES), np.float32), np.zeros((len(SLOT_FEATURES), many, SLOTS), np.float32))
    if n_all:
        seen, seen_inner = _sums(learning, None, many)
        model.outer_weights = initial_weights(seen, share)
        model.inner_weights = initial_weights(seen_inner, np.repeat(inner, many // CLASSES, axis=0))
        for _ in range(ROUNDS):
            expected, expected_inner = _sums(learning, model, many)
            model.outer_weights = stepped(model.outer_weights, seen, expected)
            model.inner_weights = stepped(model.inner_weights, seen_inner, expected_inner)
    given = context.broadcast((model.settled(), many, n_all, n_words, leaf_mass))
    scored = ready.mapInArrow(lambda b: _scored(given, b), f"key {kind}, held boolean, n_tokens long, n_known long, base double, score double")
    return scored.select(
        F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )


def _squares(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"raw": [sum(np.frombuffer(r) for r in pdf["raw"]).tobytes()]})


def op4_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return lm_scores(table(spark, sf_dir, "documents"))
