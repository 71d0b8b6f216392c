"""Language-model scoring with a hashed maximum-entropy model.

A word is known by the upper ``SLOT_BITS`` bits of its hash. The most frequent of these slots are symbols of their own, all others
share ``TAIL`` symbols (as words before, ``TAIL_BEFORE``), so there are ``CLASSES`` x ``MEMBERS`` symbols, 64 x 64. A symbol's probability after w2 w1 is that of its class
times that of the symbol in its class and, for a word of the tail, times the slot's share of its symbol over the corpus (slots that it lacks have, together, as much as there are slots that it has once); the former two are softmaxes over weights that are summed from four features: none (the
bias), the word before (w1), the two words before (w2 w1), and the word before that one alone (the skip w2 _). Features
are hashed to rows of a table of ``ROWS_CLASS`` rows for classes and, together with the class, of one of ``ROWS_MEMBER`` rows for members.

Training starts from the corpus' shares as biases and makes ``rounds`` passes, each over documents of its own, all documents in all. In a pass, every task
takes gradient steps, with AdaGrad, over blocks of its tokens from the common weights on; what changed is
summed by row of the table over all tasks, each weighted by how often it met the row (iterative parameter mixing), and added to the common weights.
A block's equal contexts are computed once, in numpy.

Defined results: a text without tokens (null and empty ones too) has a null log-probability. The two words before a text
are a symbol of their own. Repeated rows are trained on and scored each. Ids may be null. Very long texts are cut into blocks for the
arithmetic, and each block's first words still see the words before.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import mix, tokens_in

CLASSES = MEMBERS = 64
TAIL, TAIL_BEFORE = 64, 4
SLOT_BITS = 22
#: Bits of a symbol as part of a context: one more value, for the place before a text, has to fit.
_WIDE = 13
#: The most that a slot without a count counts for.
UNSEEN = 0.5
ROWS_CLASS, ROWS_MEMBER = 1 << 13, 1 << 15
#: Tokens to a gradient step: a task's first, and its largest; each is twice the one before until then.
FIRST, BLOCK = 1 << 13, 1 << 18
#: What AdaGrad adds to the sum of squares: rows met seldom learn less.
CALM = 1e-10
#: Rows up to which equal ones are added up in step with those of others.
SHORT = 24
#: Contexts whose probabilities are computed at a time: what they take stays in the processor's cache.
COLUMNS = 1 << 11
#: Rows of a table that travel together.
STRIP = 256
_START = CLASSES * MEMBERS
#: The first rows of a table, where each group's bias is; no other feature is hashed to them.
_BIASES = CLASSES + 1


def slot_counts(docs: DataFrame) -> np.ndarray:
    """How often each slot occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for _, _, t in tokens_in(b.column(0)):
                slots, times = np.unique((t.hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64), return_counts=True)
                n[slots] += times
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["slot", "n"])

    out = np.zeros(1 << SLOT_BITS, np.int64)
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def symbols(counts: np.ndarray) -> np.ndarray:
    """The symbol of each slot: frequent slots by rank, the others by number into the last ``TAIL`` symbols."""
    own = CLASSES * MEMBERS - TAIL
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = own + np.arange(len(counts)) % TAIL
    out[order[:own]] = np.arange(own)
    return out.astype(np.int16)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """The counts, with as much for all slots that the corpus lacks together as there are slots that it has once (Good's and Turing's estimate)."""
    unmet = counts == 0
    return np.where(unmet, min(UNSEEN, max(1, int((counts == 1).sum())) / max(1, int(unmet.sum()))), counts)


def shares(counts: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The log-probability of each slot in its symbol: 0 for those that have one of their own."""
    n = smoothed(counts)
    out = np.log(n / np.bincount(symbol, n)[symbol])
    out[symbol < CLASSES * MEMBERS - TAIL] = 0
    return out.astype(np.float32)


class Weights:
    """Weights before training: the biases give each symbol its share of the corpus, all else is 0."""

    def __init__(self, counts: np.ndarray, symbol: np.ndarray, share: np.ndarray):
        self.symbol, self.share = symbol, share
        self.tables = [np.zeros((ROWS_CLASS, CLASSES), np.float32), np.zeros((ROWS_MEMBER, MEMBERS), np.float32)]
        n = np.log(np.bincount(symbol, smoothed(counts), CLASSES * MEMBERS) + 1e-9).reshape(CLASSES, MEMBERS)
        whole = np.logaddexp.reduce(n, axis=1)
        self.tables[0][CLASSES] = whole - np.logaddexp.reduce(whole)
        self.tables[1][:CLASSES] = n - whole[:, None]


def features(context: np.ndarray, group: np.ndarray | int, rows: int) -> np.ndarray:
    """The rows of the four features of each context w2 << _WIDE | w1, for a group: a column each."""
    w1, w2, own = context & ((1 << _WIDE) - 1), context >> _WIDE, np.broadcast_to(np.asarray(group, np.uint64), context.shape)
    base = [w1.astype(np.uint64) + np.uint64(1 << 40), context.astype(np.uint64) + np.uint64(2 << 40), w2.astype(np.uint64) + np.uint64(3 << 40)]
    hashed = [_BIASES + ((mix(x + (own << np.uint64(44))) >> np.uint64(32)) % np.uint64(rows - _BIASES)).astype(np.int64) for x in base]
    return np.stack([own.astype(np.int64), *hashed])


def _softmax(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-probabilities for each column of rows."""
    z = table[rows[0]]
    for r in rows[1:]:
        z += table[r]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _picked(table: np.ndarray, rows: np.ndarray, which: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability of ``target[k]`` in column ``which[k]`` of rows; ``which`` ascends."""
    out = np.empty(len(which), table.dtype)
    for lo in range(0, rows.shape[1], COLUMNS):
        a, b = np.searchsorted(which, (lo, lo + COLUMNS))
        out[a:b] = _softmax(table, rows[:, lo : lo + COLUMNS])[which[a:b] - lo, target[a:b]]
    return out


def _sums(x: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of runs of rows of ``x[order]`` that begin at ``first``; short runs all at once, a row of each at a time."""
    size = np.diff(np.append(first, len(order)))
    out = x[order[first]]
    left, k = np.flatnonzero((size > 1) & (size <= SHORT)), 1
    while len(left):
        out[left] += x[order[first[left] + k]]
        k += 1
        left = left[size[left] > k]
    for i in np.flatnonzero(size > SHORT):
        out[i] = x[order[first[i] : first[i] + size[i]]].sum(axis=0)
    return out


def _step(table: np.ndarray, seen: np.ndarray, met: np.ndarray, rows: np.ndarray, which: np.ndarray, target: np.ndarray, times: np.ndarray, rate: float) -> None:
    """One gradient step: event k is ``target[k]`` in context ``which[k]``, ``times[k]`` times; ``which`` ascends."""
    n = np.bincount(which, times, rows.shape[1]).astype(np.float32)
    gradient, all_times, times = np.empty((rows.shape[1], table.shape[1]), np.float32), n.sum(), times.astype(np.float32)
    for lo in range(0, rows.shape[1], COLUMNS):
        own = gradient[lo : lo + COLUMNS]
        np.exp(_softmax(table, rows[:, lo : lo + COLUMNS]), out=own)
        own *= -n[lo : lo + COLUMNS, None]
        a, b = np.searchsorted(which, (lo, lo + COLUMNS))
        own[which[a:b] - lo, target[a:b]] += times[a:b]
        own /= all_times
    for r in rows:
        order = np.argsort(r, kind="stable")
        r = r[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        own, g = r[first], _sums(gradient, order, first)
        met[own] += np.add.reduceat(n[order], first)
        seen[own] += np.square(g).mean(axis=1)
        table[own] += rate * g / np.sqrt(seen[own] + CALM)[:, None]


def _blocks(column, symbol: np.ndarray, sizes: Iterator[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(context, symbol, row, slot) of all tokens, a block at a time; rows count on over the batch."""
    held, n, sizes = [], 0, sizes or itertools.repeat(BLOCK)
    size = next(sizes)
    for lo, hi, t in tokens_in(column):
        if len(t.hash):
            slot = (t.hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            s = symbol[slot].astype(np.int64)
            row = t.row()
            before = np.where(s < CLASSES * MEMBERS - TAIL, s, CLASSES * MEMBERS - TAIL + s % TAIL_BEFORE)
            w1, w2 = np.roll(before, 1), np.roll(before, 2)
            begin = t.first[:-1][np.diff(t.first) > 0]
            w1[begin] = w2[begin] = _START
            second = begin[begin + 1 < len(s)] + 1
            w2[second] = _START
            held.append((w2 << _WIDE | w1, s, row + lo, slot))
            n += len(s)
        while n >= size:
            parts = [np.concatenate(x) for x in zip(*held)]
            yield tuple(x[:size] for x in parts)
            held, n = [tuple(x[size:] for x in parts)], n - size
            size = next(sizes)
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _growing() -> Iterator[int]:
    size = FIRST
    while True:
        yield size
        size = min(2 * size, BLOCK)


def _events(context: np.ndarray, s: np.ndarray):
    """Distinct contexts, distinct (context, class) pairs and distinct events, each with what it points to."""
    events, inverse, times = np.unique(context * (CLASSES * MEMBERS) + s, return_inverse=True, return_counts=True)
    pairs, pair = np.unique(events // MEMBERS, return_inverse=True)
    contexts, ctx = np.unique(pairs // CLASSES, return_inverse=True)
    return contexts, pairs, ctx, events, pair, times, inverse


def train_pass(docs: DataFrame, weights: Weights, rate: float) -> DataFrame:
    """(table, strip, met, change): what the tasks changed, averaged by row over those that met it."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        tables = [t.copy() for t in start.tables]
        seen = [np.zeros(len(t), np.float32) for t in tables]
        met = [np.zeros(len(t), np.float32) for t in tables]
        sizes = _growing()
        for b in batches:
            for context, s, _, _ in _blocks(b.column(0), start.symbol, sizes):
                contexts, pairs, ctx, events, pair, times, _ = _events(context, s)
                pair_times = np.bincount(pair, times, len(pairs))
                _step(tables[0], seen[0], met[0], features(contexts, CLASSES, ROWS_CLASS), ctx, pairs % CLASSES, pair_times, rate)
                _step(tables[1], seen[1], met[1], features(pairs // CLASSES, pairs % CLASSES, ROWS_MEMBER), pair, events % MEMBERS, times, rate)
        for k, (t, n) in enumerate(zip(tables, met)):
            change = (t - start.tables[k]) * n[:, None]
            for i in range(0, len(t), STRIP):
                if n[i : i + STRIP].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([n[i : i + STRIP].tobytes()], pa.binary()), pa.array([change[i : i + STRIP].tobytes()], pa.binary())], ["table", "strip", "met", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for b in batches:
            for k, i, n, c in zip(*(x.to_pylist() for x in b.columns)):
                n, c = np.frombuffer(n, np.float32).astype(np.float64), np.frombuffer(c, np.float32)
                if (k, i) in sums:
                    sums[k, i][0] += n
                    sums[k, i][1] += c
                else:
                    sums[k, i] = [n, c.astype(np.float64)]
        for (k, i), (n, c) in sums.items():
            c = (c.reshape(len(n), -1) / np.maximum(n, 1e-9)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([n.astype(np.float32).tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["table", "strip", "met", "change"])

    kind = "table int, strip int, met binary, change binary"
    return docs.select(F.col("text").cast("string")).mapInArrow(learn, kind).repartition("table", "strip").mapInArrow(add, kind)


def train(docs: DataFrame, rounds: int = 2, rate: float = 0.2) -> Weights:
    """Weights from all documents, each used once."""
    counts = slot_counts(docs)
    symbol = symbols(counts)
    weights = Weights(counts, symbol, shares(counts, symbol))
    turn = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds):
        for r in train_pass(docs.where(turn == k), weights, rate).toLocalIterator(prefetchPartitions=True):
            t = weights.tables[r["table"]]
            t[r["strip"] : r["strip"] + STRIP] += np.frombuffer(r["change"], np.float32).reshape(-1, t.shape[1])
    return weights


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """A row for each document: its tokens, their log-probability, and the perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for context, s, row, slot in _blocks(b.column(1), w.symbol):
                contexts, pairs, ctx, events, pair, _, inverse = _events(context, s)
                by_class = _picked(w.tables[0], features(contexts, CLASSES, ROWS_CLASS), ctx, pairs % CLASSES)
                by_member = _picked(w.tables[1], features(pairs // CLASSES, pairs % CLASSES, ROWS_MEMBER), pair, events % MEMBERS)
                total += np.bincount(row, (by_class[pair] + by_member)[inverse] + w.share[slot], b.num_rows)
                n += np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total, mask=n == 0), pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)], ["doc_id", "n_tokens", "log_probability", "perplexity"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, log_probability double, perplexity double")
