"""Benchmark decontamination with a distributed positional inverted index.

The training documents are cut into shards of about a million tokens. A shard is one row: its
documents' ids, where each begins, the hashes of its terms in order, and the postings of each term,
as differences of places in the shard, in bytes of seven bits. So a place stands for a document and a position, each
shard answers for its own documents, and no posting is ever shuffled. The shards are a table in the
shared folder; one index serves any number of benchmarks.

A query first adds up, over all shards, in how many places each test term stands. Every run of
``phrase`` tokens of a test item is then looked up from its rarest term on: the term's places less the
term's offset are where the run could begin; the next rarest term's places, less its offset, are
intersected with them, and so on until none is left or all terms agree. For proximity, an item as a whole, and each stretch of ``stretch`` tokens of it
(every half stretch, one begins), gives its ``anchors`` rarest
terms; where a share of ``agree`` of them, and ``least`` at least, stand in one document with
offset-adjusted places that differ by no more than ``slop``, the item is near, in the item's order but for inserted,
dropped or changed words between. A copy lacks the very words that were changed in it, and those may be the rarest, so the anchors are many.

Defined results: null and empty texts, of documents or items, match nothing. An item shorter than ``phrase`` tokens, but
of at least ``shortest``, is one run of its own length; a shorter one only matches nothing. Null ids are reported
as null. Rows that repeat are matched each and reported once. Very long texts are a shard each. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import Workspace, small, tidy, tokens_in

SHARD_TOKENS = 1 << 20
#: Test items that go to every task at a time; more are looked up in rounds of so many.
ROUND_ITEMS = 20_000

INDEX = "shard string, ids array<bigint>, begins array<bigint>, n_tokens bigint, terms binary, ends binary, places binary, postings binary"
MATCH = "doc_id bigint, item_id bigint, kind string, matched int, doc_position int, item_position int"


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2**35 as bytes of seven bits, the last of each with its high bit set; and each one's bytes."""
    size = np.ones(len(x), np.int64)
    for k in (7, 14, 21, 28):
        size += x >= (1 << k)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(x) else 0, np.uint8)
    for k in range(5):
        at = size > k
        out[end[at] - 1 - k] = (x[at] >> (7 * k)) & 127
    out[end - 1] |= 128
    return out, size


def unpack(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw & 128)
    if not len(last):
        return np.zeros(0, np.int64)
    size = np.diff(last, prepend=-1)
    out = (raw[last] & 127).astype(np.int64)
    for k in range(1, int(size.max())):
        at = size > k
        out[at] |= raw[last[at] - k].astype(np.int64) << (7 * k)
    return out


def _shard(parts: list, ids: list, begins: list, name: str) -> dict:
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    steps = np.diff(order, prepend=0)
    steps[new] = order[new]
    packed, size = pack(steps)
    upto = np.concatenate([np.flatnonzero(new)[1:], [len(h)]])
    return {"shard": name, "ids": ids, "begins": begins, "n_tokens": len(h), "terms": ordered[new].tobytes(), "ends": np.cumsum(size)[upto - 1].astype(np.int64).tobytes(), "places": np.diff(upto, prepend=0).astype(np.int32).tobytes(), "postings": packed.tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of all documents."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        schema = pa.schema([("shard", pa.string()), ("ids", pa.list_(pa.int64())), ("begins", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("terms", pa.binary()), ("ends", pa.binary()), ("places", pa.binary()), ("postings", pa.binary())])
        parts, ids, begins, n, name = [], [], [], 0, uuid.uuid4().hex
        k = 0
        for b in batches:
            own = b.column(0).to_pylist()
            for lo, hi, t in tokens_in(b.column(1)):
                if n and n + len(t.hash) > SHARD_TOKENS:
                    yield pa.RecordBatch.from_pylist([_shard(parts, ids, begins, f"{name}-{k}")], schema)
                    parts, ids, begins, n, k = [], [], [], 0, k + 1
                parts.append(t.hash)
                ids += own[lo:hi]
                begins += (t.first[:-1] + n).tolist()
                n += len(t.hash)
        if n:
            yield pa.RecordBatch.from_pylist([_shard(parts, ids, begins, f"{name}-{k}")], schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX)


class Shard:
    """One row of the index, read."""

    def __init__(self, row: dict):
        self.ids, self.begins, self.n = row["ids"], np.array(row["begins"], np.int64), row["n_tokens"]
        self.terms, self.ends = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["ends"], np.int64)
        self.places_of, self.postings = np.frombuffer(row["places"], np.int32), np.frombuffer(row["postings"], np.uint8)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term, or -1."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def places(self, at: int) -> np.ndarray:
        return np.cumsum(unpack(self.postings[self.ends[at - 1] if at else 0 : self.ends[at]]))

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, "right") - 1


def _items(rows: list[tuple], phrase: int, shortest: int) -> list[tuple]:
    """(item id, hashes) of the items that can match."""
    out = []
    if rows:
        for lo, hi, t in tokens_in(pa.array([r[1] for r in rows], pa.string())):
            for r in range(lo, hi):
                h = t.hash[t.first[r - lo] : t.first[r - lo + 1]]
                if len(h) >= min(phrase, shortest):
                    out.append((rows[r][0], h))
    return out


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Places of each term over all shards; every shard sends what it has of them, added up by term."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for row in b.to_pylist():
                own, places = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["places"], np.int32)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                total += np.where(own[at] == terms, places[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "places").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def match(index: DataFrame, benchmark: DataFrame, phrase: int = 13, shortest: int = 8, anchors: int = 24, stretch: int = 32, agree: float = 0.6, least: int = 6, slop: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that match, of kind ``exact`` (``matched``: runs of ``phrase`` tokens found, with the place of the first) and of kind ``near`` (``matched``: anchors that agree)."""
    test = benchmark.select(F.col(item_col).cast("bigint"), F.col(text_col)).where(F.col(text_col).isNotNull()).distinct().orderBy(item_col, text_col)
    spark, out, ws = index.sparkSession, None, Workspace(index.sparkSession, "matches")
    rows = ((r[0], r[1]) for r in test.toLocalIterator())
    k = 0
    while batch := list(itertools.islice(rows, ROUND_ITEMS)):
        if items := _items(batch, phrase, shortest):
            found = ws.stash(_match_round(spark, index, items, phrase, anchors, stretch, agree, least, slop), f"round-{k}")
            out = found if out is None else out.unionByName(found)
        k += 1
    return spark.createDataFrame([], MATCH) if out is None else out


class Parts:
    """Items and stretches of items, their anchors side by side, the rarest of each first: anchor i is ``term[i]``, ``offset[i]`` tokens from its item's start, and belongs to part ``of[i]``."""

    def __init__(self, parts: list[tuple[int, np.ndarray, np.ndarray, int]]):
        none, size = [np.zeros(0, np.int32)], np.array([len(p[1]) for p in parts], np.int64)
        self.item, self.needed = np.array([p[0] for p in parts], np.int64), np.array([p[3] for p in parts], np.int64)
        self.offset, self.term = np.concatenate([p[1] for p in parts] or none), np.concatenate([p[2] for p in parts] or none)
        self.of = np.repeat(np.arange(len(parts)), size)
        # who has ``needed`` of all has so many of the rarer three quarters; the common ones, with most of the postings, are looked up for them only
        rarer = -(-size * 3 // 4)
        self.first_needed = np.maximum(1, self.needed - (size - rarer))
        self.rarer = np.arange(len(self.of)) - np.repeat(np.cumsum(size) - size, size) < rarer[self.of]

    def find(self, s: Shard, at: np.ndarray, places, slop: int) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, anchors that agree, the first one's place in the document); ``at``: the shard's place of each term, or -1."""
        here = at[self.term] >= 0
        here &= (np.bincount(self.of[here], minlength=len(self.item)) >= self.needed)[self.of]  # parts of which enough is in the shard
        anchor = np.flatnonzero(here)
        for own in np.split(anchor, np.flatnonzero(np.diff(self.of[anchor])) + 1) if len(anchor) else []:
            part = self.of[own[0]]
            needed, rarer = self.needed[part], own[self.rarer[own]]
            if not len(crowded(self._diagonals(rarer, places)[1], self.first_needed[part], slop)):
                continue
            which, diagonal = self._diagonals(own, places)
            some = crowded(diagonal, needed, slop)
            which, diagonal = own[which[some]], diagonal[some]
            place = diagonal + self.offset[which]
            doc = s.doc(place)
            # one word over and over makes a crowd, but not of enough anchors
            distinct = np.unique(doc << np.int64(32) | which) >> np.int64(32)
            enough = (np.bincount(distinct) >= needed)[doc] if len(doc) else np.zeros(0, bool)
            which, diagonal, place, doc = which[enough], diagonal[enough], place[enough], doc[enough]
            # windows of places, less the anchors' offsets, that begin at a posting and hold enough
            step = doc * np.int64(1 << 40) + (diagonal + np.int64(1 << 20))
            o = np.argsort(step, kind="stable")
            step, place, which, doc = step[o], place[o], which[o], doc[o]
            end = np.searchsorted(step, step + slop, "right")
            for i in np.flatnonzero(end - np.arange(len(end)) >= needed):
                n = len(np.unique(which[i : end[i]]))
                if n >= needed:
                    yield int(doc[i]), int(self.item[part]), n, int(place[i : end[i]].min() - s.begins[doc[i]])

    def _diagonals(self, anchor: np.ndarray, places) -> tuple[np.ndarray, np.ndarray]:
        """Of the postings of some anchors: which of them, and the place less its offset."""
        own = [places(t) for t in self.term[anchor]]
        which = np.repeat(np.arange(len(own)), np.array([len(p) for p in own], np.int64))
        return which, np.concatenate(own or [np.zeros(0, np.int64)]) - self.offset[anchor][which]


def crowded(x: np.ndarray, needed: int, slop: int) -> np.ndarray:
    """Which of x to look at: all that share a range of ``slop`` with ``needed`` in all, and few others. Two neighbouring ranges, as wide as a window at least, hold any window."""
    if len(x) < needed:
        return np.zeros(0, np.int64)
    wide = slop.bit_length()  # 2 ** wide > slop
    at = x >> wide
    at -= at.min() - 1
    bins = int(at.max()) + 2
    if bins > 16 * len(x):  # few among many places
        ordered = np.sort(at)
        if not (ordered[needed - 1 :] - ordered[: len(ordered) - needed + 1] <= 1).any():
            return np.zeros(0, np.int64)
        values, at = np.unique(at, return_inverse=True)
        n = np.bincount(at)
        next_to = np.diff(values) == 1
        pair = n[:-1] + n[1:] >= needed
        hot = n >= needed
        hot[:-1] |= next_to & pair
        hot[1:] |= next_to & pair
        return np.flatnonzero(hot[at])
    n = np.bincount(at, minlength=bins)
    pair = n[:-1] + n[1:] >= needed
    hot = np.zeros(bins, bool)
    hot[:-1] = pair
    hot[1:] |= pair
    return np.flatnonzero(hot[at]) if pair.any() else np.zeros(0, np.int64)


def _match_round(spark, index: DataFrame, items: list[tuple], phrase: int, anchors: int, stretch: int, agree: float, least: int, slop: int) -> DataFrame:
    terms = np.unique(np.concatenate([h for _, h in items]))
    count = term_counts(index, terms)
    runs: dict[bytes, list] = {}
    near: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    for k, (_, h) in enumerate(items):
        t = np.searchsorted(terms, h)
        n = min(phrase, len(h))
        for o in range(len(h) - n + 1):
            runs.setdefault(t[o : o + n].astype(np.int32).tobytes(), []).append((k, o))
        # the whole item, and each stretch of it by itself
        parts = {(0, len(t))} | ({(o, min(len(t), o + stretch)) for o in range(0, max(1, len(t) - stretch // 2), stretch // 2)} if len(t) > stretch else set())
        for lo, hi in sorted(parts):
            rare = lo + np.lexsort((np.arange(hi - lo), count[t[lo:hi]]))
            rare = rare[np.sort(np.unique(t[rare], return_index=True)[1])][:anchors]  # distinct terms
            if len(rare) >= least:
                near.append((k, rare.astype(np.int32), t[rare].astype(np.int32), max(least, math.ceil(agree * len(rare)))))
    by_size: dict[int, list] = {}
    for key, where in runs.items():
        by_size.setdefault(len(key) // 4, []).append((np.frombuffer(key, np.int32), where))
    plan = []
    for _, own in sorted(by_size.items()):
        m = np.stack([t for t, _ in own])
        plan.append((m, np.argsort(count[m], axis=1, kind="stable"), [w for _, w in own]))
    flat = Parts(near)
    shared = spark.sparkContext.broadcast((terms, plan, flat, [k for k, _ in items]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, plan, near, names = shared.value
        for b in batches:
            for k in range(b.num_rows):
                s = Shard(b.slice(k, 1).to_pylist()[0])
                at, kept = s.find(terms), {}

                def places(t: int) -> np.ndarray:
                    if t not in kept:
                        kept[t] = s.places(at[t]) if at[t] >= 0 else np.zeros(0, np.int64)
                    return kept[t]

                found: dict[tuple, list] = {}
                for m, order, where in plan:
                    for r in np.flatnonzero((at[m] >= 0).all(axis=1)):
                        o = order[r]
                        starts = places(m[r, o[0]]) - o[0]
                        for j in o[1:]:
                            if not len(starts):
                                break
                            other = places(m[r, j])
                            i = np.searchsorted(other, starts + j)
                            i[i == len(other)] = 0
                            starts = starts[other[i] == starts + j]
                        if len(starts):
                            starts = starts[starts >= 0]
                            d = s.doc(starts)
                            same = d == s.doc(starts + m.shape[1] - 1)
                            for doc, p in zip(d[same].tolist(), (starts - s.begins[d])[same].tolist()):
                                for item, off in where[r]:
                                    x = found.setdefault((doc, item, "exact"), [set(), p, off])
                                    x[0].add(off)
                                    x[1:] = min((x[1], x[2]), (p, off))
                for doc, item, n, p in near.find(s, at, places, slop):
                    x = found.setdefault((doc, item, "near"), [n, p, 0])
                    x[0], x[1] = max(x[0], n), min(x[1], p)
                rows = [{"doc_id": s.ids[d], "item_id": names[i], "kind": kind, "matched": len(x[0]) if kind == "exact" else x[0], "doc_position": x[1], "item_position": x[2]} for (d, i, kind), x in found.items()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("matched", pa.int32()), ("doc_position", pa.int32()), ("item_position", pa.int32())]))

    return index.mapInArrow(run, MATCH).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The index of docs, kept as a table, and all that match."""
    ws = Workspace(docs.sparkSession, "postings")
    return match(ws.stash(build_index(docs), "index", compression="zstd"), benchmark, **options)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that match, known by id and text (by text alone where the id is null)."""
    ws = Workspace(docs.sparkSession, "leaks")
    own = F.xxhash64(docs["doc_id"], docs["text"])
    bad = small(ws.stash(find_leaks(docs.select(own.alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias("bad_row")).distinct(), "bad"))
    return docs.join(bad, own == bad["bad_row"], "left_anti")
