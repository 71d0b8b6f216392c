"""Language identification of every word, with spans of mixed-language text.

Script ranges narrow each word to the languages that are written so; those score it by
their character trigrams, word ends included. A Viterbi pass over a document's words, where each change of language costs
``penalty``, labels the words, and runs of one label are spans. Words of a script that no trained
language uses are labelled by the script itself (``ru`` for Cyrillic and so on).

Words are cut into blocks of ``BLOCK``; for each block the best way from every state to every state
is found for all blocks at once, then the blocks of a document are chained and traced back. That gives exactly the path of the
plain pass, for a text of any length, in numpy steps that don't grow with it.

The trigram model is fitted on labelled rows, ``per_language`` of each language at most, those whose ids have the smallest hashes.
Every fifth of them isn't counted, but scored: those whose own language scores them best give the median score of their language and its spread
(the median deviation, times 1.4826), so that a few rows of wrong labels move neither.

Words with digits in them say nothing about the language. Defined results: a text without other words (null and empty ones too) is ``zxx``, with no spans. A document whose
mean trigram score lies ``slack`` spreads below the median of its language is ``und``; a mean of few trigrams varies more, so for n of them, n under ``TYPICAL``, the spread
is sqrt(TYPICAL / n) times as much. Both are not accepted, and neither are documents
most of whose words are of other languages than those trained. Repeated rows get a result each; ties go to the
language of the word before, else to the first by name. Rows of null language are labelled like all others, but not fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from textmill.llm.common import Tokens, mix, release, small, tidy, tokens_in

BITS = 16
BLOCK = 128
FAR = np.float32(-30.0)
#: Every so many fitted rows, one is held out for the spread of scores; of fewer than LEAST_HELD such rows, all are used.
HELD_OUT, LEAST_HELD = 5, 8
#: Trigrams of a text of usual length.
TYPICAL = 1000
#: The least spread of a language's scores.
LEAST_SPREAD = 0.05

#: First code point of each range, and its script.
_RANGES = [(0, ""), (65, "Latn"), (91, ""), (97, "Latn"), (123, ""), (0xAA, "Latn"), (0xAB, ""), (0xB5, "Latn"), (0xB6, ""), (0xBA, "Latn"), (0xBB, ""), (0xC0, "Latn"), (0xD7, ""), (0xD8, "Latn"), (0xF7, ""), (0xF8, "Latn"), (0x2B0, ""), (0x370, "Grek"), (0x400, "Cyrl"), (0x530, "Armn"), (0x590, "Hebr"), (0x600, "Arab"), (0x700, "Syrc"), (0x750, "Arab"), (0x780, "Thaa"), (0x800, ""), (0x900, "Deva"), (0x980, "Beng"), (0xA00, "Guru"), (0xA80, "Gujr"), (0xB00, "Orya"), (0xB80, "Taml"), (0xC00, "Telu"), (0xC80, "Knda"), (0xD00, "Mlym"), (0xD80, "Sinh"), (0xE00, "Thai"), (0xE80, "Laoo"), (0xF00, "Tibt"), (0x1000, "Mymr"), (0x10A0, "Geor"), (0x1100, "Hang"), (0x1200, "Ethi"), (0x13A0, ""), (0x1780, "Khmr"), (0x1800, "Mong"), (0x18B0, ""), (0x1E00, "Latn"), (0x1F00, "Grek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hang"), (0x3190, ""), (0x3400, "Hani"), (0x4DC0, ""), (0x4E00, "Hani"), (0xA000, ""), (0xAC00, "Hang"), (0xD7B0, ""), (0xF900, "Hani"), (0xFB00, "Latn"), (0xFB07, ""), (0xFB50, "Arab"), (0xFE00, ""), (0xFF21, "Latn"), (0xFF3B, ""), (0xFF41, "Latn"), (0xFF5B, ""), (0xFF66, "Kana"), (0xFFA0, ""), (0x20000, "Hani"), (0x30000, "")]
SCRIPTS = sorted({s for _, s in _RANGES})
_STARTS = np.array([a for a, _ in _RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in _RANGES], np.uint8)
#: The language that a script stands for if no trained one uses it.
ALONE = {"Grek": "el", "Cyrl": "ru", "Armn": "hy", "Hebr": "he", "Arab": "ar", "Deva": "hi", "Beng": "bn", "Guru": "pa", "Gujr": "gu", "Orya": "or", "Taml": "ta", "Telu": "te", "Knda": "kn", "Mlym": "ml", "Sinh": "si", "Thai": "th", "Laoo": "lo", "Tibt": "bo", "Mymr": "my", "Geor": "ka", "Hang": "ko", "Ethi": "am", "Khmr": "km", "Mong": "mn", "Kana": "ja", "Hani": "zh", "Syrc": "syr", "Thaa": "dv", "Latn": "und", "": "zxx"}


def distinct_words(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words of some tokens: their trigram buckets, where each word's begin, and its script; and each token's word."""
    _, at, inverse = np.unique(t.hash, return_index=True, return_inverse=True)
    size = t.end[at] - t.start[at] + 1
    first = np.cumsum(size) - size
    take = np.arange(int(size.sum())) + np.repeat(t.start[at] - first, size)
    take[first + size - 1] = 0
    buffer = t.raw[take]
    buffer[first + size - 1] = 32
    chars = np.frombuffer((" " + buffer.tobytes().decode("utf-8", "replace")).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    inner = np.flatnonzero(chars != 32)
    grams = mix(chars[inner - 1] * np.uint64(0x1F123BB5) + chars[inner] * np.uint64(0x9E3779B97F4A7C15) + chars[inner + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
    new = np.flatnonzero(np.concatenate([[True], np.diff(inner) > 1]))
    kind = _SCRIPT[np.searchsorted(_STARTS, chars[inner].astype(np.int64), "right") - 1]
    script = np.maximum.reduceat(kind, new) if len(new) else kind
    digit = (chars[inner] >= 48) & (chars[inner] <= 57)
    script[np.logical_or.reduceat(digit, new) if len(new) else digit] = 0  # no script: codes and numbers are of no language
    return grams.astype(np.int64), new, script, inverse


class Model:
    """Trigram scores: a row for each bucket, a column for each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=0)
        self.table = np.log((counts + 0.5) / (total + 0.5 * len(counts))).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.uses = share >= 0.01  # script x language
        self.middle, self.spread, self.slack = np.full(len(langs), -np.inf), np.zeros(len(langs)), 0.0

    def floor(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The lowest mean score of n trigrams that a language accepts."""
        return self.middle[lang] - self.slack * self.spread[lang] * np.sqrt(np.maximum(1.0, TYPICAL / np.maximum(n, 1)))

    def score(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every word: scores by state (the languages, then other scripts), its word type, and by type the script, trigrams, and plain scores."""
        grams, new, script, which = distinct_words(t)
        plain = np.add.reduceat(self.table[grams], new, axis=0)
        size = np.diff(np.append(new, len(grams)))
        out = np.concatenate([plain, np.full((len(plain), 1), FAR, np.float32)], axis=1)
        out -= out.max(axis=1, keepdims=True)
        out = np.maximum(out, FAR)
        candidates = self.uses[script]
        letters = script != SCRIPTS.index("")
        none = letters & ~candidates.any(axis=1)
        out[:, :-1] = np.where(candidates, out[:, :-1], FAR)
        out[:, -1] = np.where(none, 0, FAR)
        out[~letters] = 0
        return out, which, script, size, plain


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word; those of row r are ``first[r]:first[r + 1]``."""
    n, states = scores.shape
    out = np.zeros(n, np.int8)
    if not n:
        return out
    size = np.diff(first)
    count = -(-size // BLOCK)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[row] + nth * BLOCK
    length = np.minimum(BLOCK, first[row + 1] - begin)
    order = np.argsort(-length, kind="stable")
    row, nth, begin, length = row[order], nth[order], begin[order], length[order]
    blocks = len(row)
    ways = np.full((blocks, states, states), -np.inf, np.float32)
    ways[:, np.arange(states), np.arange(states)] = 0
    steps = int(length[0])
    stays, bests, active = [], [], np.searchsorted(-length, -np.arange(steps), "left")
    for k in range(steps):
        m = active[k]
        v = ways[:m]
        best = v.argmax(axis=2)
        switch = np.take_along_axis(v, best[:, :, None], 2) - np.float32(penalty)
        stay = v >= switch
        ways[:m] = np.where(stay, v, switch) + scores[begin[:m] + k][:, None, :]
        stays.append(stay)
        bests.append(best.astype(np.int8))
    # chain the blocks of each row
    total = np.zeros((len(size), states), np.float32)
    back = np.zeros((blocks, states), np.int8)
    by_nth = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[by_nth], np.arange(int(nth.max()) + 2))
    for k in range(len(cuts) - 1):
        own = by_nth[cuts[k] : cuts[k + 1]]
        through = total[row[own]][:, :, None] + ways[own]
        back[own] = through.argmax(axis=1)
        total[row[own]] = through.max(axis=1)
    ends, starts, now = np.zeros(blocks, np.int8), np.zeros(blocks, np.int8), total.argmax(axis=1).astype(np.int8)
    for k in range(len(cuts) - 2, -1, -1):
        own = by_nth[cuts[k] : cuts[k + 1]]
        ends[own] = now[row[own]]
        starts[own] = back[own, ends[own]]
        now[row[own]] = starts[own]
    state, every = ends.copy(), np.arange(blocks)
    for k in range(steps - 1, -1, -1):
        m = active[k]
        s, a, i = state[:m], starts[:m], every[:m]
        out[begin[:m] + k] = s
        state[:m] = np.where(stays[k][i, a, s], s, bests[k][i, a])
    return out


def fit(docs: DataFrame, per_language: int = 1000, slack: float = 15.0, seed: int = 5) -> Model:
    """The model of the languages in ``lang``, from ``per_language`` rows of each at most."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ids = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id", F.lit(seed)).alias("h")).withColumn("r", rank).where(F.col("r") <= per_language)
    ids = ids.groupBy("doc_id").agg((F.min("r") % HELD_OUT == 0).alias("held"))
    rows = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text").join(small(ids), "doc_id").select("lang", "text", "held")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                total, scripts = np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPTS), np.int64)
                for _, _, t in tokens_in(b.column(1).filter(pa.array(langs == lang))):
                    if len(t.hash):
                        grams, new, script, which = distinct_words(t)
                        times = np.bincount(which, minlength=len(new))
                        total += np.bincount(grams, np.repeat(times, np.diff(np.append(new, len(grams)))), 1 << BITS).astype(np.int64)
                        scripts += np.bincount(script, times, len(SCRIPTS)).astype(np.int64)
                n = np.concatenate([total, scripts])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some])], ["lang", "slot", "n"])

    found = rows.where("not held").mapInArrow(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique()) if len(found) else []
    table = np.zeros(((1 << BITS) + len(SCRIPTS), len(langs)))
    table[found["slot"], [langs.index(x) for x in found["lang"]]] = found["n"]
    model = Model(langs, table[: 1 << BITS], table[1 << BITS :])
    model.slack = slack

    @tidy
    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in tokens_in(b.column(1)):
                at = np.array([langs.index(x) if x in langs else -1 for x in b.column(0).slice(lo, hi - lo).to_pylist()])
                mean, n = _means(model, t)
                own = mean[np.arange(hi - lo), at]
                ok = (at >= 0) & (n > 0) & (own >= mean.max(axis=1, initial=-np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(at[ok], pa.int32()), pa.array(own[ok]), pa.array(n[ok]), b.column(2).slice(lo, hi - lo).filter(pa.array(ok))], ["lang", "mean", "n", "held"])

    if langs:
        # per_language numbers of each language at most
        got = rows.mapInArrow(means, "lang int, mean double, n double, held boolean").toPandas()
        for k in range(len(langs)):
            own = got[got["lang"] == k]
            own = own[own["held"]] if own["held"].sum() >= LEAST_HELD else own
            if len(own):
                model.middle[k] = own["mean"].median()
                off = (own["mean"] - model.middle[k]).abs() * np.sqrt(np.minimum(1.0, own["n"] / TYPICAL))
                model.spread[k] = max(1.4826 * off.median(), LEAST_SPREAD)
    return model


def _means(model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Mean trigram score of each row's words of trained scripts, by language, 0 where there are none; and the number of those trigrams."""
    out, n = np.zeros((len(t.first) - 1, len(model.langs))), np.zeros(len(t.first) - 1)
    if len(t.hash):
        grams, new, script, which = distinct_words(t)
        ok = model.uses[script].any(axis=1) & (script != SCRIPTS.index(""))
        plain = np.add.reduceat(model.table[grams], new, axis=0) * ok[:, None]
        size = np.diff(np.append(new, len(grams))) * ok
        rows = t.row()
        n = np.bincount(rows, size[which], len(out))
        for k in range(len(model.langs)):
            out[:, k] = np.bincount(rows, plain[which, k], len(out)) / np.maximum(n, 1)
    return out, n


@dataclass
class Labels:
    """Of some rows: the number of each one's main language in ``names``, that language's share of words, and whether it is accepted; and spans: those of row r are ``cut[r]:cut[r + 1]``."""

    names: list[str]
    main: np.ndarray
    share: np.ndarray
    accepted: np.ndarray
    cut: np.ndarray
    code: np.ndarray
    first: np.ndarray
    last: np.ndarray


def label(model: Model, t: Tokens, penalty: float) -> Labels:
    rows, none = len(t.first) - 1, np.zeros(0, np.int64)
    names = sorted({*model.langs, *ALONE.values(), "und", "zxx"})
    if not len(t.hash):
        return Labels(names, np.full(rows, names.index("zxx")), np.zeros(rows), np.zeros(rows, bool), np.zeros(rows + 1, np.int64), none, none, none)
    scores, which, script, size, plain = model.score(t)
    state = viterbi(scores[which], t.first, penalty)
    trained = len(model.langs)
    number = np.array([names.index(x) for x in [*model.langs, *(ALONE[s] for s in SCRIPTS)]])
    kind = script[which]
    code = number[np.where(state < trained, state, trained + kind.astype(np.int64))]
    letters = kind != SCRIPTS.index("")
    row = t.row()
    begin = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
    votes = np.bincount(row[letters] * len(names) + code[letters], minlength=rows * len(names)).reshape(rows, -1)
    words, main = votes.sum(axis=1), votes.argmax(axis=1)  # names are sorted, so the first of ties is the first by name
    share = votes.max(axis=1) / np.maximum(words, 1)
    counted = letters & (state < trained)
    grams = np.bincount(row, size[which] * counted, rows)
    lang_of = np.full(len(names), -1)
    lang_of[number[:trained]] = np.arange(trained)
    ok = (words > 0) & (lang_of[main] >= 0)
    if trained:
        sums = np.bincount(row, np.where(counted, plain[which, np.minimum(state, trained - 1)], 0), rows)
        low = ok & (grams > 0) & (sums / np.maximum(grams, 1) < model.floor(lang_of[main], grams))
        und = names.index("und")
        main, share, ok = np.where(low, und, main), np.where(low, votes[:, und] / np.maximum(words, 1), share), ok & ~low
    empty = words == 0  # such rows have no spans either
    main, share = np.where(empty, names.index("zxx"), main), np.where(empty, 0.0, share)
    stop = np.append(begin[1:], len(code))
    keep = ~empty[row[begin]]
    begin, stop = begin[keep], stop[keep]
    of = row[begin]
    return Labels(names, main, share, ok, np.searchsorted(of, np.arange(rows + 1)), code[begin], begin - t.first[of], stop - t.first[of])


RESULT = "doc_id bigint, lang string, share double, spans array<struct<lang:string,first:int,last:int>>, accepted boolean"


def identify(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """A row for each document; ``spans`` count words from 0, ``last`` being the first word after the span."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in tokens_in(b.column(1)):
                x = label(shared.value, t, penalty)
                names = pa.array(x.names, pa.string())
                spans = pa.StructArray.from_arrays([names.take(pa.array(x.code)), pa.array(x.first, pa.int32()), pa.array(x.last, pa.int32())], ["lang", "first", "last"])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), names.take(pa.array(x.main)), pa.array(x.share), pa.ListArray.from_arrays(pa.array(x.cut, pa.int32()), spans), pa.array(x.accepted)], ["doc_id", "lang", "share", "spans", "accepted"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def drop_rejected(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """docs without those that are not accepted; their columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(BooleanType())
    def accepted(text: pa.Array) -> pa.Array:
        out = [label(shared.value, t, penalty).accepted for _, _, t in tokens_in(text)]
        release()
        return pa.array(np.concatenate(out or [np.zeros(0, bool)]))

    return docs.where(accepted(F.col("text").cast("string")))
