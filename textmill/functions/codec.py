"""What a tokenizer knows, in a form that goes to the Python workers, and the Arrow functions that use it.

A batch is turned into distinct chunks first, all of which are merged at once. The rest is gathering by
number, so a text costs no Python step for any of its chunks. Numbers of 64 bits are made for a part of a batch
at a time; of the whole there are only 32-bit ones, input and output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textmill.functions.bpe import byte_pair_encode
from textmill.functions.bulk import PART, Merger, gather
from textmill.functions.bytelevel import ALPHABET, byte_level_decode_bytes, byte_level_encode

RAW, BYTE_LEVEL, SENTENCEPIECE = "raw", "byte_level", "sentencepiece"
SPACE = "▁".encode()
_BLANK = b" \t\n\x0c\r"
#: Chunks that are kept at most before all are forgotten.
KEPT = 1 << 20
#: Chunks or ids of the rows that a function of a column takes from a batch at a time.
SLICE = 1 << 20
_CHARS = [c.encode() for c in ALPHABET]
_SIZES = np.array([len(c) for c in _CHARS], np.int64)
#: The characters of all bytes, one after another, where each begins, and its size.
_MAPPED = np.frombuffer(b"".join(_CHARS), np.uint8), np.cumsum(_SIZES) - _SIZES, _SIZES


@dataclass
class Codec:
    ranks: dict[bytes, int]
    decoder: dict[int, bytes]
    specials: dict[str, int]
    mode: str = RAW
    kept: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    def piece(self, raw: bytes) -> list[int]:
        """Ids of a chunk's bytes: looked up whole first, then merged."""
        return byte_pair_encode(byte_level_encode(raw).encode() if self.mode == BYTE_LEVEL else raw, self.ranks)

    def _blank(self, raw: bytes) -> tuple[int, bytes | None, int]:
        """Of a chunk of white space: spaces before the first other byte, that byte and all up to the last, and spaces after; the middle is None if there are only spaces."""
        middle = raw.strip(b" ")
        return (len(raw), None, 0) if not middle else (len(raw) - len(raw.lstrip(b" ")), middle, len(raw) - len(raw.rstrip(b" ")))

    def unit(self, word: str, special: bool, pending: int) -> list[int]:
        """Ids that a chunk adds, after so many spaces that wait to be written."""
        key = (word, special, pending)
        out = self.kept.get(key)
        if out is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            out = self.kept[key] = self._unit(word, special, pending)
        return out

    def _unit(self, word: str, special: bool, pending: int) -> list[int]:
        if special:
            return (self.piece(SPACE * pending) if pending else []) + [self.specials[word]]
        raw = word.encode("utf-8", "surrogatepass")
        if self.mode != SENTENCEPIECE:
            return self.piece(raw)
        if raw[:1] not in _BLANK or not raw:
            return self.piece(SPACE * pending + raw)
        lead, middle, _ = self._blank(raw)
        if middle is None:
            return []
        out = self.piece(SPACE * (pending + lead)) if pending + lead else []
        run = 0
        for b in middle:
            if b == 32:
                run += 1
                continue
            if run:
                out = out + self.piece(SPACE * run)
                run = 0
            out = out + self.piece(bytes([b]))
        return out

    def after(self, word: str, special: bool) -> tuple[int, bool]:
        """Spaces that wait after a chunk, and whether they add to those before."""
        raw = word.encode("utf-8", "surrogatepass")
        if special or self.mode != SENTENCEPIECE or raw[:1] not in _BLANK or not raw:
            return 0, False
        lead, middle, trail = self._blank(raw)
        return (lead, True) if middle is None else (trail, False)

    def encode_chunks(self, words: list[str], special: list[bool] | None = None) -> list[int]:
        out, pending = [], 0
        for i, w in enumerate(words):
            own = bool(special and special[i])
            out += self.unit(w, own, pending)
            n, adds = self.after(w, own)
            pending = pending + n if adds else n
        return out + self.piece(SPACE * pending) if pending else out

    def _merger(self) -> Merger:
        if "merger" not in self.kept:
            self.kept["merger"] = Merger(self.ranks)
        return self.kept["merger"]

    def _many(self, words: pa.Array, word: np.ndarray, pending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many chunks that are a piece each, after so many spaces that wait; and their numbers. word doesn't fall."""
        first = buffers(words)[1]
        done = np.cumsum(np.diff(first)[word] + len(SPACE) * pending)
        values, numbers, lo = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while lo < len(word):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PART, "right")))
            own = word[lo:hi]
            ids, n = self._some(words.slice(own[0], own[-1] - own[0] + 1), own - own[0], pending[lo:hi])
            values.append(ids)
            numbers.append(n)
            lo = hi
        return np.concatenate(values), np.concatenate(numbers)

    def _some(self, words: pa.Array, word: np.ndarray, pending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, first = buffers(words)
        start, size = first[:-1][word], np.diff(first)[word]
        if self.mode == BYTE_LEVEL:
            raw, n = gather(*_MAPPED, raw)
            first = np.concatenate([[0], np.cumsum(n)])[first]
            start, size = first[:-1][word], np.diff(first)[word]
        elif pending.any():
            # spaces and chunk, one after the other
            both = np.concatenate([np.frombuffer(SPACE * int(pending.max()), np.uint8), raw])
            begin = np.stack([np.zeros(len(word), np.int64), start + 3 * int(pending.max())], axis=1).ravel()
            length = np.stack([3 * pending, size], axis=1).ravel()
            raw, size = gather(both, begin, length, np.arange(len(begin)))[0], size + 3 * pending
            start = np.cumsum(size) - size
        return self._merger().encode(raw, start, size)

    def _blanks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which chunks are white space to this mode, and what is after each."""
        blank, value, adds = np.zeros(len(words), bool), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        if self.mode == SENTENCEPIECE and len(words):
            raw, start = buffers(words)
            full = np.diff(start) > 0
            blank[full] = np.isin(raw[start[:-1][full]], np.frombuffer(_BLANK, np.uint8))
            for k in np.flatnonzero(blank).tolist():
                value[k], adds[k] = self.after(words[k].as_py(), False)
        return blank, value, adds

    def _units(self, code: np.ndarray, marked: np.ndarray | None, value: np.ndarray, adds: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct units: a chunk, whether it is a special token, and the spaces that wait before it; the unit at each place; and the spaces that wait where each row stops."""
        unit, last, carried, found = np.zeros(len(code), np.int32), np.zeros(len(stop), np.int64), 0, []
        first = np.zeros(len(code), bool)
        if len(stop):
            first[np.concatenate([[0], stop[:-1]])] = True
        for a in range(0, len(code), PART):
            b = min(a + PART, len(code))
            c = code[a:b].astype(np.int64)
            own, pending = np.zeros(b - a, bool) if marked is None else marked[a:b], np.zeros(b - a, np.int64)
            if self.mode == SENTENCEPIECE:
                new, more = first[a:b], adds[c] & ~own
                spaces = np.where(own, 0, value[c])
                total = np.cumsum(spaces)
                since = np.maximum.accumulate(np.where(new | ~more, np.arange(b - a), -1))
                waiting = total + np.where(since < 0, carried, spaces[since] - total[since])
                pending[0], pending[1:] = carried, waiting[:-1]
                pending[new] = 0
                pending[more] = 0  # those write nothing, whatever waits
                carried = int(waiting[-1])
                lo, hi = np.searchsorted(stop, [a, b], "right")
                last[lo:hi] = waiting[stop[lo:hi] - 1 - a]
            step = int(pending.max()) + 1
            keys, unit[a:b] = np.unique((c * 2 + own) * step + pending, return_inverse=True)
            found.append((keys // step, keys % step))
        step = 1 + max((int(w.max()) for _, w in found), default=0)
        keys, number = np.unique(np.concatenate([np.zeros(0, np.int64), *(k * step + w for k, w in found)]), return_inverse=True)
        before = 0
        for a, (k, _) in zip(range(0, len(code), PART), found):
            unit[a : a + PART] = number[before : before + len(k)][unit[a : a + PART]]
            before += len(k)
        return keys // step >> 1, (keys // step & 1).astype(bool), keys % step, unit, last

    def encode_arrow(self, chunks: pa.Array, special: pa.Array | None = None) -> pa.Array:
        """Ids of each row of a list of chunks; null where that is null."""
        valid = np.asarray(chunks.is_valid())
        sizes = np.zeros(len(chunks), np.int64)
        sizes[valid] = np.diff(np.asarray(chunks.offsets))[valid]
        stop = np.cumsum(sizes)[sizes > 0]
        flat = chunks.flatten().dictionary_encode()
        words, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
        blank, value, adds = self._blanks(words)
        if self.mode == SENTENCEPIECE or special is not None:
            marked = None if special is None else special.flatten().to_numpy(zero_copy_only=False).astype(bool)
            of, own, wait, unit, last = self._units(code, marked, value, adds, stop)
        else:
            of, unit, last = np.arange(len(words)), code, np.zeros(len(stop), np.int64)
            own, wait = np.zeros(len(of), bool), np.zeros(len(of), np.int64)
        single = ~own & ~blank[of]
        values, length = np.zeros(0, np.int32), np.zeros(len(of), np.int64)
        values, length[single] = self._many(words, of[single], wait[single])
        start = np.zeros(len(of), np.int64)
        start[single] = np.cumsum(length[single]) - length[single]
        # special tokens, white space, and what waits at the end of a text: few, and of several pieces
        odd = np.flatnonzero(~single)
        tails, tail = np.unique(last, return_inverse=True)
        lists = [self.unit(words[int(of[k])].as_py(), bool(own[k]), int(wait[k])) for k in odd] + [self.piece(SPACE * n) if n else [] for n in tails.tolist()]
        n = np.array([len(x) for x in lists], np.int64)
        at = len(values) + np.cumsum(n) - n
        start[odd], length[odd] = at[: len(odd)], n[: len(odd)]
        start, length = np.concatenate([start, at[len(odd) :]]), np.concatenate([length, n[len(odd) :]])
        values = np.concatenate([values, np.array([k for x in lists for k in x], np.int32)])
        tail = len(of) + tail
        out = np.empty(int(length[tail].sum()) + sum(int(length[unit[a : a + PART]].sum()) for a in range(0, len(unit), PART)), np.int32)
        ends, done = np.zeros(len(stop), np.int64), 0
        for a in range(0, len(unit), PART):
            order = unit[a : a + PART]
            lo, hi = np.searchsorted(stop, [a, a + len(order)], "right")
            place = stop[lo:hi] - a
            if self.mode == SENTENCEPIECE:
                order, place = np.insert(order, place, tail[lo:hi]), place + np.arange(1, hi - lo + 1)
            ids, counts = gather(values, start, length, order)
            out[done : done + len(ids)] = ids
            ends[lo:hi] = done + np.cumsum(counts)[place - 1]
            done += len(ids)
        each = np.zeros(len(sizes), np.int64)
        each[sizes > 0] = np.diff(ends, prepend=0)
        offsets = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~valid, False)) if not valid.all() else pa.array(offsets), pa.array(out, pa.int32()))

    def token_bytes(self, k: int) -> bytes | None:
        """What an id stands for; the decoder comes before the specials."""
        raw = self.decoder.get(k)
        if raw is None:
            return self._special_bytes().get(k)
        if self.mode == BYTE_LEVEL:
            mapped = byte_level_decode_bytes(raw)
            return raw if mapped is None else mapped
        return raw

    def _special_bytes(self) -> dict[int, bytes]:
        if "special bytes" not in self.kept:
            self.kept["special bytes"] = {k: t.encode() for t, k in self.specials.items()}
        return self.kept["special bytes"]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(b for k in ids if k is not None and (b := self.token_bytes(k)) is not None)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all ids that stand for something, in order of the ids, where each one's begin, and their sizes; the last are none, for unknown ids."""
        if "table" not in self.kept:
            known = sorted({*self.decoder, *self.specials.values()})
            every = [*(self.token_bytes(k) or b"" for k in known), b""]
            size = np.array([len(x) for x in every], np.int64)
            self.kept["known"] = np.array(known, np.int64)
            # ids are looked up by place if they lie close, else by search
            self.kept["place"] = None
            if known and known[-1] < 8 * len(known) + (1 << 16):
                self.kept["place"] = np.full(known[-1] + 1, len(known))
                self.kept["place"][known] = np.arange(len(known))
            self.kept["table"] = np.frombuffer(b"".join(every), np.uint8), np.cumsum(size) - size, size
        return self.kept["table"]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The rows of the table for some ids."""
        self.table()
        known, place = self.kept["known"], self.kept["place"]
        if place is not None:
            return np.where((ids >= 0) & (ids < len(place)), place[np.clip(ids, 0, len(place) - 1)], len(known))
        if not len(known):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return np.where(known[at] == ids, at, len(known))

    def decode_arrow(self, ids: pa.Array) -> pa.Array:
        """Bytes of each row of a list of ids; unknown and null ones stand for nothing."""
        raw, start, size = self.table()
        valid = np.asarray(ids.is_valid())
        sizes = np.zeros(len(ids), np.int64)
        sizes[valid] = np.diff(np.asarray(ids.offsets))[valid]
        flat, stop = ids.flatten(), np.cumsum(sizes)
        parts, ends, done = [np.zeros(0, np.uint8)], np.zeros(len(ids) + 1, np.int32), 0
        for a in range(0, len(flat), PART):
            some = pc.fill_null(flat.slice(a, PART), -1).to_numpy(zero_copy_only=False)
            values, counts = gather(raw, start, size, self.rows(some))
            lo, hi = np.searchsorted(stop, [a, a + len(some)], "right")
            ends[lo + 1 : hi + 1] = done + np.concatenate([[0], np.cumsum(counts)])[stop[lo:hi] - a]
            parts.append(values)
            done += len(values)
        values = np.concatenate(parts)
        bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(ids), [bits, pa.py_buffer(ends), pa.py_buffer(values)])


def slices(lists: pa.Array, most: int = 0) -> Iterator[tuple[int, int]]:
    """Where ranges of rows with so many values at most (else SLICE), or of one row, begin, and their numbers of rows."""
    offsets, lo, most = np.asarray(lists.offsets), 0, most or SLICE
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi - lo
        lo = hi


def buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words in a piece, and where each begins."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
