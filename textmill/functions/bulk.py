"""The merge loop over many pieces at once, in numpy: in each round, every piece that still has a pair with a rank merges its best.

Parts are symbols: 0 to 255 are single bytes, whether or not the vocabulary has them, and the others its tokens
of two bytes and more. A sorted table has, for every pair of symbols that makes a token, that token's rank and symbol.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textmill.functions.bpe import byte_pair_encode

_NONE = np.int64((1 << 31) - 1)
#: Longer pieces need more rounds than they are worth, and are merged one by one.
LONG = 96
#: Values that are worked on at a time, so that memory beside input and output doesn't grow with the batch.
PART = 1 << 18


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that begin at start and have a size, one after another in the order of which; and their sizes."""
    n = size[which]
    end = np.cumsum(n)
    if not len(n) or not end[-1]:
        return values[:0], n
    out, lo, done = np.empty(end[-1], values.dtype), 0, 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(end, done + PART, "right")))
        m, stop, first = n[lo:hi], int(end[hi - 1]), start[which[lo:hi]]
        if hi == lo + 1:
            out[done:stop] = values[first[0] : first[0] + m[0]]
        else:
            out[done:stop] = values[np.arange(done, stop) + np.repeat(first - end[lo:hi] + m, m)]
        lo, done = hi, stop
    return out, n


class Merger:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = list(ranks)
        self.tokens, self.ids = pa.array(tokens, pa.large_binary()), np.array(list(ranks.values()), np.int32)
        self.place = {t: k for k, t in enumerate(tokens)}
        symbol = {bytes([b]): b for b in range(256)}
        for t in tokens:
            if len(t) > 1:
                symbol[t] = len(symbol)
        self.n = len(symbol)
        self.symbol_id = np.full(self.n, -1, np.int64)
        for t, k in ranks.items():
            if t:
                self.symbol_id[symbol[t]] = k
        keys, values = [], []
        for t in tokens:
            for i in range(1, len(t)):
                left, right = symbol.get(t[:i]), symbol.get(t[i:])
                if left is not None and right is not None:
                    keys.append(left * self.n + right)
                    values.append(symbol[t])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def _keyed(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.symbol_id[made], _NONE) << 32

    def _merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that pieces of so many bytes end as, one piece after another, and their number."""
        end = np.cumsum(size)
        made = np.full(len(sym), -1)
        if len(sym) > 1:
            made[:-1] = self.pairs(sym[:-1], sym[1:])
        made[end - 1] = -1
        best, piece = self._keyed(made), np.arange(len(size))
        done_piece, done_size, done_sym = [], [], []
        while len(piece):
            begin = np.cumsum(size) - size
            least = np.minimum.reduceat(best + np.arange(len(best)), begin)
            alive = (least >> 32) < _NONE
            if not alive.all():
                over = np.repeat(~alive, size)
                done_piece.append(piece[~alive])
                done_size.append(size[~alive])
                done_sym.append(sym[over])
                sym, made, best = sym[~over], made[~over], best[~over]
                least = least[alive] - np.repeat(np.cumsum(np.where(alive, 0, size)), alive.astype(np.int64))
                piece, size = piece[alive], size[alive]
                if not len(piece):
                    break
            at = least & 0xFFFFFFFF
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, made, best = sym[stay], made[stay], best[stay]
            size = size - 1
            end = np.cumsum(size)
            at = at - np.arange(len(at))
            inner = at + 1 < end
            made[at] = -1
            made[at[inner]] = self.pairs(sym[at[inner]], sym[at[inner] + 1])
            before = at[at > end - size] - 1
            made[before] = self.pairs(sym[before], sym[before + 1])
            changed = np.concatenate([at, before])
            best[changed] = self._keyed(made[changed])
        if not done_piece:
            return sym[:0], size[:0]
        order, n, every = np.argsort(np.concatenate(done_piece)), np.concatenate(done_size), np.concatenate(done_sym)
        return gather(every, np.cumsum(n) - n, n, order)

    def encode(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``raw[start:start + size]``, one after another, and their numbers."""
        data, size = gather(raw, start, size, np.arange(len(size)))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        if len(size) * 8 < len(self.tokens):  # a set of all tokens is built anew with each call of index_in
            at = np.fromiter(map(self.place.get, found.to_pylist(), itertools.repeat(-1)), np.int64, len(size))
        else:
            at = pc.fill_null(pc.index_in(found, value_set=self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        whole, short = at >= 0, (at < 0) & (size > 1) & (size <= LONG)
        count = whole.astype(np.int64)
        parts = [(np.flatnonzero(whole), count[whole], self.ids[at[whole]])]
        if short.any():
            own = np.flatnonzero(short)
            sym, n = self._merge(gather(data, offsets[:-1], size, own)[0].astype(np.int64), size[own])
            ids = self.symbol_id[sym]
            known = ids >= 0
            parts.append((own, np.bincount(np.repeat(np.arange(len(own)), n)[known], minlength=len(own)), ids[known].astype(np.int32)))
        for k in np.flatnonzero((at < 0) & (size > LONG)).tolist():
            ids = byte_pair_encode(data[offsets[k] : offsets[k + 1]].tobytes(), self.ranks)
            parts.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.int32)))
        which, n, ids = (np.concatenate(x) for x in zip(*parts))
        full, begin = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        full[which], begin[which] = n, np.cumsum(n) - n
        return gather(ids, begin, full, np.arange(len(size)))
