"""The merge loop, in plain Python: the one part of encoding that no Spark expression does.

From single bytes on, the adjacent pair whose bytes together have the lowest rank is merged, the leftmost of equals, until no
pair has a rank. Short pieces are scanned; long ones use a heap, so a run of n bytes without a break costs n log n.
"""

from __future__ import annotations

import heapq

_SCAN = 48


def byte_pair_encode(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece; bytes without an id are left out."""
    if not piece:
        return []
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) == 1:
        return []
    parts = _scan(piece, ranks) if len(piece) <= _SCAN else _heap(piece, ranks)
    found = (ranks.get(p) for p in parts)
    return [r for r in found if r is not None]


def _scan(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pairs = [get(piece[i : i + 2]) for i in range(len(piece) - 1)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1])


def _heap(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0: none begins here
    left = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (r := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(heap, (r, a, b, end[b]))

    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c or not end[b]:
            continue
        end[a], end[b] = c, 0
        if c < n:
            left[c] = a
            offer(a)
        if left[a] >= 0:
            offer(left[a])
    out, a = [], 0
    while a < n:
        out.append(piece[a : end[a]])
        a = end[a]
    return out
