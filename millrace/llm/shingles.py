"""Word shingles as sets of 64-bit hashes, computed for many texts at once on their bytes."""

from __future__ import annotations

import numpy as np

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Numbers of a process's first table of powers, 4 MB, and of the next.
_FEW_POWERS, _MANY_POWERS = 1 << 19, 1 << 21
_CHAIN = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit of the input moves all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = _POWERS[base] = np.full(_FEW_POWERS if n <= _FEW_POWERS else max(n, _MANY_POWERS), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
    return known[:n]


def spans_hashed(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: a polynomial modulo 2**64, taken from one running sum, and then mixed."""
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), out=running[1:])
    h = (running[stops] - running[starts]) * _powers(_INVERSE, len(raw))[starts]
    return mix(h + (stops - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, in order, and the number of words of each text.

    Words are runs of bytes other than ASCII white space, A-Z in lower case.
    """
    n, sizes = len(ends) - 1, np.diff(ends)
    apart = np.full(len(raw) + n + 1, 32, np.uint8)
    apart[1 + np.arange(len(raw)) + np.repeat(np.arange(n), sizes)] = _FOLD[raw]
    inside = _IN_WORD[apart]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, stops = edge[::2], edge[1::2]
    first = 1 + ends[:-1] + np.arange(n)  # where each text starts in `apart`
    counts = np.diff(np.searchsorted(starts, np.append(first, len(apart) + 1)))
    return spans_hashed(apart, starts, stops), counts


def _shingles(raw: np.ndarray, ends: np.ndarray, words: int, cost: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    h, counts = word_hashes(raw, ends)
    many = max(0, len(h) - words + 1)
    chained = h[:many].copy()
    for k in range(1, words):
        chained = chained * _CHAIN + h[k : k + many]
    chained = mix(chained + np.uint64(words))
    if cost is not None:
        own = cost[(h >> np.uint64(64 - (len(cost) - 1).bit_length())).astype(np.int64)]
        summed = sum(own[k : k + many] for k in range(words))
    sets, costs, at = [], [], 0
    for n in counts.tolist():
        first = np.zeros(1, np.int64)
        if n >= words:
            found, first = np.unique(chained[at : at + n - words + 1], return_index=True)
        elif n:
            one = h[at : at + 1]
            for k in range(1, n):
                one = one * _CHAIN + h[at + k : at + k + 1]
            found = mix(one + np.uint64(n))
        else:
            found, first = np.empty(0, np.uint64), first[:0]
        sets.append(found)
        if cost is not None:
            costs.append(summed[at + first] if n >= words else np.zeros(len(found), np.int64))
        at += n
    return sets, costs


def shingle_sets(raw: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle make one of them all."""
    return _shingles(raw, ends, words, None)[0]


def shingle_sets_with_cost(raw: np.ndarray, ends: np.ndarray, words: int, cost: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sets, and for each shingle the sum of its words' costs. cost: whole numbers, by the first bits of a word's hash."""
    return _shingles(raw, ends, words, cost)


def set_id(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set, the same for equal sets only."""
    total = np.array([mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(shingles))])
    return int(mix(total).view(np.int64)[0])
