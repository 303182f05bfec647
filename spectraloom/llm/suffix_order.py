"""Suffix order with common-prefix lengths by recursive induction, vectorised.

One level: symbols are typed (S: smaller than what follows, L: larger), and every S after an L is a seed (a left-most S). A suffix is
the tuple of its symbols up to and including the next seed, and the rank of that seed's suffix. Seed substrings are named by the sorted
tuples, the names form a shorter string, and the order of its suffixes, found by the same function, gives the seeds' ranks; these induce the
order of all suffixes. The common prefix of two neighbours is carried the same way: suffixes with the same symbols up to the seed
share those and the least prefix found one level up between their seeds; all others are compared directly, which ends within a few words.
"""

from __future__ import annotations

import numpy as np


def _types(sym: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last symbol counts as smaller."""
    n = len(sym)
    rises, falls = np.zeros(n, bool), np.zeros(n, bool)
    rises[:-1], falls[:-1] = sym[:-1] < sym[1:], sym[:-1] > sym[1:]
    rises[-1] = True
    decided = np.where(rises | falls, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # equal symbols take the type of what decides next
    return rises[decided]


def _groups(sym: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Per position the place of the first position with the same symbols up to the seed, in sorted order."""
    n = len(sym)
    sym = np.maximum(sym - (_ends(sym) - 1), 0)  # terminators look alike here: their ranks tell them apart
    bits = int(sym.max() + 2).bit_length()
    per, pad = 63 // bits, (1 << bits) - 1  # after the seed: larger than any symbol, as S is larger than L
    far = np.concatenate([sym, np.full(per, pad)])
    place = np.arange(n)
    left = nxt - place
    word = np.zeros(n, np.int64)
    for j in range(per):
        word = (word << bits) | np.where(left >= j, far[j : n + j], pad)
    order = np.argsort(word)
    ranked = word[order]
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    group = np.empty(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(head, place, 0))
    size = np.bincount(group, minlength=n)
    active = np.flatnonzero(size[group] > 1)
    off = per
    while True:
        g, size = np.unique(group[active], return_inverse=True, return_counts=True)[1:]
        unfinished = np.bincount(g, left[active] >= off, len(size)) > 0
        active = active[(unfinished & (size > 1))[g]]
        if not len(active):
            return group
        word = np.zeros(len(active), np.int64)
        for j in range(per):
            at = active + (off + j)
            word = (word << bits) | np.where(at <= nxt[active], far[np.minimum(at, n - 1)], pad)
        _refine(group, active, word)
        off += per


def _refine(group: np.ndarray, active: np.ndarray, key: np.ndarray) -> None:
    """Split the (whole) groups of the active positions by a key."""
    order = np.lexsort((key, group[active]))
    g, k = group[active][order], key[order]
    first = np.r_[True, g[1:] != g[:-1]]
    head = first | np.r_[True, k[1:] != k[:-1]]
    place = np.arange(len(g))
    start = np.maximum.accumulate(np.where(first, place, 0))
    group[active[order]] = g + np.maximum.accumulate(np.where(head, place, 0)) - start


class _Least:
    """Range minimum over small numbers by doubling."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.uint16)]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value at places low + 1 .. high."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            rows, some = self.rows[k], level == k
            out[some] = np.minimum(rows[low[some] + 1], rows[high[some] - (1 << int(k)) + 1])
        return out


def _compare(text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common bytes of text[a:] and text[b:], at most depth and not past the end of either string."""
    out = np.minimum(depth, np.minimum(ends[a] - a, ends[b] - b))
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    open_ = np.arange(len(a))
    for off in range(0, depth, 8):
        left, right = (np.ascontiguousarray(words[x[open_] + off]).view(np.uint64).reshape(-1) for x in (a, b))
        diff = left ^ right
        differs = diff != 0
        low = diff[differs] & (~diff[differs] + np.uint64(1))  # the lowest set bit lies in the first differing byte
        same = (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        out[open_[differs]] = np.minimum(out[open_[differs]], off + same)
        open_ = open_[~differs]
        open_ = open_[out[open_] > off + 8]
        if not len(open_):
            break
    return out


def _order(sym: np.ndarray, pos: np.ndarray, compare) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``sym`` in order and the common prefix of each with the one before it; ``pos``: byte place of each symbol."""
    n = len(sym)
    s_type = _types(sym)
    seeds = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    nxt = np.full(n, n - 1)
    nxt[seeds - 1] = seeds
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # the next seed strictly after each position
    stops = np.flatnonzero(sym < _ends(sym))
    nxt[stops] = stops
    group = _groups(sym, nxt)
    group[stops] = np.arange(len(stops))
    joint = group.copy()
    rank, least = np.zeros(n, np.int64), None
    size = np.bincount(group, minlength=n)
    if (size > 1).any() and len(seeds):
        own, name = np.unique(group[seeds], return_inverse=True)
        ends = sym[seeds] < _ends(sym)
        count = int(ends.sum())
        reduced = np.where(ends, sym[seeds], count + name)
        if len(own) == len(seeds):
            order = np.argsort(reduced)
            common = np.r_[0, compare(pos[seeds[order[:-1]]], pos[seeds[order[1:]]])]
        else:
            order, common = _order(reduced, pos[seeds], compare)
        rank[seeds[order]] = np.arange(len(seeds))
        least = _Least(common)
        tied = np.flatnonzero(size[group] > 1)
        _refine(group, tied, rank[nxt[tied]])
    order = np.empty(n, np.int64)
    order[group] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(n, np.int64)
    same = joint[a] == joint[b]
    if same.any():
        x, y = a[same], b[same]
        common[1:][same] = pos[nxt[x]] - pos[x] + least.between(rank[nxt[x]], rank[nxt[y]])
    common[1:][~same] = compare(pos[a[~same]], pos[b[~same]])
    return order, common


def _ends(sym: np.ndarray) -> int:
    """Number of terminators: they are the symbols 0, 1, ... in order of place, and the last symbol is the largest of them."""
    return int(sym[-1]) + 1


def suffix_order(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix places of the joined strings (one terminator after each, all non-empty) in order to at least ``depth`` bytes, common prefixes up to
    ``depth``, and each string's first place."""
    count = len(strings)
    length = np.fromiter(map(len, strings), np.int64, count)
    start = np.cumsum(length + 1) - length - 1
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    last = start + length
    ends = np.repeat(last, length + 1)
    sym = raw.astype(np.int64) + count
    sym[last] = np.arange(count)
    text = np.concatenate([raw, np.zeros(depth + 16, np.uint8)])

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _compare(text, ends, a, b, depth)

    order, common = _order(sym, np.arange(len(sym)), compare)
    return order, np.minimum(common, depth), start


def repeated_places(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """True at every place of the joined strings whose next ``depth`` bytes also start elsewhere; and each string's first place."""
    order, common, start = suffix_order(strings, depth)
    hit = common >= depth
    repeated = np.zeros(len(order), bool)
    repeated[order] = hit | np.r_[hit[1:], False]
    return repeated, start
