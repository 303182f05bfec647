"""Sets of hashed word shingles, their partition keys, and parity bitmaps that bound an overlap.

Keys. Two linked sets differ in few shingles: of the T shingles of both sets together, at most (100 - p) T / (100 + p). Sizes are cut into bands. A tile takes
the sets of its band as the smaller side and those that may be linked with them from above; the hash range is cut into more parts than a pair of the tile
can differ in, so a linked pair has whole parts in common, and ``spare`` parts more than it must. A key is the hash of all a set has in one part. A set with no more empty parts than ``spare`` leaves
them out; any other gives keys for its empty parts too, so that no linked pair is left without a common key.

Bitmaps. Bit h mod L is the parity of the set's hashes there, L a power of two that follows the size. Bits that differ number at most the
shingles that differ, so the overlap is at most (T - differing bits) / 2. A bitmap folds to any shorter length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import xxhash

FACTORS = np.random.default_rng(11).integers(0, 1 << 63, 12, np.uint64) * np.uint64(2) + np.uint64(1)
SEED = 42


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of the numbers spread over all 64 places."""
    h = (h ^ (h >> np.uint64(31))) * FACTORS[8]
    h = (h ^ (h >> np.uint64(29))) * FACTORS[9]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of ``words`` words in a row; of the whole sequence where it is shorter."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(w, SEED) for w in found], np.uint64, len(found))
    n = len(h) - words + 1
    if n < 1:
        return mixed((h * FACTORS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h))) if len(h) else h
    runs = h[:n] * FACTORS[0]
    for k in range(1, words):
        runs += h[k : k + n] * FACTORS[k]
    return np.unique(mixed(runs + np.uint64(words)))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of the set: equal for equal sets."""
    total = mixed(hashes * FACTORS[10]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(hashes))
    return int(mixed(total).view(np.int64)[0])


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of the set: a bit is 1 when more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


@dataclass(frozen=True)
class Rule:
    """Sets link when 100 * both >= percent * either."""

    words: int
    percent: int

    def most(self, total: int) -> int:
        """Shingles in which linked sets of this total size may differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def linked(self, both, total):
        return 100 * both >= self.percent * (total - both)

    def shingles(self, text: str | None) -> np.ndarray:
        return shingles(text, self.words)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Signed keys; linked sets share at least one."""
        n = len(hashes)
        starts = _bands()
        own = int(np.searchsorted(starts, n, side="right")) - 1
        out = []
        for tile in range(own, -1, -1):
            top = int(starts[tile + 1]) - 1
            largest = 100 * top // self.percent
            if n > largest:
                break
            parts = self.most(top + largest)
            spare = 1 + parts // 25
            parts += 1 + spare
            used = self.most(n + (100 * n // self.percent if tile == own else top)) + 1 + spare
            part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            part = part[: np.searchsorted(part, used)]
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            held = part[heads]
            sums = np.add.reduceat(mixed(hashes[: len(part)] * FACTORS[11]), heads) if len(heads) else np.zeros(0, np.uint64)
            if used - len(held) > spare:
                empty = np.setdiff1d(np.arange(used, dtype=np.uint64), held, assume_unique=True)
                held, sums = np.r_[held, empty], np.r_[sums, np.zeros(len(empty), np.uint64)]
            out.append(mixed(sums + mixed(held * FACTORS[6] + np.array([tile], np.uint64) * FACTORS[7])))
        return np.concatenate(out).view(np.int64)


@cache
def _bands() -> np.ndarray:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, 4 * starts[-1] // 3))
    return np.array(starts)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity bits in 64-bit words; at least as many bits as shingles."""
    size = 64
    while size < len(hashes):
        size *= 2
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return bits if len(bits) == words else np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def overlap_bound(a: np.ndarray, b: np.ndarray, total: int) -> int:
    words = min(len(a), len(b))
    return (total - int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(dtype=np.int64))) // 2


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted arrays."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
