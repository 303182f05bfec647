"""Small vector tables with awkward rows, and plain versions of the vector operators."""

from __future__ import annotations

import hashlib
import math
import random

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, row string, cell string, q string, distance string"
CLASH = ("c", "r", "x", "q", "d")


def rows(seed: int = 3, count: int = 160, size: int = 64) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    vec = lambda: [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]
    one = vec()
    out = [(i, vec(), rng.randrange(4)) for i in range(count)]
    out += [(1000 + i, list(one), i % 3) for i in range(30)]  # repeated vectors: ties
    out += [(1000, list(one), 0), (1000, list(one), 0)]  # repeated rows
    out += [(2000, None, 1), (2001, [float("nan")] + one[1:], 1), (2002, [None] + one[1:], 1), (2003, [math.inf] + one[1:], 2), (2004, one[:10], 2), (2005, [], 2)]
    out += [(2100, one, None), (None, one, 1), (2200, [3e30] + one[1:], 3), (2201, [0.0] * size, 3)]
    return out


def table(spark, of: list[tuple]):
    return spark.createDataFrame([r + CLASH for r in of], SCHEMA).repartition(3)


def quantised(x: list[float]) -> tuple[int, ...]:
    import numpy as np

    return tuple(max(-(1 << 24), min(1 << 24, math.floor(256 * float(np.float32(v))))) for v in x)


def fit(x, size=None) -> bool:
    return x is not None and (size is None or len(x) == size) and all(v is not None and math.isfinite(v) for v in x)


def plain_clusters(of: list[tuple], k: int, rounds: int, salt: int, size: int = 64) -> list[tuple]:
    kept = [(i, quantised(x)) for i, x, _ in of if fit(x, size)]
    key = lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0])
    centroids = [list(q) for _, q in sorted(kept, key=key)[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    nearest = lambda q: min((far(q, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        for n, g in groups.items():
            centroids[n] = [sum(v) // len(g) for v in zip(*g)]
    found = [(i, *nearest(q)) for i, q in kept]
    inertia: dict[int, int] = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in found]


def plain_negatives(of: list[tuple], every: int, positives: int, negatives: int, least: int, size: int = 64) -> list[tuple]:
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, quantised(x)) for i, x, lab in of if i is not None and lab is not None and fit(x)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (a, la, qa) in enumerate(kept):
        if a % every:
            continue
        scored = sorted((-dot(qa, q), i, lab) for m, (i, lab, q) in enumerate(kept) if m != n)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [x for x in scored if x[2] != la and least * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return out
