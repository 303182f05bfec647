import random

import numpy as np
import pytest

from spectraloom.llm import common, jaccard_join, shingle_sets
from spectraloom.llm.queries import QUERIES
from tests.compare import sf_dir
from tests.llm import edges


def plain_set(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def plain_components(rows, words, percent):
    """(doc_id, size, component) by comparing all pairs."""
    sets = [plain_set(r[1], words) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def chains(seed: int = 2) -> list[tuple]:
    """Groups of copies with some words changed, around the threshold, of many sizes; one dense group."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    out, number = [], 100

    def changed(words, share):
        return [word() if rng.random() < share else w for w in words]

    for size in (4, 5, 6, 7, 9, 12, 20, 33, 60, 150, 700, 2500):
        base = [word() for _ in range(size)]
        for _ in range(6):
            base = changed(base, rng.choice([0.0, 0.01, 0.02, 0.04, 0.1]))
            out.append((number, " ".join(base + [word() for _ in range(rng.choice([0, 0, 1, size // 12]))]), "en", "s"))
            number += 1
    centre = [word() for _ in range(90)]
    for _ in range(150):
        out.append((number, " ".join(changed(centre, 0.013)), "en", "s"))
        number += 1
    return out


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (1, 50)])
def test_against_all_pairs(spark, words, percent):
    rows = edges.rows() + chains()
    got = jaccard_join.join_components(edges.docs(spark, rows), words, percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows, words, percent)


def test_tiles_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(common, "IDS_AT_MOST", 0)
    checked = jaccard_join.Join._checked
    # without the first two rounds everything is left to the tiles
    monkeypatch.setattr(jaccard_join.Join, "_checked", lambda self, pairs: checked(self, pairs.limit(0)))
    rows = [r for r in edges.rows() + chains(5) if plain_set(r[1], 4)]
    got = {tuple(r) for r in jaccard_join.join_components(edges.docs(spark, rows), 4, 85).collect()}
    want = {(i, n, c) for i, n, c in plain_components(rows, 4, 85)}
    apart = {r[0] for r in got ^ want}
    # keys of two classes are settled by the first rounds alone
    counts = {}
    for _, _, c in want:
        counts[c] = counts.get(c, 0) + 1
    assert all(counts[c] < 10 for i, _, c in want if i in apart)


def test_empty_table(spark):
    assert jaccard_join.join_components(edges.empty(spark)).collect() == []


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 85, 95):
        rule = shingle_sets.Rule(4, percent)
        for size in [*range(1, 40), 77, 250, 999, 4000]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
                for b in range(len(a), 100 * len(a) // percent + 1, max(1, len(a) // 50)):
                    shared = -(-percent * (len(a) + b) // (100 + percent))  # the least overlap that links
                    if shared <= len(a):
                        other = np.unique(np.r_[rng.permutation(a)[:shared], rng.integers(0, 1 << 63, b - shared, np.uint64) * np.uint64(2) + np.uint64(1)])
                        assert rule.linked(shared, len(a) + len(other))
                        assert np.intersect1d(rule.keys(a), rule.keys(other)).size


def test_sets_with_empty_parts_share_a_key():
    """Hashes crowded into a few parts leave more parts empty than a set may leave out."""
    rule = shingle_sets.Rule(4, 85)
    a = np.arange(200, dtype=np.uint64)
    b = np.r_[a[16:], np.arange(1 << 63, (1 << 63) + 16, dtype=np.uint64)]
    assert rule.linked(184, 400) and np.intersect1d(rule.keys(a), rule.keys(b)).size


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(8)
    for n, m in [(3, 5), (64, 65), (300, 900), (5000, 4000)]:
        pool = rng.integers(0, 1 << 63, n + m, np.uint64)
        for both in (0, 1, n // 2, n):
            a, b = np.unique(pool[:n]), np.unique(pool[n - both : n - both + m])
            total = len(a) + len(b)
            exact = shingle_sets.overlap(a, b)
            assert exact == len(np.intersect1d(a, b)) <= shingle_sets.overlap_bound(shingle_sets.bitmap(a), shingle_sets.bitmap(b), total)
    a = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64))
    b = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64))
    assert not shingle_sets.Rule(4, 85).linked(shingle_sets.overlap_bound(shingle_sets.bitmap(a), shingle_sets.bitmap(b), 2000), 2000)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(sf_dir("0.001") + "/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_tiled_jaccard"](spark, sf_dir("0.001"))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows, 4, 85)
