import random

import numpy as np
import pytest
import xxhash

from spectraloom.llm import simhash as S
from spectraloom.llm.components import connected_components
from tests.llm import edges


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(codes, limit=3):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_fingerprint():
    for text in ["", "a", "a b", "a b c d", "É x y z w", "The quick brown fox " * 300]:
        assert S.simhash64(text) == plain(text)


def clustered(n, seed):
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(n)}
    for base in list(codes)[:8]:
        for _ in range(n):
            x = base
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    return sorted(codes)


def test_tree_finds_every_pair():
    codes = np.array(clustered(80, 1), np.uint64)
    bucket = np.sort(np.random.default_rng(0).integers(0, 4, len(codes)))
    order = np.lexsort((S.gray_rank(codes), bucket))
    codes, bucket = codes[order], bucket[order]
    got = {(int(i), int(j)) for a, b in S.GrayTree(bucket, codes).pairs(bucket, 3) for i, j in zip(a, b)}
    near = np.argwhere((np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3) & (bucket[:, None] == bucket[None, :]))
    assert got == {(int(i), int(j)) for i, j in near if i < j}


@pytest.mark.parametrize("bucket_rows", [50_000, 20])
def test_links_connect_what_brute_force_connects(spark, bucket_rows):
    codes = clustered(60, 2)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = S.link_codes(spark.createDataFrame([(c,) for c in signed], "code long"), 3, bucket_rows)
    found = {r.node: r.root for r in connected_components(links).collect()}
    groups = {}
    for c, r in zip(signed, roots(codes)):
        groups.setdefault(r, set()).add(c)
    got = {}
    for c in signed:
        got.setdefault(found.get(c, c), set()).add(c)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values()}


def test_documents_against_brute_force(spark):
    rows = edges.rows()
    got = S.near_duplicates(edges.docs(spark, rows)).collect()
    codes = [plain(r[1]) for r in rows]
    root = roots(codes)
    least = {}
    for r, k in zip(rows, root):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = [(r[0], c, least.get(k)) for r, c, k in zip(rows, codes, root)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(g.doc_id, g.code % (1 << 64), g.component_id) for g in got], key=key) == sorted(want, key=key)
    kept = S.keep_representatives(edges.docs(spark, rows))
    assert kept.columns == edges.docs(spark).columns
    assert {r.doc_id for r in kept.collect()} == {w[2] for w in want}


def test_empty(spark):
    assert S.near_duplicates(edges.empty(spark)).collect() == []


def test_long_chain(spark):
    edges_ = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges_, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
