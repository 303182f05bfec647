import random
from collections import defaultdict

from spectraloom.llm import packing as P
from tests.llm import edges


def naive(sizes, sources, clusters, order, capacity):
    """Best fit by looking at every bin."""
    bins = []
    at = [0] * len(sizes)
    for i in order:
        fits = [b for b in bins if b["left"] >= sizes[i] and sources[i] not in b["s"] and clusters[i] not in b["c"]]
        left = min((b["left"] for b in fits), default=None)
        fits = [b for b in fits if b["left"] == left]
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set(), "n": len(bins)})
            fits = bins[-1:]
        b = fits[0]
        b["left"] -= sizes[i]
        b["s"] |= {sources[i]} - {None}
        b["c"] |= {clusters[i]} - {None}
        at[i] = b["n"]
    return at, [capacity - b["left"] for b in bins]


def test_window_is_best_fit():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randint(1, 120)
        sizes = [rng.randint(0, 50) for _ in range(n)]
        sources = [rng.choice(["hot", "hot", "a", "b", "c", None]) for _ in range(n)]
        clusters = [rng.choice([1, 2, 3, None, *range(10, 60)]) for _ in range(n)]
        order = sorted(range(n), key=lambda i: (-sizes[i], i))
        number, offset = P.pack_window(sizes, sources, clusters, order, 60)
        fill = defaultdict(int)
        for i in order:
            assert offset[i] == fill[number[i]]
            fill[number[i]] += sizes[i]
            assert fill[number[i]] <= 60
        _, want = naive(sizes, sources, clusters, order, 60)
        assert sorted(fill.values()) == sorted(want)


def check(rows, pieces, capacity):
    per_doc, per_bin = defaultdict(list), defaultdict(list)
    for p in pieces:
        per_doc[p.doc_id].append(p)
        per_bin[p.bin].append(p)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[0]] += len((r[1] or "").encode())
    assert {d: sum(p.size for p in ps) for d, ps in per_doc.items()} == dict(sizes)
    for ps in per_bin.values():
        ps = sorted(ps, key=lambda p: (p.offset, p.size))
        assert [p.offset for p in ps] == [sum(q.size for q in ps[:i]) for i in range(len(ps))]
        assert sum(p.size for p in ps) <= capacity
        if len(ps) > 1:
            sources = [p.source for p in ps if p.source is not None]
            assert len(sources) == len(set(sources)) and len({p.cluster for p in ps}) == len(ps)


def test_documents(spark):
    rows = edges.rows()
    for window in (4096, 5):
        got = P.pack_documents(edges.docs(spark, rows), capacity=256, window_rows=window).collect()
        check(rows, got, 256)
        assert len({(p.doc_id, p.piece, p.cluster) for p in got if p.doc_id not in (9, None)}) == len([p for p in got if p.doc_id not in (9, None)])


def test_one_source_for_everything_and_empty(spark):
    rows = [(i, "x" * (10 + i % 7), "en", "hot") for i in range(300)]
    got = P.pack_documents(edges.docs(spark, rows), capacity=100).collect()
    check(rows, got, 100)
    assert len({p.bin for p in got}) == 300  # a source never meets itself
    assert P.pack_documents(edges.empty(spark)).collect() == []
