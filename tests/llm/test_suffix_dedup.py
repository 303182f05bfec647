import hashlib
import random
from collections import Counter

import pytest

from spectraloom.llm import suffix_dedup as S
from spectraloom.llm import suffix_order as O
from tests.llm import edges


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_suffix_order_against_plain_sort(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([b"ab", b"a", b"abc", bytes(range(97, 123)), b"\x00\x01", b"the quick"])
    strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
    strings += [strings[0][: rng.randint(1, len(strings[0]))], b"x" + strings[-1]]
    depth = rng.choice([4, 8, 13, 200])
    order, common, _ = O.suffix_order(strings, depth)
    joined = [x for k, s in enumerate(strings) for x in [*[c + len(strings) for c in s], k]]
    want = sorted(range(len(joined)), key=lambda i: joined[i:])
    assert order.tolist() == want

    def prefix(a, b):
        k = 0
        while joined[a + k] == joined[b + k]:
            k += 1
        return min(k, depth)

    assert common.tolist() == [0] + [prefix(a, b) for a, b in zip(want, want[1:])]


@pytest.mark.parametrize("options", [{}, {"hot_texts": 1}, {"block_bytes": 500}])
def test_against_brute_force(spark, options):
    rng = random.Random(3)
    shared = edges.sentence(rng, 60)
    more = [(100 + i, edges.sentence(rng, 40) + shared + edges.sentence(rng, rng.randint(1, 40)), "en", "a") for i in range(12)]
    rows = edges.rows() + more + [(200, (shared + " ") * 9, "en", "a"), (201, "xyz" * 200, "en", "a"), (202, "no repeat " + shared[:190], "en", "a")]
    got = S.remove_repeats(edges.docs(spark, rows), length=200, gram=64, **options).collect()
    want = brute([(r[1] or "").encode() for r in rows], 200)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], *w) for r, w in zip(rows, want)], key=key)


def test_kept_text_and_empty_table(spark):
    rows = [(1, "q" * 250, "en", "a"), (2, "short", "en", "a")]
    got = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(edges.docs(spark, rows), with_text=True).collect()}
    assert got == {1: b"", 2: b"short"}
    assert S.remove_repeats(edges.empty(spark)).collect() == []
