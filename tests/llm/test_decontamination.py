import random

import numpy as np
import pytest

from spectraloom.llm import decontamination as D
from tests.llm import edges


def within(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != t), last[j] + 1, row[j - 1] + 1)
    return min(row)


def noisy(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        chars[i : i + 1] = rng.choice([[], [rng.choice("abcdefgh")], [chars[i], rng.choice("abcdefgh")]])
    return "".join(chars)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_against_plain_alignment(spark, block_bytes):
    rng = random.Random(8)
    items = [(i, edges.sentence(rng, rng.randint(9, 40))) for i in range(6)] + [(50, None), (51, ""), (52, "too short"), (None, None)]
    rows = edges.rows()
    for k, (item, text) in enumerate(items[:6]):
        for edits in (0, 3, 6, 12, 25, 60):
            rows.append((300 + 10 * k + edits // 3, edges.sentence(rng, 12) + ". " + noisy(rng, text.upper() if edits == 0 else text, edits) + " -- " + edges.sentence(rng, 9), "en", "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.find_leaks(edges.docs(spark, rows), bench, block_bytes=block_bytes).collect()}
    index = D.Index(items[:6], **{k: v for k, v in D.SEARCH.items() if k != "block_bytes"})
    want = {}
    for r in rows:
        text = D.normalise(r[1] or "")
        if len(text) > 3000:
            continue
        for u in range(len(index.item)):
            unit = "".join(map(chr, index.text[u][: index.length[u]]))
            edits = within(unit, text)
            if edits <= index.budget[u]:
                key = (r[0], int(index.item[u]))
                want[key] = min(edits, want.get(key, 99))
    assert got == want and any(e > 2 for e in want.values()) and any(e == 0 for e in want.values())


def test_clean_documents_stay(spark):
    rng = random.Random(2)
    leaked = edges.sentence(rng, 40)
    bench = spark.createDataFrame([(1, leaked)], "item_id long, text string")
    docs = edges.docs(spark, edges.rows() + [(400, "before " + leaked + " after", "en", "a")])
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 1 and kept.where("doc_id = 400").isEmpty()
    found = D.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.n_items, list(r.item_ids), r.edits) for r in found] == [(400, 1, [1], 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = edges.docs(spark)
    assert D.find_leaks(docs, none).collect() == [] and D.drop_contaminated(docs, none).count() == docs.count()
    assert D.find_leaks(edges.empty(spark), none).collect() == []


def test_band_holds_every_shift():
    """A match shifted by the whole budget still reaches the bound in one band."""
    item = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnop"), 120))
    index = D.Index([(1, item)], 10, 120, 0.08, 20, 10)
    budget = int(index.budget[0])
    text = item[:60] + "z" * budget + item[60:]
    unit, _, edits = index.search(D._points("x" * 37 + text + "y" * 20))
    assert len(unit) and edits.min() == budget


def test_excerpts_from_any_place_of_an_item(spark):
    """120 characters of a long item, cut out anywhere, are a leak; with as many edits as the budget too, as long as no more."""
    rng = random.Random(11)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    bench = spark.createDataFrame([(1, item), (2, "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 26)) * 4)], "item_id long, text string")
    cuts = {1000 + o: item[o : o + 120] for o in range(0, 281, 7)}
    for k, o in enumerate(range(3, 270, 11)):
        cuts[2000 + k] = "".join("#" if i in set(range(5, 120, 10 + k % 3)) else c for i, c in enumerate(item[o : o + 120])).replace("#", "0")
    docs = edges.docs(spark, [(i, edges.sentence(rng, 5) + " " + t + " " + edges.sentence(rng, 5), "en", "a") for i, t in cuts.items()])
    got = {r.doc_id: r.edits for r in D.find_leaks(docs, bench).collect()}
    want = {}
    for i, t in cuts.items():
        least = min(within(item[o : o + 120], t) for o in range(281) if i < 2000 or abs(o - (3 + 11 * (i - 2000))) < 12) if i >= 2000 else 0
        if least <= 9:
            want[i] = least
    assert got == want and len([i for i in want if i < 2000]) == 41


def test_short_items_on_word_boundaries(spark):
    bench = spark.createDataFrame([(1, "Cat sat!"), (2, "今天天气很好。"), (3, "cat sat"), (4, "a"), (5, "?!")], "item_id long, text string")
    texts = ["The cat, sat down", "concat sat down", "the cat saturday", "他说：“今天天气很好”。", "今天天气很好吗", "cat sat", "x"]
    docs = edges.docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    assert sorted((r.doc_id, r.item_id, r.edits) for r in D.find_leaks(docs, bench).collect()) == [(0, 1, 0), (0, 3, 0), (3, 2, 0), (5, 1, 0), (5, 3, 0)]
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == {1, 2, 4, 6}
