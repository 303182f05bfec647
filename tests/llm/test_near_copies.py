"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline as C
from spectraloom.llm import near_copies as N
from spectraloom.llm.jaccard_join import Join
from tests.compare import sf_dir
from tests.llm import edges


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def least_of_groups(rows):
    """The least id of each id's group, by all pairs."""
    sets = [plain(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and both / (len(sets[x]) + len(sets[y]) - both) >= 0.8:
                a, b = sorted((find(i), find(rows[y][0])))
                root[b] = a
    return {i: find(i) for i in root}


def copies(rng, n):
    """Bases with copies of 1 to 12 changed words each, and chains of copies of copies."""
    rows = []
    for base in range(n):
        words = edges.sentence(rng, 150, " ".join(f"w{i}" for i in range(500))).split()
        for k in range(8):
            text = list(words)
            for _ in range(rng.randint(0, 12) if k else 0):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
            rows.append((1 + 10 * base + k, " ".join(text)))
            words = text if base % 2 else words
    return rows


def test_stage_against_brute_force(spark):
    rows = copies(random.Random(4), 25)
    docs = edges.docs(spark, [(i, t, "en", "a") for i, t in rows] + [(None, rows[0][1], "en", "a")])
    kept = C.drop_near_copies(spark, docs, None)
    assert kept.columns == docs.columns
    want = {i for i, least in least_of_groups(rows).items() if i == least}
    assert 25 <= len(want) < 150
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet(sf_dir("0.01") + "/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {i for i, least in least_of_groups(rows).items() if i == least}
    assert {r.doc_id for r in C.drop_near_copies(spark, docs, None).collect()} == want


def test_proposals_spare_the_join_comparisons(spark, monkeypatch):
    """Pairs of the keys that the index's links connect are not compared again; the groups stay the same."""
    rows = copies(random.Random(7), 12)
    docs = edges.docs(spark, [(i, t, "en", "a") for i, t in rows])
    asked, linked, real = [], [], Join._checked

    def counted(self, pairs):
        asked.append({(r.u, r.v) for r in pairs.collect()})
        out = real(self, pairs)
        linked.append({(r.u, r.v) for r in out.collect()})
        return out

    monkeypatch.setattr(Join, "_checked", counted)
    found = {r.doc_id: r.component_id for r in N.near_groups(docs).collect()}
    rest = asked[1]
    plainly = Join(docs, N.RULE, "doc_id", "text")
    plainly.finish(plainly.components(plainly.links()))
    assert found == least_of_groups(rows)
    assert linked[0] and rest < asked[2]
    assert not {frozenset(p) for p in rest} & {frozenset(p) for p in linked[0]}


def test_edges(spark):
    docs = edges.docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    want = {i for i, least in least_of_groups(rows).items() if i == least}
    assert {r.doc_id for r in N.keep_representatives(docs).collect()} == want | {None}
    assert N.keep_representatives(edges.empty(spark)).collect() == []
