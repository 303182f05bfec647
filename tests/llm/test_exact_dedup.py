import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spectraloom.llm import exact_dedup as E
from tests.llm import edges


def plain(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(i)
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        for i in members:
            out.append((rows[i][0], rows[keep][0], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bits", [256, 4])
def test_groups_even_when_digests_collide(spark, bits):
    rows = edges.rows()
    digest = E.sha256 if bits == 256 else (lambda c: F.substring(E.sha256(c), 1, bits // 4))
    got = E.duplicate_groups(edges.docs(spark, rows), digest=digest).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted([w[:3] for w in plain(rows)], key=key)
    assert sorted([(g.doc_id, g.keep_id, g.group_size) for g in got], key=key) == want
    assert sum(g.kept for g in got) == len({w[3] for w in plain(rows)})  # one row of each group
    if bits == 256:
        assert {(g.doc_id, g.digest) for g in got} == {(w[0], w[3]) for w in plain(rows)}


def test_drop(spark):
    docs = edges.docs(spark)
    kept = E.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({w[3] for w in plain(edges.rows())})


def test_state_goes_on_over_runs(spark, tmp_path):
    first = [(5, "a b", "en", "a"), (6, "c", "en", "a")]
    second = [(1, "ab", "en", "a"), (7, "a  b", "en", "a")]
    E.duplicate_groups(edges.docs(spark, first), state_dir=str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert rows.count() == 2
    again = edges.docs(spark, second)
    E._narrow(again, "doc_id", "text", E.sha256).write.mode("append").parquet(f"{tmp_path}/rows")
    state = {r.group_size: r.best.inv_id for r in E.fold_stream(f"{tmp_path}/rows", spark, str(tmp_path)).collect()}
    assert state == {3: ~7, 1: ~6}


def test_empty(spark):
    assert E.duplicate_groups(edges.empty(spark)).collect() == []
    assert E.drop_duplicates(edges.empty(spark)).collect() == []
