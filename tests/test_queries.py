"""Every registered query at the smallest scale, next to its check SQL where it has one."""

import pytest

import __spark_entry__ as entry_module
from tests import compare as C

SF = C.sf_dir("0.001")
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return C.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = C.spark_rows(QUERIES[name](spark, SF))
    assert got[1], "no rows"
    if name in ORACLE:
        assert C.differences(got, C.duck_rows(con, ORACLE[name])) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert {"label", "split", "n", "detection_rate", "auc"} <= set(df.columns)
    assert df.count() == 10
