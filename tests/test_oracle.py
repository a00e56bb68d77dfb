"""Every registered query against its independent DuckDB definition."""

import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from harness import compare, duck

ORACLE_KEYS = sorted(k for k in E.oracle_sql() if not k.startswith("op"))  # tests/llm has the others


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", ORACLE_KEYS)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_every_query_has_an_oracle():
    from protea.plans import catalog
    catalog.load_all()
    # several trees on sampled rows are beyond SQL; test_training has a numpy twin
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"boosted_forest"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "term", "score"]
    assert df.count() > 0
