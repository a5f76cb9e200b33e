"""Every registered query against its DuckDB SQL (sf0.001), plus entry()."""
import pytest

import __spark_entry__ as E
from petrel.plans.catalog import QUERIES
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    ref = con.execute(SQL[name]).df()
    assert compare(got, ref) is None, compare(got, ref)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["word", "cnt", "idx"]


def test_every_query_has_oracle_or_is_listed_rows_only():
    rows_only = {"model_lr", "model_rf", "model_embedding_mlp"}
    assert set(QUERIES) - set(SQL) == rows_only
