"""Registered queries: SQL where there is some, row counts and columns elsewhere; the wiring of the entry module."""
import pytest

import __spark_entry__ as E
from petrel.llm.queries import QUERIES
from petrel.llm.sql import ORACLE_SQL
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_ann": ["query_id", "rank", "vec_id", "score"],
    "op9_quality": ["doc_id", "host", "path", "p_document", "site_rate", "p_bad", "kept"],
    "op10_html_text": ["page_id", "url", "text", "n_chars"],
}
ROWS = {"op1_token_files": 200, "op6_byte_bpe": 200, "op8_ann": 50, "op9_quality": 200, "op10_html_text": 50}


def test_every_query_is_registered_and_checked():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())
    assert set(QUERIES) == set(ORACLE_SQL) | set(COLUMNS)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    got = E.queries()[name](spark, SF).toPandas()
    assert compare(got, duck(SF).execute(ORACLE_SQL[name]).df()) is None


@pytest.mark.parametrize("name", COLUMNS)
def test_other_queries(spark, name):
    df = E.queries()[name](spark, SF)
    assert [c for c in df.columns if c in COLUMNS[name]] == COLUMNS[name] and df.count() == ROWS[name]
