"""The queries of the training-data operators against DuckDB on whole tables."""

import pytest
from compare import duck, mismatch

import corpus_pipeline
from voxtab.llm.oracles import SQL
from voxtab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, con, name):
    assert mismatch(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
