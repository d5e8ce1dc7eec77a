"""Functions and small weeks against results by hand."""

import pytest

from tests import goldens, known_weeks

CASES = goldens.QUERIES | known_weeks.QUERIES


@pytest.mark.parametrize("name", sorted(CASES))
def test_known_results(spark, sql, name):
    got = CASES[name](spark, None)
    want = sql.execute((goldens.ORACLES | known_weeks.ORACLES)[name]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def sql():
    import duckdb

    return duckdb.connect()
