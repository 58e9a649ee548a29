"""Every registered query against its SQL in DuckDB, on non-empty results."""

import pytest

import __spark_entry__ as entry
import oracle

SQL = entry.oracle_sql()
RUN = entry.queries()


@pytest.fixture(scope="module")
def db(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, folder, db):
    assert oracle.compare(RUN[name](spark, folder), db, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_has_rows(name, spark, folder):
    assert RUN[name](spark, folder).count() > 0


def test_entry_has_a_row_per_platform(spark):
    assert entry.entry(spark).count() == 3
