from __future__ import annotations

import pytest

import __spark_entry__ as entry

from .compare import assert_same, database

OWN = [n for n in entry.oracle_sql() if not (n[:2] == "op" and n[2:3].isdigit())]


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", OWN)
def test_same_as_sql(spark, sf, db, name):
    assert_same(entry.queries()[name](spark, sf).toPandas(), db.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
