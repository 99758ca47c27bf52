"""Every core query with SQL gives what its SQL gives; the others run."""

from __future__ import annotations

import pytest

from lectern.queries import FLAGSHIP, QUERIES, SQL
from tests.oracle import differs


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    assert differs(spark, data, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0


def test_flagship_is_bounded(spark, data):
    df = QUERIES[FLAGSHIP](spark, data)
    assert df.groupBy("query_id").count().where("count > 6").count() == 0
