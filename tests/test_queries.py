"""Every registered query of the engine against its SQL."""

import pytest

from lattiq.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(name, spark):
    from tests.conftest import DATA

    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
