"""Every query that has SQL gives its rows; every other runs and has a stable schema."""

from __future__ import annotations

import pytest
from compare import DATA, connection, same_rows

from folio.plans import geometry, library, lines, notation, office, reconcile, registry, replies, runtime, structure  # noqa: F401

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, con, name):
    same_rows(registry.QUERIES[name](spark, str(DATA / SF)), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, str(DATA / SF))
    assert df.count() > 0
    assert df.dtypes == registry.QUERIES[name](spark, str(DATA / SF)).dtypes


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
