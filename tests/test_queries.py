"""Every table query against its DuckDB equivalent, and the driver's contract."""

from __future__ import annotations

import pytest

from .conftest import DATA, same_as_duckdb
from kalends.plans import registry

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        same_as_duckdb(df, registry.ORACLES[name], SF)
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
