"""Every registered query against its DuckDB oracle at the smoke scale.

The driver runs the same comparison at sf0.01; running it here keeps every
key executable and matching on the small tables.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"n_vectors", "mean_l2_norm", "std_l2_norm"}


@pytest.mark.parametrize("key", sorted(queries()))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, SF, key, queries()[key], oracle_sql().get(key))
    assert r["status"] in ("match", "rows-only"), r
