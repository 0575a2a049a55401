"""Every query with an oracle gives the oracle's rows."""

import pytest
from conftest import comparable, duck

from tickforge.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = comparable([tuple(r) for r in df.collect()], df.columns)
    rows, columns = duck(ORACLES[name], sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert got == comparable(rows, columns)
