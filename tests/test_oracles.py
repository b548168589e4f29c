"""Every query with a SQL twin, on both engines."""

import pytest
from compare import same

from lumenfold.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, duck, small, name):
    same(Q.QUERIES[name](spark, small).toPandas(), duck.sql(Q.ORACLES[name]).df())


def test_only_random_fill_has_no_sql():
    assert set(Q.QUERIES) - set(Q.ORACLES) == {"nan_fill_random"}
