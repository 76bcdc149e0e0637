"""The training-data queries that SQL can express agree with it."""

import pytest

from agree import assert_agree
from ferrule.llm import queries

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, spark, duck, sf_dir):
    assert_agree(queries.queries()[name](spark, sf_dir), duck, ORACLES[name])
