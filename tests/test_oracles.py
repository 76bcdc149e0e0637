"""Every registered query that has SQL agrees with it; the others at least run."""

import pytest
from agree import assert_agree

from ferrule.plans import catalogue, extended, linked, more  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_agrees_with_sql(name, spark, duck, sf_dir):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        assert_agree(df, duck, catalogue.ORACLES[name])
    else:
        df.collect()
