"""Every registered query of the plans against its SQL text, and every other one for rows."""

import pytest

from tests.oracle import differences
from tiewright.plans import registry

SF = "/root/testdata/sf0.001"
#: Predicates that leave nothing at this size; checked at sf0.01 by hand.
MAY_BE_EMPTY = {"largest_gap", "degree_vs_betweenness"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    found = differences(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
    assert found is None or (name in MAY_BE_EMPTY and found == "no rows"), found


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_oracles_belong_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
