"""What the library makes of rows written by hand, against the rows worked out for them."""

import pytest

from tests import hand_worked
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(hand_worked.QUERIES))
def test_rows_worked_out_by_hand(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", hand_worked.QUERIES[name], hand_worked.ORACLES[name]) is None
