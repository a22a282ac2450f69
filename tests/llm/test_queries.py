"""Each corpus query on the smallest tables against its SQL, or for rows where SQL cannot say it."""

import pytest

from tests.compare import differences
from webloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, con):
    result = QUERIES[name](spark, folder)
    if name in ORACLES:
        assert differences(result, con, ORACLES[name]) == []
    else:
        assert result.count() > 0


def test_all_operators_are_there():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
