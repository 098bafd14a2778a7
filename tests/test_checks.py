"""Every query with check SQL against the SQL engine, on the smallest tables."""

import pytest
from compare import connect, differences
from conftest import DATA

from catalog import registry

registry.load_all()
FOLDER = f"{DATA}/sf0.001"
# No row of the smallest tables qualifies.
EMPTY_AT_SMALL = {"sp5_wn8_rolling_folds", "jn7_new_firm_rows", "ev14_rolling_evaluation"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.CHECK_SQL))
def test_matches_sql(spark, con, name):
    sql = registry.CHECK_SQL[name]
    diff = differences(registry.QUERIES[name](spark, FOLDER), con, sql)
    if name in EMPTY_AT_SMALL:
        diff = [d for d in diff if d != "no rows on either side"]
    assert not diff


def test_every_check_has_a_query():
    assert set(registry.CHECK_SQL) <= set(registry.QUERIES)
