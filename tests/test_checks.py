"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    verdict = compare(spark, SF, name, queries()[name], oracle_sql().get(name))
    assert verdict.startswith(("ok", "ROWS")), verdict


def test_entry(spark):
    assert entry(spark).count() > 0
