"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
import check


@pytest.fixture(scope="module")
def duck(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, sf, name):
    n, verdict = check.compare(spark, duck, sf, name)
    assert verdict in ("ok", "rows only"), verdict


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20
