"""Every registered query against its SQL, on the smallest data; the others must give rows."""

from __future__ import annotations

import pytest

from gridloom.plans import catalogue
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, SF), SF, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["region_polygons", "agglomerative"])
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
