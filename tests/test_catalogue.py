"""Each registered query of the reference operators equals its SQL."""

import pytest

from rivulet.plans import catalogue
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert not differences(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
