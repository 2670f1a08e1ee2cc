import pytest

from tallystone.plans import catalogue
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, name):
    assert differences(catalogue.queries()[name](spark, SF), catalogue.SQL[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_no_cartesian_product(spark):
    for name in ("q12_shared_fingerprint", "q14_prefix_link", "q16_hit_rollup", "q11_term_scan"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
