"""The registry as the driver uses it: the flagship query, and a sample against its comparison SQL."""

import pytest

import __spark_entry__ as entry
from tests.parity import connect, differences

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["f15_riskiest_segments", "b6_parallel_collapsed", "d7_segment_zonation", "g2_segment_context", "e12_cell_years", "i4_possible_duplicates"]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment_id", "risk_score", "risk_level", "closed"] and df.count() > 0


def test_every_comparison_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert differences(got, connect(SMALL).execute(entry.oracle_sql()[name]).df()) == ""
