"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pytest
from oracle_check import differences, oracle_frame

from __spark_entry__ import entry, oracle_sql, queries
from slotalign.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = queries()[name](spark, SF_DIR).toPandas()
    assert len(result)
    if name in oracle_sql():
        assert differences(result, oracle_frame(SF_DIR, oracle_sql()[name])) is None


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["sample_id", "slot", "p0", "p1"] and frame.count() > 0
