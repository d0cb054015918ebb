"""Debt per snapshot over all rows."""

import pytest

import __spark_entry__ as entry
from orefold.operators import relational as rel
from tests.test_queries import DATA, compare


def test_debt_by_snapshot_keeps_every_snapshot_and_fractions(spark, rows):
    values = spark.createDataFrame([(1, "a", "cc", 12.5), (1, "b", "cc", 8.0), (2, "a", "cc", 13.0), (None, "a", "cc", 11.0)], "snapshot_no int, target_id string, metric_id string, value double")
    limits = spark.createDataFrame([("cc", 10.0, 2.0)], "metric_id string, maximum double, weight double")
    assert rows(rel.threshold_debt(values, limits, by=["snapshot_no"])) == [(None, 2.0, 4.0, 1, 2.0), (1, 5.0, 25.0, 1, 5.0), (2, 6.0, 36.0, 1, 6.0)]


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", ["threshold_debt", "weighted_score"])
def test_debt_queries(spark, name):
    compare(spark, name, entry.queries(), entry.oracle_sql())
