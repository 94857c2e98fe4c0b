from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidemark import tables

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_entry_and_core_queries(spark):
    assert entry.entry(spark).count() > 0
    for module in entry.CORE:
        for name in module.QUERIES:
            df = entry.queries()[name](spark, DATA)
            assert df.columns and len(df.columns) == len(set(df.columns)), name
            df.write.format("noop").mode("overwrite").save()


def test_size_checks(spark):
    df = spark.range(1000)
    assert tables.estimated_bytes(df) == 8000
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(df.join(tables.small(df, 10_000), "id")) and "broadcast" not in plan(df.join(tables.small(df, 7_999), "id"))
    assert tables.training_rows(df, 100, "id").count() < 200 and tables.training_rows(df, 5000, "id").count() == 1000
    assert tables.spread(df.coalesce(1)).rdd.getNumPartitions() > 1
    assert tables.shared_dir(spark).startswith("file://")
