"""A ledger takes every batch once, whole or not at all."""

import datetime

import pytest
from pyspark.sql import functions as F

from veilgrain.operators import ledger
from veilgrain.session import fresh_path


def days(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_each_row_once(spark):
    path = fresh_path(spark, "ledger")
    rows = spark.createDataFrame([(days(k % 3), k) for k in range(9)], "day date, k long")
    assert ledger.committed(spark, path).count() == 0
    assert ledger.append_ledger(rows.filter("k < 5"), path, "a")
    assert not ledger.append_ledger(rows, path, "a")
    failing = rows.filter("k >= 5").withColumn("k", F.when(F.col("k") < 8, F.col("k")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        ledger.append_ledger(failing.repartition(4), path, "b")
    rows.filter("k = 5").write.mode("overwrite").partitionBy("day").parquet(f"{path}/data/batch=b")

    def kept():
        return sorted(r.k for r in ledger.read_ledger(spark, path, rows.schema).collect())

    assert kept() == list(range(5))
    assert ledger.append_ledger(rows.filter("k >= 5"), path, "b")
    assert kept() == list(range(9))
    assert {(r.batch, r.n_rows) for r in ledger.committed(spark, path).collect()} == {("a", 5), ("b", 4)}
    assert ledger.append_ledger(rows.limit(0), path, "empty") and kept() == list(range(9))
    plan = ledger.read_ledger(spark, path, rows.schema).filter(F.col("day") == days(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
