"""Copies of lines: only keys that stand twice are gathered."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import cleaning as C
from ledgerlark.sources import scratch


@pytest.mark.parametrize("names", [C.BROADCAST_NAMES if hasattr(C, "BROADCAST_NAMES") else 0, 1])
def test_only_repeated_keys_are_gathered(spark, monkeypatch, names):
    monkeypatch.setattr(C, "BROADCAST_NAMES", names)
    rows = spark.range(200).select(
        F.concat(F.lit("O"), F.when(F.col("id") < 5, 0).when(F.col("id") < 7, 1).otherwise(F.col("id"))).alias("order_id"), F.lit("2026-07-01").cast("date").alias("date"), F.lit("S").alias("store_id"), F.lit("P").alias("product_id"),
        F.lit(1).cast("long").alias("qty"), F.lit(0).cast("long").alias("amount_cents"), F.lit(None).cast("string").alias("payment"), F.col("id").cast("string").alias("raw_date"), F.lit("1").alias("raw_qty"), F.lit("0").alias("raw_amount"),
    )
    passed = scratch.written(rows, "passed")
    got = C.number_copies(passed)
    assert sorted(r.copy for r in got.where("order_id = 'O0'").collect()) == [1, 2, 3, 4, 5] and sorted(r.copy for r in got.where("order_id = 'O1'").collect()) == [1, 2]
    assert got.count() == 200 and got.where("copy = 1").count() == 195 and got.where("dup_group is null").count() == 0
    assert got.where("order_id = 'O0'").orderBy(F.col("raw_date").cast("int")).first().copy == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan and plan.count("Window") == 1
