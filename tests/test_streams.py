"""What the streams keep and write."""

from pyspark.sql import functions as F

from ledgerlark.plans import answers
from ledgerlark.streaming import jobs


def _run(stream, tmp_path):
    run = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
    run.awaitTermination()
    return run.recentProgress


def test_daily_stream_keeps_no_row_for_each_order(spark, tmp_path):
    day = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 20 as int))")
    lines = spark.range(4000).select(F.concat(F.lit("ORD"), (F.col("id") % 1500).cast("string")).alias("order_id"), (F.col("id") % 3 == 0).cast("int").alias("is_refund"), F.lit(150).cast("long").alias("amount_cents"), day.alias("ts"))
    # Lines without an order count as one order.
    lines = lines.withColumn("order_id", F.when(F.col("order_id") != "ORD7", F.col("order_id")))
    lines.write.parquet(str(tmp_path / "in"))
    progress = _run(jobs.daily_stream(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")), parts=4), tmp_path)
    assert max(o.numRowsTotal for p in progress for o in p.stateOperators) <= 20 * 4
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().set_index("date")
    day_of = lines.withColumn("date", F.to_date("ts")).withColumn("o", F.when(F.col("is_refund") == 0, F.coalesce("order_id", F.lit(""))))
    expected = day_of.groupBy("date").agg(F.countDistinct("o").alias("orders"), (F.sum("amount_cents") / 100.0).alias("net")).toPandas().set_index("date")
    assert len(got) >= 12
    for date, row in got.iterrows():
        assert row["orders"] == expected.loc[date, "orders"] and row["net_revenue"] == expected.loc[date, "net"]


def test_stream_cleaning_writes_only_what_it_gives(spark, sf_dir, monkeypatch):
    drained = []
    monkeypatch.setattr(answers, "_drained", lambda stream, mode: drained.append(stream) or stream)
    answers.x01(spark, sf_dir)
    assert drained[0].columns == ["order_id", "date", "store_id", "product_id", "qty", "amount_cents"]
