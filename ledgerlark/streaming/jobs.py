"""Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cleaning import DUP_KEY, RULES, first_reject, flag_foreign_keys, parse_lines
from ..operators.history import newest_traces
from ..sources.sales import FACT_SCHEMA


def stream_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts as files arrive."""
    return spark.readStream.schema(FACT_SCHEMA).parquet(path)


def clean_stream(facts: DataFrame, stores: DataFrame, products: DataFrame, delay: str = "7 days") -> DataFrame:
    """Kept lines of a stream of facts: rules 1-5 by row, copies dropped within the watermark, then rule 7.

    A copy that comes later than ``delay`` is not known as one.
    """
    flagged = flag_foreign_keys(parse_lines(facts), stores, products).withColumn("reject", first_reject())
    timed = flagged.where("reject is null").withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(DUP_KEY).withColumn("reject_v3", F.when(F.col("amount_cents") == 0, RULES[6])).where("reject_v3 is null")


def daily_stream(lines: DataFrame, delay: str = "7 days", parts: int = 64) -> DataFrame:
    """Date, orders and net_revenue by day, from kept lines (order_id, is_refund, amount_cents, ts).

    A day is dealt over ``parts`` by the order; a part's state is one row, the set of its orders that sold and its sum, so that
    neither keys nor rows are kept for each order. A part is written again in each batch that brings lines of its day.
    Exact within the watermark; rows later than it are left out.
    """
    sold, part = F.col("is_refund") == 0, F.pmod(F.xxhash64("order_id"), F.lit(parts)).cast("int").alias("part")
    unnamed = F.max((sold & F.col("order_id").isNull()).cast("long"))  # lines without an order are one order, and no element of a set
    by_part = lines.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), part).agg(F.sum("amount_cents").alias("cents"), F.collect_set(F.when(sold, F.col("order_id"))).alias("ids"), unnamed.alias("unnamed"))
    by_day = by_part.groupBy(F.window(F.window_time("window"), "1 day").alias("day")).agg(F.sum(F.size("ids") + F.coalesce("unnamed", F.lit(0))).alias("orders"), F.sum("cents").alias("cents"))
    return by_day.select(F.to_date("day.start").alias("date"), "orders", (F.col("cents") / 100.0).alias("net_revenue"))


_STATE = "store string, product string, windows array<string>, turns array<string>, epoch long"
_OUT = "session_id string, store string, product string, windows array<string>, n_turns int"


def _update(idle_ms: int | None, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    store, product, windows, turns, epoch = state.get if state.exists else (None, None, [], [], 0)
    windows, turns = list(windows), list(turns)
    for row in pd.concat(list(batches)).sort_values("turn_id").to_dict("records"):
        if row["epoch"] > epoch:
            store, product, windows, turns, epoch = None, None, [], [], int(row["epoch"])
        if not row["ok"]:
            continue
        store, product = row["store"] or store, row["product"] or product
        if row["window"]:
            windows = [*(w for w in windows if w != row["window"]), row["window"]][-3:]
        turns = [*turns, row["text"]][-12:]
    state.update((store, product, windows, turns, epoch))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame([(key[0], store, product, windows, len(turns))], columns=["session_id", "store", "product", "windows", "n_turns"])


def session_stream(turns: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Slots, last three windows and last twelve turns of each session, from successful turns; a newer epoch starts afresh.

    ``turns`` has session_id, turn_id, epoch, ok, store, product, window, text. With ``idle_ms`` an
    idle session is forgotten; such a stream keeps running, also under a trigger that ends.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return turns.groupBy("session_id").applyInPandasWithState(partial(_update, idle_ms), _OUT, _STATE, "update", timeout)


def trace_sink(traces: DataFrame, path: str, checkpoint: str, keep: int = 2000) -> StreamingQuery:
    """The newest ``keep`` traces so far, batch by batch; ``retained`` reads them.

    Two folders take turns: a batch joins what the batch before it left in the other one, and
    overwrites its own. A batch that is run again gives the same, and the sink never grows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        if batch_id:
            old = batch.sparkSession.read.schema(fresh.schema).parquet(f"{path}/turn={(batch_id - 1) % 2}")
            fresh = fresh.unionByName(old.withColumn("batch", F.lit(batch_id).cast("long"))).dropDuplicates(["trace_id"])
        newest_traces(fresh, keep).write.mode("overwrite").parquet(f"{path}/turn={batch_id % 2}")

    return traces.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def retained(spark: SparkSession, path: str, keep: int = 2000) -> DataFrame:
    """The newest traces of the sink: those of its last batch."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("batch").alias("_last"))
    return newest_traces(every.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("_last", "turn"), keep)
