"""Sessions, turns and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int = 12) -> DataFrame:
    """The newest n turns of each session, oldest first by ``place``."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn_id"))
    kept = turns.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id")))


def carry_slots(turns: DataFrame, slots: list[str]) -> DataFrame:
    """Slots missing in a continuation come from the turn before it; a turn with ``new_topic`` starts afresh.

    Only successful turns are given, so a refusal changes nothing.
    """
    order = Window.partitionBy("session_id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, 0)
    topics = turns.withColumn("topic", F.sum(F.col("new_topic").cast("int")).over(order))
    inside = Window.partitionBy("session_id", "topic").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, 0)
    return topics.select(*(c for c in turns.columns if c not in slots), *(F.last(s, ignorenulls=True).over(inside).alias(s) for s in slots))


def recent_windows(turns: DataFrame) -> DataFrame:
    """The last three distinct windows (column ``window``) up to each turn, in the order they were last used.

    Only turns that change the window matter. The last two changes differ; the third window is the
    one before them where it differs from the last, else what it was at the change before. So three
    running values say all, and no list grows with a session.
    """
    order = Window.partitionBy("session_id").orderBy("turn_id")
    before, here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    now = turns.withColumn("_prev", F.last("window", ignorenulls=True).over(before))
    now = now.withColumn("_turned", F.col("window").isNotNull() & ~F.col("window").eqNullSafe(F.col("_prev"))).withColumn("_second", F.when(F.col("_turned"), F.col("_prev")))
    now = now.withColumn("_older", F.last("_second", ignorenulls=True).over(before)).withColumn("_third", F.when(F.col("_turned") & (F.col("_older") != F.col("window")), F.col("_older")))
    last = lambda c: F.last(c, ignorenulls=True).over(here)
    return now.select("session_id", "turn_id", F.array_compact(F.array(last("_third"), last("_second"), last("window"))).alias("windows"))


def retain_sessions(turns: DataFrame, keep: int = 500) -> DataFrame:
    """Turns of the ``keep`` sessions used last; ties by session."""
    used = turns.groupBy("session_id").agg(F.max("access_seq").alias("seq")).orderBy(F.desc("seq"), "session_id").limit(keep)
    return turns.join(used.select("session_id").hint("merge"), "session_id", "left_semi")


def step_gaps(steps: DataFrame) -> DataFrame:
    """Milliseconds from the step before in each trace."""
    w = Window.partitionBy("trace_id").orderBy("step_no")
    return steps.withColumn("gap_ms", F.col("at_ms") - F.lag("at_ms").over(w))


def newest_traces(traces: DataFrame, keep: int = 2000) -> DataFrame:
    """The newest traces, ties by id."""
    return traces.orderBy(F.desc("created_at"), F.desc("trace_id")).limit(keep)
