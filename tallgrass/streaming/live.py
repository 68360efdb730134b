"""Live analytics over the retrieval log, pairing of tool events, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Above the known lateness of the log: at sf0.1 rows arrive up to 12.3 days after their time.
LATE = "14 days"


def windowed_calls(log: DataFrame, window: str = "1 day", late: str = LATE) -> DataFrame:
    """Calls and empty searches per window; rows later than ``late`` are dropped by the watermark."""
    counted = log.withWatermark("ts", late).groupBy(F.window("ts", window))
    empty = F.sum((F.col("hits").isNull() | (F.size("hits") == 0)).cast("int"))
    return counted.agg(F.count(F.lit(1)).alias("calls"), empty.alias("empty")).select(F.col("window.start").alias("window_start"), "calls", "empty")


def windowed_hits(log: DataFrame, window: str = "1 day", late: str = LATE) -> DataFrame:
    hits = log.withWatermark("ts", late).select("ts", F.explode("hits.id").alias("id")).where("id <> ''")
    return hits.groupBy(F.window("ts", window), "id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "id", "n")


def deduplicated(log: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event once, also when it is delivered twice within the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def paired_calls(events: DataFrame, keep: str = "1 hour") -> DataFrame:
    """Stream-stream join of before and after events by call id.

    The state is bounded by time: a command without an answer is forgotten after
    ``keep``. (The original forgets everything once 200 commands are open.)
    """
    bash = events.where("tool = 'bash'")
    before = bash.where("phase = 'before'").select(F.col("call_id").alias("b_call"), "command", F.col("ts").alias("before_ts")).withWatermark("before_ts", keep)
    after = bash.where("phase = 'after'").select(F.col("call_id").alias("a_call"), "output", F.col("ts").alias("after_ts")).withWatermark("after_ts", keep)
    joined = before.join(after, F.expr(f"b_call = a_call and after_ts >= before_ts and after_ts <= before_ts + interval {keep}"))
    return joined.select(F.col("b_call").alias("call_id"), "command", "output", "before_ts", "after_ts")


def ingest_changes(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """Run ``apply`` on each micro-batch of a change stream until the input is used up."""
    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: apply(df)).start()
