"""Bounded looks back over a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_before(events: DataFrame, flag: str, rows: int = 30, minutes: int = 5) -> DataFrame:
    """`events` with `near_seq`: the nearest of the `rows` events before that has `flag`, or null.

    The look back ends at the first event older than `minutes`. Events without a time never end it, and one
    without a time looks back over all `rows`. The frame holds only place, time and flag of each row.
    """
    frame = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-rows, -1)
    seen = events.withColumn("_frame", F.collect_list(F.struct("seq", "ts", F.col(flag).alias("hit"))).over(frame))
    cutoff = F.col("ts") - F.make_dt_interval(mins=F.lit(minutes))
    stale = F.array_max(F.transform(F.filter("_frame", lambda e: e["ts"] < cutoff), lambda e: e["seq"]))
    hit = F.array_max(F.transform(F.filter("_frame", lambda e: e["hit"] & (e["seq"] > F.coalesce(stale, F.lit(-1)))), lambda e: e["seq"]))
    return seen.withColumn("near_seq", hit).drop("_frame")
