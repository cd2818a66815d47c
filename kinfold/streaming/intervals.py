"""Interval counters over a stream of events: the batch counters' sums, kept as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.statistics import interval


def interval_stream(events: DataFrame, width: int) -> DataFrame:
    """Counts by run, save interval and kind of a streaming (run_id, sim_year, kind); write it in update or complete mode.

    Intervals are whole numbers of simulated years, so the state is a row a run, interval and kind and needs no watermark.
    """
    return events.groupBy("run_id", interval(F.col("sim_year"), width).alias("interval"), "kind").agg(F.count("*").alias("n"))
