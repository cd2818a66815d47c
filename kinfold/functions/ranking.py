"""Ranks by a random number without a single-task window.

Rows are numbered within ranges of the number, and ranges start where the sizes of those before end. The sizes are a table of at most
BUCKETS rows a run; rows lie by run and range already when they meet it, so it alone is shuffled, or broadcast where Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def ranked(df: DataFrame, u: str, tie: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with `name`: 1, 2, ... within `by` in the order of column u (in [0, 1)), ties by `tie`."""
    by = by or ["run_id"]
    cut = df.withColumn("_b", F.least(F.floor(F.col(u) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sizes = cut.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_from"))
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(u, tie))
    return cut.withColumn("_r", own).join(starts, [*by, "_b"]).withColumn(name, (F.col("_from") + F.col("_r")).cast("bigint")).drop("_b", "_r", "_from")


def running_sum(df: DataFrame, value: str, u: str, tie: str, by: list[str] | None = None, name: str = "total") -> DataFrame:
    """df with `name`: the sum of `value` over this row and those before it in the order of u, ties by `tie`."""
    by = by or ["run_id"]
    cut = df.withColumn("_b", F.least(F.floor(F.col(u) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sizes = cut.groupBy(*by, "_b").agg(F.sum(value).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_from"))
    own = F.sum(value).over(Window.partitionBy(*by, "_b").orderBy(u, tie).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_r", own).join(starts, [*by, "_b"]).withColumn(name, F.col("_from") + F.col("_r")).drop("_b", "_r", "_from")
