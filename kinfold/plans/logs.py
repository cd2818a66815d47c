"""Logs by run and year that may be written again: a year that is repeated replaces what was there, and half-written ones are never read.

Every write gets a number of its own, which its rows carry. Rows go into partitions of run and year, each replaced as a whole; when they are there, the
manifest, itself a table by run and year, says which write counts for each. Readers take the rows that the manifest names: a writer that died before leaves nothing to be seen, and
a year that has no rows any more is empty, though old files may lie there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["run_id", "year"]


def _replaced(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def write_log(df: DataFrame, years: DataFrame, path: str) -> None:
    """Writes the rows of df (run_id, year and others) into the log at path. years: the runs and years (run_id, year) that this write is about, also those without rows; rows of other years are left out."""
    write = uuid.uuid4().hex
    about = years.select(*KEYS).distinct()
    rows = df.join(about, KEYS, "left_semi").withColumn("_write", F.lit(write))
    _replaced(rows.repartition(*KEYS, F.pmod(F.xxhash64(*[c for c in df.columns if c not in KEYS]), F.lit(16))), f"{path}/rows")
    _replaced(about.withColumn("_write", F.lit(write)).repartition(1), f"{path}/manifest")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the log that count."""
    keys = {"run_id": "int", "year": "int"}
    read = lambda name: spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}").withColumns({k: F.col(k).cast(t) for k, t in keys.items()})
    return read("rows").join(read("manifest").select(*KEYS, "_write"), [*KEYS, "_write"]).drop("_write")
