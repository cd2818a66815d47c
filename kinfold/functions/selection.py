"""The rows that come first in the order of a random number, up to a sum: found by refining histograms, without ranking all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that a range is cut into each time, and the most rows of a run that are ordered at last.
CELLS, FEW = 4096, 100_000
#: Random numbers have 52 bits: no cell is narrower.
FINEST = 2.0**-52


def lowest(df: DataFrame, limits: DataFrame, u: str, tie: str, weight: Column | None = None, few: int = FEW) -> DataFrame:
    """The rows of each run before its limit is reached: in the order of u (in [0, 1)), ties by `tie`, those whose weights before them sum up to less than the limit.

    limits: run_id and limit; runs without one, or with none above 0, lose nothing and are left out. weight: whole numbers of 0 or more, 1 for each row unless given. A histogram of a run's numbers shows the
    cell in which the limit is reached; while that holds more than `few` rows, it is cut again (five times at most, as numbers have 52 bits). Rows below it are taken by a filter, and only its own are ordered.
    """
    rows = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    limits = limits.filter("limit > 0").select("run_id", F.col("limit").cast("long").alias("_left"))
    schema = "run_id int, _low double, _width double, _left long, _rows long"
    cut, done = limits.select("run_id", F.lit(0.0).alias("_low"), F.lit(1.0).alias("_width"), "_left"), []
    while True:
        inside = rows.join(cut, "run_id").filter((F.col(u) >= F.col("_low")) & (F.col(u) < F.col("_low") + F.col("_width")))
        width = F.greatest(F.col("_width") / CELLS, F.lit(FINEST))
        cell = F.floor((F.col(u) - F.col("_low")) / width)
        cells = inside.groupBy("run_id", "_low", "_width", "_left", cell.alias("_cell")).agg(F.sum("_w").alias("_sum"), F.count("*").alias("_rows"))
        upto = F.sum("_sum").over(Window.partitionBy("run_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        # the first cell in which the sum reaches the limit
        reached = cells.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_sum") < F.col("_left")))
        found = reached.select("run_id", (F.col("_low") + F.col("_cell") * width).alias("_low"), width.alias("_width"), (F.col("_left") - (F.col("_upto") - F.col("_sum"))).alias("_left"), "_rows")
        cuts = [tuple(r) for r in found.collect()]  # a row a run
        wide = [r for r in cuts if r[4] > few and r[2] > FINEST]
        done += [r for r in cuts if r not in wide]
        if not wide:
            break
        cut = df.sparkSession.createDataFrame(wide, schema).drop("_rows")
    cut = df.sparkSession.createDataFrame(done, schema)
    at = rows.join(limits.select("run_id"), "run_id").join(cut, "run_id", "left")
    below = at.filter(F.col("_low").isNull() | (F.col(u) < F.col("_low")))  # a run whose sum is below its limit is taken whole
    edge = at.filter((F.col(u) >= F.col("_low")) & (F.col(u) < F.col("_low") + F.col("_width")))
    total = F.sum("_w").over(Window.partitionBy("run_id").orderBy(u, tie).rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("_total", total).filter(F.col("_total") - F.col("_w") < F.col("_left"))
    return below.select(*df.columns).unionByName(edge.select(*df.columns))
