"""Weighted choice and Poisson numbers by a guide table: the range of sums is cut into equal cells, and a draw meets the few values of its cell by an equality join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_sum
from .rng import poisson_table, uniform


def guide(weights: DataFrame, key: str, weight: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The guide table, (by, cell, key, low, high): a value has the tickets from low to just below high, and a row for each cell of the tickets that it reaches into; and the
    totals, (by, total, width). weights: a value (key) and a whole number of 0 or more; values without weight are never chosen.

    There are about as many cells as values, so the table has at most twice as many rows as there are values, however uneven the weights, and
    a draw meets two values on average. Values follow each other in the order of a hash of the key; nothing is numbered in one task.
    """
    some = weights.filter(F.col(weight) > 0).select(*by, key, F.col(weight).cast("long").alias("_w")).withColumn("_u", uniform("guide", F.col(key)))
    total = some.groupBy(*by).agg(F.sum("_w").alias("total"), F.count("*").alias("_n"))
    total = total.select(*by, "total", F.ceil(F.col("total") / F.col("_n")).cast("long").alias("width"))
    summed = running_sum(some, "_w", "_u", key, by=by, name="high").withColumn("low", F.col("high") - F.col("_w")).join(total, by)
    cells = F.explode(F.sequence(F.expr("low div width"), F.expr("(high - 1) div width")))
    return summed.select(*by, key, "low", "high", cells.alias("cell")), total


def chosen(draws: DataFrame, table: DataFrame, totals: DataFrame, u: str, by: list[str]) -> DataFrame:
    """draws with the value that each draws: its number u in [0, 1) becomes a ticket, and the ticket's cell names the values to look at. Draws where nothing has weight are left out."""
    d = draws.join(totals, by).withColumn("_t", F.least(F.floor(F.col(u) * F.col("total")), F.col("total") - 1)).withColumn("cell", F.expr("_t div width"))
    return d.join(table, [*by, "cell"]).filter("low <= _t AND _t < high").drop("cell", "low", "high", "_t", "total", "width")


#: Rows of a guide table that are broadcast at most; a longer one is joined by shuffling.
BROADCAST_ROWS = 500_000


def guided(ranges: list[tuple[int, float, float]]) -> list[tuple[int, int, float, float]]:
    """(cell, value, low, high) of values with ranges [low, high) that follow each other from 0 to 1: a row for each of the cells, as many as there are values, that a range reaches into."""
    cells = len(ranges)
    return [(c, value, low, high) for value, low, high in ranges if low < high and low < 1 for c in range(int(low * cells), min(cells - 1, int(high * cells)) + 1)]


def drawn(df: DataFrame, u: str, ranges: list[tuple[int, float, float]], name: str) -> DataFrame:
    """df with `name`: the value in whose range u (in [0, 1)) lies. A row of df meets the few values of its cell by equality, and the plan holds no table of numbers."""
    rows = guided(ranges)
    table = df.sparkSession.createDataFrame(rows, f"_cell int, {name} int, _low double, _high double")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    d = df.withColumn("_cell", F.least(F.floor(F.col(u) * len(ranges)), F.lit(len(ranges) - 1)).cast("int"))
    return d.join(table, "_cell").filter((F.col("_low") <= F.col(u)) & (F.col(u) < F.col("_high"))).drop("_cell", "_low", "_high")


def poisson_ranges(mean: float) -> list[tuple[int, float, float]]:
    """Each number's range: it is drawn by numbers at or above just as many of the cumulative chances. What is left above the last chance is the last number's."""
    sums = [*poisson_table(mean), 2.0]
    return [(k, low, high) for k, (low, high) in enumerate(zip([0.0, *sums], sums, strict=False)) if low < high]


def poisson_drawn(df: DataFrame, u: str, mean: float, name: str) -> DataFrame:
    """df with `name`: how many of the cumulative Poisson chances are at or below u (in [0, 1))."""
    return drawn(df, u, poisson_ranges(mean), name)
