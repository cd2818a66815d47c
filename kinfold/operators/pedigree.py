"""Generations between people and the seed over a whole pedigree of two parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .people import MALE


def genealogy(people: DataFrame, seeds: DataFrame, saved: Callable[[DataFrame], DataFrame], missing: int = -1) -> DataFrame:
    """(run_id, ind_id, y_gens, mt_gens, min_genealo_gens, max_genealo_gens) of all people; `missing` where somebody doesn't descend from the run's seed that way.

    y: along fathers and sons only (the seed a man); mt: along mothers; min and max: the shortest and the longest line through either parent. seeds: run_id, ind_id.

    The frontier of round r is the active set: everybody to whom some line of just r generations leads. The next one is its distinct children, so a round moves
    a row a child of the frontier and not the pedigree; the first round that finds somebody gives the shortest line and the last the longest. `saved` cuts lineage
    between rounds. People with a parent missing from the table descend through the other one; a pedigree with a cycle below the seed is refused.
    """
    who = people.select("run_id", "ind_id", "sex", "dad", "mom")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("father"), F.col("dad").alias("parent")), F.struct(F.lit(False).alias("father"), F.col("mom").alias("parent"))))
    links = saved(who.select("run_id", F.col("ind_id").alias("child"), "sex", sides.alias("p")).select("run_id", "child", "sex", "p.*").filter("parent >= 0"))
    at = seeds.select("run_id", "ind_id").join(who, ["run_id", "ind_id"]).select("run_id", "ind_id", (F.col("sex") == MALE).alias("y"), F.lit(True).alias("mt"))
    most, found, rounds = None, [], 0
    while True:
        at = saved(at.withColumn("round", F.lit(rounds)))
        if at.isEmpty():
            break
        found.append(at)
        rounds += 1
        if rounds % 64 == 0:  # a line without a cycle has fewer generations than there are people
            most = most or people.count()
            if rounds > most:
                raise ValueError("a pedigree with a cycle")
        next_ = at.withColumnRenamed("ind_id", "parent").join(links, ["run_id", "parent"])
        son = F.col("father") & (F.col("sex") == MALE) & F.col("y")
        at = next_.groupBy("run_id", F.col("child").alias("ind_id")).agg(F.bool_or(son).alias("y"), F.bool_or(~F.col("father") & F.col("mt")).alias("mt"))
    lines = found[0] if found else at
    for f in found[1:]:
        lines = lines.unionByName(f)
    made = lines.groupBy("run_id", "ind_id").agg(
        F.max(F.when(F.col("y"), F.col("round"))).alias("y_gens"),
        F.max(F.when(F.col("mt"), F.col("round"))).alias("mt_gens"),
        F.min("round").alias("min_genealo_gens"),
        F.max("round").alias("max_genealo_gens"),
    )
    out = who.select("run_id", "ind_id").join(made, ["run_id", "ind_id"], "left")
    return out.select("run_id", "ind_id", *[F.coalesce(c, F.lit(missing)).cast("int").alias(c) for c in made.columns[2:]])
