"""Filters and joins on people: singles, couples, births, children, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.ranking import ranked
from ..functions.rng import integer, uniform

MALE, FEMALE = 0, 1


def age(year: int) -> Column:
    return F.lit(year) - F.col("birth_year")


def fertile(cfg: Config, year: int) -> Column:
    return age(year) < F.col("lifespan") * cfg.menopause


def singles(people: DataFrame, cfg: Config, year: int, sex: int) -> DataFrame:
    """Unmarried people over the age of maturity; women before menopause."""
    out = people.filter((F.col("marriage_state") == -1) & (age(year) > cfg.maturity) & (F.col("sex") == sex))
    return out.filter(fertile(cfg, year)) if sex == FEMALE else out


def eligible_mothers(people: DataFrame, cfg: Config, year: int) -> DataFrame:
    """Married women before menopause whose last birth is `spacing` years ago or more."""
    return people.filter((F.col("sex") == FEMALE) & (F.col("marriage_state") > -1) & fertile(cfg, year) & (F.col("year_of_last_birth") + cfg.spacing <= year))


def conceiving(mothers: DataFrame, cfg: Config, year: int) -> DataFrame:
    """One mother in birth_prob, at random."""
    u = uniform("birth", F.col("ind_id"), seed=cfg.seed, run=F.col("run_id"), year=year)
    return mothers.filter(F.floor(u * cfg.birth_prob) == 0)


def couples(mothers: DataFrame, people: DataFrame, cfg: Config, year: int) -> DataFrame:
    """(run_id, dad, mom) of mothers with their husbands; under selection at birth, kept with a chance of the parents' mean fitness."""
    dads = people.select("run_id", F.col("ind_id").alias("dad"), F.col("fitness").alias("dad_fitness"))
    pairs = mothers.select("run_id", F.col("ind_id").alias("mom"), F.col("marriage_state").alias("dad"), "fitness").join(dads, ["run_id", "dad"])
    if cfg.selects("birth"):
        u = uniform("select", F.col("mom"), seed=cfg.seed, run=F.col("run_id"), year=year)
        pairs = pairs.filter(u < (F.col("dad_fitness") + F.col("fitness")) / 2)
    return pairs.select("run_id", "dad", "mom")


def with_ids(births: DataFrame, last: DataFrame, cfg: Config, year: int) -> DataFrame:
    """births with child_id: consecutive numbers after each run's last id, in the order of a hash of seed, run, year and mother.

    `last` has run_id and last_id: a row a run."""
    u = uniform("child", F.col("mom"), seed=cfg.seed, run=F.col("run_id"), year=year)
    return ranked(births.withColumn("_u", u), "_u", "mom").join(last, "run_id").withColumn("child_id", F.col("last_id") + F.col("rank")).drop("_u", "rank", "last_id")


def generations(parents: list[Column], how) -> Column:
    """One more than the parents' generations from the seed; -1 if neither descends from it."""
    both = how(*[F.coalesce(p, F.lit(-1)) for p in parents])
    return F.when(both >= 0, both + 1).otherwise(-1)


def children(births: DataFrame, people: DataFrame, cfg: Config, year: int) -> DataFrame:
    """Rows of the newborn: births (run_id, dad, mom, child_id) with both parents."""
    cols = [c for c in ("lifespan", "lat", "lon", "y_gens", "mt_gens", "min_genealo_gens", "max_genealo_gens") if c in people.columns]
    side = lambda who: people.select("run_id", F.col("ind_id").alias(who), *[F.col(c).alias(f"{who}_{c}") for c in cols])
    b = births.join(side("dad"), ["run_id", "dad"]).join(side("mom"), ["run_id", "mom"])
    u = uniform("sex", F.col("child_id"), seed=cfg.seed, run=F.col("run_id"), year=year)
    sex = integer(u, 0, 1)
    mean = lambda c: F.bround((F.col(f"dad_{c}") + F.col(f"mom_{c}")) / 2, 2)
    out = [
        "run_id",
        F.col("child_id").alias("ind_id"),
        sex.alias("sex"),
        F.lit(year).alias("birth_year"),
        F.greatest(((F.col("dad_lifespan") + F.col("mom_lifespan")) / 2 * cfg.lifespan_drop).cast("int"), F.lit(cfg.min_lifespan)).alias("lifespan"),
        F.lit(-1).cast("bigint").alias("marriage_state"),
        mean("lat").alias("lat"),
        mean("lon").alias("lon"),
        "dad",
        "mom",
        F.lit(1.0).alias("fitness"),
    ]
    if "y_gens" in cols:
        out.append(F.when(sex == MALE, generations([F.col("dad_y_gens")], lambda x: x)).otherwise(-1).alias("y_gens"))
    if "mt_gens" in cols:
        out.append(generations([F.col("mom_mt_gens")], lambda x: x).alias("mt_gens"))
    if "max_genealo_gens" in cols:
        most = generations([F.col("dad_max_genealo_gens"), F.col("mom_max_genealo_gens")], F.greatest)
        out.append(most.alias("max_genealo_gens"))
        if "min_genealo_gens" in cols:
            a, b_ = F.col("dad_min_genealo_gens"), F.col("mom_min_genealo_gens")
            true = F.when((a >= 0) & (b_ >= 0), F.least(a, b_) + 1).otherwise(generations([a, b_], F.greatest))
            out.append((true if cfg.genealogy_min == "true" else generations([a, b_], F.greatest)).alias("min_genealo_gens"))
    return b.select(*out)


def with_newborn(people: DataFrame, newborn: DataFrame) -> DataFrame:
    """People and the newborn; what newborn rows don't have is null."""
    return people.unionByName(newborn, allowMissingColumns=True)


#: Twice as many generations are covered with each round; no pedigree is deeper than that.
ROUNDS = 40


def pedigree_depth(people: DataFrame, saved: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(run_id, ind_id, depth): generations between a person and the first mother of the line, who has no father (dad -1).

    Each round joins everybody with the ancestor reached so far, which doubles the reach: as many joins as the depth has binary digits. Lines that leave
    the table are left out. `saved` cuts lineage between rounds.
    """
    first = F.col("dad") == -1
    at = saved(people.select("run_id", "ind_id", F.when(~first, F.col("mom")).alias("above"), F.when(first, 0).otherwise(1).alias("depth")))
    for _ in range(ROUNDS):
        up = at.select("run_id", F.col("ind_id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        done = at.filter("above IS NULL")
        if at.count() == done.count():
            return done.select("run_id", "ind_id", "depth")
        at = saved(done.unionByName(at.join(up, ["run_id", "above"]).select("run_id", "ind_id", F.col("next").alias("above"), (F.col("depth") + F.col("more")).alias("depth"))))
    raise ValueError("a line of mothers without an end")


def after_births(people: DataFrame, births: DataFrame, year: int) -> DataFrame:
    """Mothers get this year as year of their last birth and one birth more."""
    moms = births.groupBy("run_id", F.col("mom").alias("ind_id")).agg(F.count("*").cast("int").alias("_born"))
    joined = people.join(moms, ["run_id", "ind_id"], "left")
    out = joined.withColumn("year_of_last_birth", F.when(F.col("_born").isNotNull(), F.lit(year)).otherwise(F.col("year_of_last_birth")))
    number = F.when(F.col("_born").isNotNull(), F.coalesce("numbirths", F.lit(0)) + F.col("_born")).otherwise(F.col("numbirths"))
    return out.withColumn("numbirths", number).drop("_born")
