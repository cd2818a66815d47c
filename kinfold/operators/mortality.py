"""Death: yearly risks, culls to the caps, and what the dead leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.rng import uniform
from ..functions.selection import lowest
from ..sources.dims import INFANT_RISK
from .people import MALE, age, fertile


def annual_fitness(cfg: Config) -> Column:
    """What fitness takes off the yearly risk: 1 without annual selection."""
    if not cfg.selects("annual"):
        return F.lit(1.0)
    return F.col("fitness") if cfg.annual_form == "own" else 1 + F.col("fitness") / 1000


def risk_modifier(cfg: Config) -> Column:
    return F.lit(cfg.min_lifespan) / F.col("lifespan")


def age_bucket(cfg: Config, year: int) -> Column:
    """The age group of the risk table, with ages scaled by lifespan."""
    return F.least((age(year) / F.col("lifespan") * cfg.min_lifespan / 5).cast("int") * 5, F.lit(85))


def thresholds(people: DataFrame, actuarial: DataFrame, cfg: Config, year: int) -> DataFrame:
    """People with age_group and the chance to die this year."""
    p = people.withColumn("age_group", age_bucket(cfg, year)).join(F.broadcast(actuarial), "age_group")
    infant = (age(year) > 0) & (age(year) < 5)
    risk = F.when(infant, F.lit(INFANT_RISK)).otherwise(F.col("risk")) * risk_modifier(cfg)
    return p.withColumn("threshold", risk + 1 - annual_fitness(cfg)).drop("risk")


def random_deaths(people: DataFrame, actuarial: DataFrame, cfg: Config, year: int, seeds: DataFrame | None = None) -> DataFrame:
    """(run_id, ind_id, cause, counted) of those who die by chance; a run's seed person dies at the end of the lifespan only, and isn't counted."""
    u = uniform("die", F.col("ind_id"), seed=cfg.seed, run=F.col("run_id"), year=year)
    p = thresholds(people, actuarial, cfg, year)
    if seeds is None:
        dies, own = u < F.col("threshold"), F.lit(False)
    else:
        p = p.join(seeds.select("run_id", F.col("ind_id").alias("_seed")), "run_id", "left")  # a row a run
        own = F.coalesce(F.col("ind_id") == F.col("_seed"), F.lit(False))
        dies = F.when(own, age(year) >= F.col("lifespan")).otherwise(u < F.col("threshold"))
    return p.filter(dies).select("run_id", "ind_id", F.lit("r").alias("cause"), (~own).alias("counted"))


def without(df: DataFrame, dead: DataFrame) -> DataFrame:
    """df less the rows of the dead."""
    return df.join(dead.select("run_id", "ind_id"), ["run_id", "ind_id"], "left_anti")


def widowed(people: DataFrame, dead: DataFrame) -> DataFrame:
    """Survivors whose spouse is among the dead are single again."""
    gone = dead.select("run_id", F.col("ind_id").alias("marriage_state"), F.lit(True).alias("_gone"))
    out = people.join(gone, ["run_id", "marriage_state"], "left")
    return out.withColumn("marriage_state", F.when(F.col("_gone"), F.lit(-1).cast("bigint")).otherwise(F.col("marriage_state"))).drop("_gone").select(*people.columns)


def buried(people: DataFrame, dead: DataFrame) -> DataFrame:
    return widowed(without(people, dead), dead)


def breeders(cfg: Config, year: int) -> Column:
    """Past maturity, and male or before menopause; married or not."""
    return (age(year) > cfg.maturity) & ((F.col("sex") == MALE) | fertile(cfg, year))


def _removable(people: DataFrame, cfg: Config, year: int, seeds: DataFrame | None) -> DataFrame:
    u = uniform("cull", F.col("ind_id"), seed=cfg.seed, run=F.col("run_id"), year=year)
    if seeds is not None:
        people = people.join(seeds.select("run_id", "ind_id"), ["run_id", "ind_id"], "left_anti")
    return people.withColumn("_u", u)


def culled(people: DataFrame, caps: DataFrame, cfg: Config, year: int, seeds: DataFrame | None = None) -> DataFrame:
    """(run_id, ind_id) of people removed at random until each run has its cap; caps has run_id and cap. The seed person is never removed."""
    excess = people.groupBy("run_id").agg(F.count("*").alias("n")).join(caps, "run_id").select("run_id", (F.col("n") - F.col("cap")).alias("limit"))
    return lowest(_removable(people, cfg, year, seeds), excess, "_u", "ind_id").select("run_id", "ind_id")


def culled_breeders(people: DataFrame, cap: int, cfg: Config, year: int, seeds: DataFrame | None = None) -> DataFrame:
    """(run_id, ind_id) removed at random, children too, until the breeders are down to the cap."""
    breeds = breeders(cfg, year).cast("int")
    excess = people.groupBy("run_id").agg((F.sum(breeds) - cap).alias("limit"))
    return lowest(_removable(people, cfg, year, seeds), excess, "_u", "ind_id", breeds).select("run_id", "ind_id")


def growth_caps(last: DataFrame, cfg: Config) -> DataFrame:
    """(run_id, cap): whole people that last year's number may grow to; last has run_id and n."""
    return last.select("run_id", F.floor(F.col("n") * cfg.max_growth_rate).alias("cap"))
