"""Founding populations and the seed genome."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.choice import drawn
from ..functions.rng import below, counter, integer, uniform
from ..operators.genome import dealt
from . import dims

SCHEMA = """run_id int, ind_id bigint, dad bigint, mom bigint, sex int, birth_year int, lifespan int, marriage_state bigint, year_of_last_birth int,
 numbirths int, lat double, lon double, fitness double, mutations int, allele_count int, num_blocks int, centromeres string,
 y_gens int, mt_gens int, min_genealo_gens int, max_genealo_gens int"""


def shaped(df: DataFrame) -> DataFrame:
    """df with exactly the columns of a population, missing ones null."""
    out = []
    for part in SCHEMA.split(","):
        name, kind = part.split()
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def coordinates(key: Column, seed: int = 0, run: Column | int = 0) -> tuple[Column, Column]:
    """A place around the centre: a uniform angle and a uniform radius up to 0.5, to two decimals."""
    theta = uniform("theta", key, seed=seed, run=run) * (2 * math.pi)
    r = uniform("r", key, seed=seed, run=run) * 0.5
    return F.bround(r * F.cos(theta), 2), F.bround(r * F.sin(theta), 2)


def _pairs(spark: SparkSession, cfg: Config, n: int, lifespan: int) -> DataFrame:
    i = F.col("id")
    runs = spark.range(cfg.num_runs).select(F.col("id").cast("int").alias("run_id"))
    people = spark.range(n).select(i.alias("ind_id"), (i % 2).cast("int").alias("sex"), F.lit(-100).alias("birth_year"), F.lit(lifespan).alias("lifespan"), (i + 1 - 2 * (i % 2)).alias("marriage_state"), F.when(i % 2 == 1, -cfg.spacing).alias("year_of_last_birth"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(1.0).alias("fitness"), F.lit(0).alias("mutations"))
    return shaped(runs.crossJoin(people))


def eden(spark: SparkSession, cfg: Config) -> DataFrame:
    """A couple with long lives."""
    return _pairs(spark, cfg, 2, 900)


def flood(spark: SparkSession, cfg: Config) -> DataFrame:
    """Three couples."""
    return _pairs(spark, cfg, 6, 650)


def default(spark: SparkSession, cfg: Config) -> DataFrame:
    """start_pop_size single people, of ages by the pyramid, at random places."""
    ids = spark.range(cfg.start_pop_size).select(F.col("id").alias("ind_id")).crossJoin(spark.range(cfg.num_runs).select(F.col("id").cast("int").alias("run_id")))
    run, key = F.col("run_id"), F.col("ind_id")
    p = drawn(ids.withColumn("u", uniform("age", key, seed=cfg.seed, run=run)), "u", dims.age_ranges(cfg.start_pop_size), "age")
    lat, lon = coordinates(key, cfg.seed, run)
    made = p.select("run_id", "ind_id", integer(uniform("sex0", key, seed=cfg.seed, run=run), 0, 1).alias("sex"), (-F.col("age")).alias("birth_year"), F.lit(cfg.init_lifespan).alias("lifespan"), F.lit(-1).alias("marriage_state"), F.lit(-cfg.spacing).alias("year_of_last_birth"), lat.alias("lat"), lon.alias("lon"), F.lit(1.0).alias("fitness"), F.lit(0).alias("mutations"))
    return shaped(made)


SCENARIOS = {"Eden": eden, "Flood": flood, "Default": default}


def founders(spark: SparkSession, cfg: Config) -> DataFrame:
    """The scenario's population; an unknown name is the default one."""
    return SCENARIOS.get(cfg.scenario, default)(spark, cfg)


def heterozygous(people: DataFrame, cfg: Config, numbits: int) -> DataFrame:
    """Haplotypes with each bit of copy 0 set by chance, copy 1 empty. A draw a bit is much work for a short row, so people are dealt over all tasks first."""
    limit, places = cfg.init_heterozygosity, [str(p).encode() for p in range(numbits)]

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            bits = ["".join("1" if one else "0" for one in below(limit, start.encode(), places)) for start in batch["start"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["run_id"], batch["ind_id"], pa.array(bits, pa.string())], ["run_id", "ind_id", "bits"])

    start = F.concat(counter("het", F.col("ind_id"), seed=cfg.seed, run=F.col("run_id")), F.lit("|"))
    made = dealt(people.select("run_id", "ind_id", start.alias("start")), "ind_id").mapInArrow(draw, f"run_id {people.schema['run_id'].dataType.simpleString()}, ind_id {people.schema['ind_id'].dataType.simpleString()}, bits string")
    copies = made.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return copies.select("run_id", "ind_id", "copy", F.when(F.col("copy") == 0, F.col("bits")).otherwise(F.repeat(F.lit("0"), F.lit(numbits))).alias("bits"))


def seed_person(people: DataFrame, cfg: Config, year: int) -> DataFrame:
    """(run_id, ind_id): one living person of each run, at random."""
    u = uniform("seed", F.col("ind_id"), seed=cfg.seed, run=F.col("run_id"), year=year)
    return people.groupBy("run_id").agg(F.min_by("ind_id", F.struct(u, F.col("ind_id"))).alias("ind_id"))


def inoculated(people: DataFrame, seeds: DataFrame, numbits: int) -> DataFrame:
    """People with the seed's genome marked: all centromeres, generation 0 (of the Y only for a man)."""
    p = people.join(seeds.withColumn("_seed", F.lit(True)), ["run_id", "ind_id"], "left")
    mark = lambda c, v, when=None: F.when(F.col("_seed") & (when if when is not None else F.lit(True)), v).otherwise(F.col(c)).alias(c)
    new = {"centromeres": mark("centromeres", F.repeat(F.lit("1"), F.lit(48))), "y_gens": mark("y_gens", F.lit(0), F.col("sex") == 0), "mt_gens": mark("mt_gens", F.lit(0)), "min_genealo_gens": mark("min_genealo_gens", F.lit(0)), "max_genealo_gens": mark("max_genealo_gens", F.lit(0)), "allele_count": mark("allele_count", F.lit(2 * numbits)), "num_blocks": mark("num_blocks", F.lit(2))}
    return p.select(*[new.get(c, F.col(c)) for c in people.columns])


def seed_haplotypes(seeds: DataFrame, numbits: int) -> DataFrame:
    return seeds.select("run_id", "ind_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).withColumn("bits", F.repeat(F.lit("1"), F.lit(numbits)))
