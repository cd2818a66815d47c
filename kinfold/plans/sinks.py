"""Sinks: results, deaths, survivors and histogram as CSV or Parquet; maps as PNG."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.genome import ones
from . import png
from .report import RULER, genome_rows, mutation_rows, ruler

#: Columns of the deaths log and where each comes from (fixed names of the model's output).
DEATHS = {
    "ID": "ind_id", "birthyear": "birth_year", "deathyear": "year", "sex": "sex", "father": "dad", "mother": "mom", "lifespan": "lifespan", "lat": "lat", "lon": "lon",
    "married": "marriage_state", "numbirths": "numbirths", "Ygens": "y_gens", "MTgens": "mt_gens", "MinGenealGens": "min_genealo_gens", "MaxGenealGens": "max_genealo_gens",
    "SeedAlleles": "allele_count", "CentromereCount": "centromeres", "blocks": "num_blocks", "fitness": "fitness", "NumMuts": "mutations", "CauseOfDeath": "cause",
}


def death_rows(dead: DataFrame) -> DataFrame:
    """The 21 columns of the deaths log; what is missing is -1; centromeres are counted."""
    out = []
    for name, source in DEATHS.items():
        c = F.col(source) if source in dead.columns else F.lit(None)
        if name == "CentromereCount" and source in dead.columns:
            c = ones(c)
        out.append((F.coalesce(c, F.lit("-1")) if name == "CauseOfDeath" else F.coalesce(c, F.lit(-1))).alias(name))
    keys = [c for c in ("run_id",) if c in dead.columns]
    return dead.select(*keys, *out)


def survivor_rows(people: DataFrame, year: int) -> DataFrame:
    """The living as rows of the deaths log, in the order of their ids."""
    return death_rows(people.withColumn("year", F.lit(year)).withColumn("cause", F.lit("-1"))).orderBy("run_id", "ID")


def log_rows(dead: DataFrame, people: DataFrame, year: int) -> DataFrame:
    """The deaths log as it is at the end of a run: all deaths, and the survivors with the last year in place of a year of death."""
    return death_rows(dead).unionByName(survivor_rows(people, year))


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """One folder of CSV parts with a header, partitioned by run where there is one."""
    w = df.write.mode("append" if append else "overwrite").option("header", True)
    keys = [c for c in ("run_id", "run") if c in df.columns]
    (w.partitionBy(*keys) if keys else w).csv(path)


def ruler_rows(arms: DataFrame, numbits: int) -> list[bytes]:
    line = bytearray(b"\xff" * (3 * numbits))
    for m in ruler(arms).collect():  # at most a dozen columns a chromosome
        line[3 * m["x"] : 3 * m["x"] + 3] = bytes((m["r"], m["g"], m["b"]))
    return [bytes(line)] * RULER


def genome_map(people: DataFrame, haplotypes: DataFrame, arms: DataFrame, numbits: int, path: str) -> None:
    """A PNG of one run at path: the ruler, then two rows a person, 1 red and 0 black."""

    def line(bits: str) -> bytes:
        out = np.zeros((len(bits), 3), np.uint8)
        out[np.frombuffer(bits.encode(), np.uint8) == ord("1"), 0] = 255
        return out.tobytes()

    png.write(genome_rows(people, haplotypes, numbits).select("ind_id", "copy", "bits"), ["ind_id", "copy"], "bits", line, numbits, ruler_rows(arms, numbits), path)


def mutation_map(people: DataFrame, mutations: DataFrame, arms: DataFrame, numbits: int, path: str) -> None:
    """The same for bins: black without mutations, white neutral, green better, red worse."""

    def line(spots: list[dict]) -> bytes:
        out = bytearray(3 * numbits)
        for p in spots:
            out[3 * p["position"] : 3 * p["position"] + 3] = bytes((p["r"], p["g"], p["b"]))
        return bytes(out)

    png.write(mutation_rows(people, mutations).select("ind_id", "copy", "spots"), ["ind_id", "copy"], "spots", line, numbits, ruler_rows(arms, numbits), path)
