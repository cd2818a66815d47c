"""Model parameters."""

from __future__ import annotations

import csv
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Parameters of a run; names and defaults are fixed values of the model's interface."""

    model_id: str = "Model 1"
    num_runs: int = 1
    start_pop_size: int = 100
    max_pop_size: int = 100
    max_growth_rate: float = 1.02
    end_year: int = 1000
    init_lifespan: int = 85
    min_lifespan: int = 85
    lifespan_drop: float = 0.85
    maturity: int = 20
    spacing: int = 3
    birth_prob: int = 3
    save_interval: int = 100
    menopause: float = 0.5
    bottleneck_start: int = -1
    bottleneck_end: int = -1
    bottleneck_size: int = -1
    track_DNA: bool = False
    track_mutations: bool = True
    track_dead: bool = False
    max_breeding_inds: bool = False
    random_mating: float = 1.0
    scenario: str = "Default"
    seed_year: int = 0
    multiplier: int = 1
    init_heterozygosity: float = 0.0
    genome_map: bool = False
    every_genome_map: bool = False
    mu: float = 1.0
    f_neutral: float = 0.5
    f_beneficial: float = 0.0001
    shape: float = 1.0
    scale: float = 0.05
    Weibull_adj: int = 1
    mutation_hist: bool = True
    mutation_map: bool = True
    selection: str = "Annual"
    plot: tuple[str, ...] = ("numinds",)
    # options of this library
    seed: int = 0
    fitness_model: str = "running"  # or "additive"
    annual_form: str = "shifted"  # or "own": the person's own fitness in the death threshold
    mutation_source: str = "as_mask"  # or "consistent": mutations follow the DNA's copies
    genealogy_min: str = "same"  # or "true": the smaller parent's generations
    split_blocks_by_arm: bool = False
    report_at_end: bool = False

    @classmethod
    def from_strings(cls, values: dict[str, str], **more) -> Config:
        """From text values, as in parameter files: a dropdown's first choice is taken, booleans are 0 or 1."""
        kinds = {f.name: f.type for f in fields(cls)}
        made = {}
        for name, text in values.items():
            if name not in kinds:
                raise KeyError(f"no parameter {name}")
            kind = kinds[name]
            made[name] = int(text) if kind == "int" else float(text) if kind == "float" else bool(int(text)) if kind == "bool" else tuple(text.split(",")) if name == "plot" else text.split(",")[0]
        return cls(**made | more)

    @classmethod
    def from_csv(cls, path: str) -> Config:
        """From a file with the columns parameter, label, type, value_format, default, group."""
        return cls.from_strings({r["parameter"]: r["default"] for r in parameter_rows(path)})

    def changed(self, **more) -> Config:
        return replace(self, **more)

    def selects(self, when: str) -> bool:
        """Whether selection acts at `when` (annual or birth)."""
        return self.track_mutations and self.selection.lower() == when

    def cap(self, year: int) -> int:
        """The largest population of a year."""
        return self.bottleneck_size if self.bottleneck_start <= year <= self.bottleneck_end else self.max_pop_size


def parameter_rows(path: str) -> list[dict[str, str]]:
    """The rows of a parameter or plot file; the column alt is optional."""
    with open(path, newline="") as f:
        return [{"alt": ""} | {k: v or "" for k, v in r.items() if k} for r in csv.DictReader(f)]
