"""Reports: the results row, series for plots, pixel tables of the maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import genome, packed, statistics
from ..sources import dims

#: Columns of the results, in their order (fixed names of the model's output).
RESULTS = """run year numinds marriages births random_deaths cull_deaths genetic_descends genealo_descends Y_descends mt_descends
num_centromeres tot_blocks av_block_size sd_block_size av_ind_fitness av_bin_fitness num_mutations av_mutations_per_ind av_mutations_per_bin
perc_seed_genome_retained av_seed_genome_coverage av_heterozygosity""".split()
RULER = 10  # rows of the ruler above a map


def results_row(state, events: DataFrame, cfg: Config, year: int) -> DataFrame:
    """One row a run of the state at the end of a year, with the events since the last save. The state's haplotypes are text or packed words; people and haplotypes are passed over once, and who descends genetically is seen from the haplotypes."""
    numbits = dims.genome_size(cfg.multiplier)
    at = -(-year // cfg.save_interval)
    counts = statistics.interval_counts(events, cfg.save_interval).filter(F.col("interval") == at).drop("interval")
    row = state.sizes.join(counts, "run_id", "left")
    if cfg.track_DNA:
        cuts = [start for _, _, start, _ in dims.arm_rows(cfg.multiplier)] if cfg.split_blocks_by_arm else None
        words = "words" in state.haplotypes.columns
        measures = packed.measures(state.haplotypes, cuts) if words else genome.measures(state.haplotypes, numbits, cuts)
        row = row.join(statistics.whole_row(state.people, measures, numbits, words, cfg.track_mutations), "run_id", "left")
    elif cfg.track_mutations:
        row = row.join(statistics.fitness_stats(state.people, numbits), "run_id", "left")
    row = row.withColumnsRenamed({"n": "numinds", "births": "births", "marriages": "marriages"})
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in row.columns else F.lit(0.0)
    return row.select(F.col("run_id").alias("run"), F.lit(year).alias("year"), *[value(c).alias(c) for c in RESULTS[2:]])


#: Results that are printed with one decimal (fixed names of the model's output).
ONE_DECIMAL = ["av_ind_fitness", "av_bin_fitness", "av_mutations_per_ind", "av_mutations_per_bin"]


def printed(results: DataFrame) -> DataFrame:
    """Results with fitness and mutation averages as text with one decimal, halves to even."""
    return results.withColumns({c: F.format_string("%.1f", F.bround(F.col(c), 1)) for c in ONE_DECIMAL})


def series(results: DataFrame, variables: list[str]) -> DataFrame:
    """(run, year, variable, value) of chosen results, for plots."""
    return results.unpivot(["run", "year"], variables, "variable", "value")


def ruler(arms: DataFrame) -> DataFrame:
    """(x, r, g, b) of the ruler's marked columns: telomeres green, centromeres blue, separators black; later marks win."""
    c = arms.groupBy("chrom").agg(F.max(F.when(F.col("arm") == "p", F.col("start"))).alias("p"), F.max(F.when(F.col("arm") == "q", F.col("start"))).alias("q"), F.max(F.when(F.col("arm") == "q", F.col("length"))).alias("n"))
    end = F.col("q") + F.col("n")

    def mark(order: int, low, high, r: int, g: int, b: int):
        return F.transform(F.sequence(low, high - 1), lambda x: F.struct((F.col("chrom") * 10 + order).alias("order"), x.alias("x"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")))

    marks = F.concat(mark(0, F.col("p"), F.col("p") + 3, 0, 255, 0), mark(1, F.col("q") - 3, F.col("q") + 3, 0, 0, 255), mark(2, end - 4, end - 1, 0, 255, 0), mark(3, end - 1, end, 0, 0, 0))
    m = c.select(F.explode(marks).alias("m")).select("m.*")
    return m.groupBy("x").agg(*[F.max_by(k, "order").alias(k) for k in "rgb"])


def genome_rows(people: DataFrame, haplotypes: DataFrame, numbits: int) -> DataFrame:
    """(run_id, ind_id, copy, bits): what each body row of a genome map shows, 1 red and 0 black; people without seed bits are black.
    Text is never broadcast, as its size can't be seen before it is made."""
    grid = people.select("run_id", "ind_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    held = genome.dealt(haplotypes, "run_id", "ind_id", "copy").hint("merge")
    return grid.join(held, ["run_id", "ind_id", "copy"], "left").select("run_id", "ind_id", "copy", F.coalesce("bits", F.repeat(F.lit("0"), F.lit(numbits))).alias("bits"))


def mutation_pixels(mutations: DataFrame) -> DataFrame:
    """(run_id, ind_id, copy, position, r, g, b) of bins with mutations: white neutral, green better, red worse; all other pixels are black."""
    b = genome.bin_fitness(mutations)
    colour = lambda pos, zero, neg: F.when(F.col("total") > 0, pos).when(F.col("total") < 0, neg).otherwise(zero)
    return b.select("run_id", "ind_id", "copy", "position", colour(0, 255, 255).alias("r"), colour(255, 255, 0).alias("g"), colour(0, 255, 0).alias("b"))


def mutation_rows(people: DataFrame, mutations: DataFrame) -> DataFrame:
    """(run_id, ind_id, copy, spots): what each body row of a mutation map shows, as an array of (position, r, g, b), empty for people without mutations."""
    spots = mutation_pixels(mutations).groupBy("run_id", "ind_id", "copy").agg(F.array_sort(F.collect_list(F.struct("position", "r", "g", "b"))).alias("spots"))
    grid = people.select("run_id", "ind_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return grid.join(spots, ["run_id", "ind_id", "copy"], "left").withColumn("spots", F.coalesce("spots", F.array().cast(spots.schema["spots"].dataType)))
