"""Aggregates of a population: descendants, blocks, heterozygosity, fitness, histograms, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .genome import blocks, copies, islands, ones, words
from .mortality import breeders


def breeding(people: DataFrame, cfg: Config, year: int) -> DataFrame:
    return people.groupBy("run_id").agg(F.count_if(breeders(cfg, year)).alias("breeders"))


def descendants(people: DataFrame) -> DataFrame:
    """Descendants of the seed by kind of inheritance, people with blocks, and seed centromeres, per run."""
    some = lambda c: F.count_if(F.col(c) > 0)
    return people.groupBy("run_id").agg(
        F.count("*").alias("numinds"),
        some("y_gens").alias("Y_descends"),
        some("mt_gens").alias("mt_descends"),
        some("max_genealo_gens").alias("genealo_descends"),
        some("allele_count").alias("genetic_descends"),
        some("num_blocks").alias("inds_with_blocks"),
        F.coalesce(F.sum(ones(F.col("centromeres"))), F.lit(0)).alias("num_centromeres"),
    )


def block_stats(haplotypes: DataFrame, arms: DataFrame | None = None) -> DataFrame:
    """Number, mean (one decimal) and deviation of block lengths per run; the deviation is about the rounded mean, its square rounded to two decimals first."""
    return length_stats(haplotypes, blocks(haplotypes, arms))


def length_stats(haplotypes: DataFrame, lengths: DataFrame) -> DataFrame:
    """`block_stats` of given blocks (run_id, length); runs without blocks have zeros."""
    b = lengths.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("length").alias("s"), F.sum(F.col("length").cast("bigint") * F.col("length")).alias("q"))
    made = b.select("run_id", *length_columns(F.col("n"), F.col("s"), F.col("q")))
    runs = haplotypes.select("run_id").distinct()
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    return runs.join(made, "run_id", "left").select("run_id", zero("tot_blocks", "bigint"), zero("av_block_size", "double"), zero("sd_block_size", "double"))


def length_columns(n: Column, s: Column, q: Column) -> list[Column]:
    """Number, mean and deviation of n lengths, from their sum and that of their squares."""
    some = F.when(n > 0, n)
    m = F.bround(s / some, 1)
    variance = F.bround((q - 2 * m * s) / some + m * m, 2)
    return [n.alias("tot_blocks"), m.alias("av_block_size"), F.bround(F.sqrt(F.greatest(variance, F.lit(0.0))), 1).alias("sd_block_size")]


def position_counts(haplotypes: DataFrame) -> DataFrame:
    """(run_id, position, n): set bits at each position over all copies, where there are any.

    Runs of 1 count up where they start and down where they end; the running sum of these changes, at most a row a position and run, holds up to the next.
    """
    ends = islands(haplotypes).select("run_id", F.explode(F.array(F.struct(F.col("start").alias("position"), F.lit(1).alias("step")), F.struct((F.col("start") + F.col("length")).alias("position"), F.lit(-1).alias("step")))).alias("e"))
    steps = ends.select("run_id", "e.*").groupBy("run_id", "position").agg(F.sum("step").alias("step"))
    order = Window.partitionBy("run_id").orderBy("position")
    level = steps.withColumn("n", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("past", F.lead("position").over(order)).filter("n > 0")
    return level.select("run_id", F.explode(F.expr("sequence(position, past - 1)")).alias("position"), "n")


def coverage(haplotypes: DataFrame, numbits: int) -> DataFrame:
    """Share of the seed's genome that is retained, and mean coverage of what is, per run."""
    c = position_counts(haplotypes).groupBy("run_id").agg(F.count("*").alias("kept"), F.sum("n").alias("s"))
    made = c.select("run_id", F.col("kept").alias("retained"), (F.col("kept") / numbits * 100).alias("perc_seed_genome"), (F.col("s") / (F.col("kept") * numbits)).alias("av_coverage"))
    runs = haplotypes.select("run_id").distinct()
    return runs.join(made, "run_id", "left").select("run_id", F.coalesce("retained", F.lit(0)).alias("retained"), F.coalesce("perc_seed_genome", F.lit(0.0)).alias("perc_seed_genome"), F.coalesce("av_coverage", F.lit(0.0)).alias("av_coverage"))


def heterozygosity(haplotypes: DataFrame, sizes: DataFrame, numbits: int) -> DataFrame:
    """Percentage of positions that differ between a person's copies, over the whole population (sizes: run_id, n). Copies meet as words, an eighth of their text."""
    packed = haplotypes.select("run_id", "ind_id", "copy", words(F.col("bits"), numbits).alias("words"))
    bits = F.zip_with("c0", "c1", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    h = copies(packed, "words").groupBy("run_id").agg(F.sum(differ).alias("het"))
    return sizes.join(h, "run_id", "left").select("run_id", F.coalesce("het", F.lit(0)).alias("het"), (F.coalesce("het", F.lit(0)) / (numbits * F.col("n")) * 100).alias("av_heterozygosity"))


def fitness_stats(people: DataFrame, numbits: int) -> DataFrame:
    p = people.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("fitness").alias("f"), F.coalesce(F.sum("mutations"), F.lit(0)).alias("num_mutations"))
    return p.select("run_id", *fitness_columns(F.col("n"), F.col("f"), F.col("num_mutations"), numbits))


def fitness_columns(n: Column, f: Column, mutations: Column, numbits: int) -> list[Column]:
    """Averages of the fitness and mutations of n people, from their sums."""
    bins = n * numbits * 2
    return [(f / n).alias("av_ind_fitness"), (f / bins).alias("av_bin_fitness"), mutations.alias("num_mutations"), (mutations / n).alias("av_mutations_per_ind"), (mutations / bins).alias("av_mutations_per_bin")]


def whole_row(people: DataFrame, measures: DataFrame, numbits: int, lone: bool, mutations: bool) -> DataFrame:
    """All that a results row holds of people and their haplotypes, per run: `descendants`, `length_stats`, `coverage`, `heterozygosity` and, with mutations, `fitness_stats`, each of which would pass over them by itself.

    measures: of `genome.measured`. lone: a copy that isn't there counts as zeros where copies differ, else its person isn't counted there.
    People and haplotypes are rows of one table that is grouped by person, where the copies meet; then a row is a word of a person, and its first word carries the person's numbers.
    """
    sums = ["fitness", "mutations"] if mutations else []
    marks = {"Y_descends": F.col("y_gens") > 0, "mt_descends": F.col("mt_gens") > 0, "genealo_descends": F.col("max_genealo_gens") > 0, "num_centromeres": ones(F.col("centromeres"))}
    who = people.select("run_id", "ind_id", F.lit(1).cast("bigint").alias("n"), *[c.cast("bigint").alias(name) for name, c in marks.items()], *sums)
    held = ["ones", "blocks", "squares"]
    one = lambda k: F.max(F.when(F.col("copy") == k, F.col("words"))).alias(f"c{k}")
    added = ["n", *marks, *sums, *held]
    person = who.unionByName(measures, allowMissingColumns=True).groupBy("run_id", "ind_id").agg(*[F.sum(c).alias(c) for c in added], one(0), one(1))
    none = F.lit(0).cast("bigint")
    each = lambda f: F.zip_with(F.coalesce("c0", F.array().cast("array<bigint>")), F.coalesce("c1", F.array().cast("array<bigint>")), lambda a, b: f(F.coalesce(a, none), F.coalesce(b, none)))
    differ = F.aggregate(each(lambda a, b: a.bitwiseXOR(b)), none, lambda total, x: total + F.bit_count(x))
    person = person.withColumn("het", differ if lone else F.when(F.col("c0").isNotNull() & F.col("c1").isNotNull(), differ)).withColumn("genetic_descends", F.when(F.col("ones") > 0, F.col("n")))
    added += ["het", "genetic_descends"]
    word = person.select("run_id", *added, F.posexplode_outer(each(lambda a, b: a.bitwiseOR(b))).alias("word", "any"))
    first = F.coalesce("word", F.lit(0)) == 0
    words = word.groupBy("run_id", F.coalesce("word", F.lit(0)).alias("word")).agg(F.bit_or("any").alias("any"), *[F.sum(F.when(first, F.col(c))).alias(c) for c in added])
    r = words.groupBy("run_id").agg(F.sum(F.bit_count("any")).alias("kept"), *[F.sum(c).alias(c) for c in added])
    n, kept = F.when(F.col("n") > 0, F.col("n")), F.when(F.col("kept") > 0, F.col("kept"))
    shares = [(F.col("kept") / numbits * 100).alias("perc_seed_genome_retained"), (F.col("ones") / (kept * numbits)).alias("av_seed_genome_coverage"), (F.col("het") / (numbits * n) * 100).alias("av_heterozygosity")]
    fit = fitness_columns(n, F.col("fitness"), F.coalesce("mutations", none), numbits) if mutations else []
    return r.select("run_id", *marks, "genetic_descends", *length_columns(F.col("blocks"), F.col("ones"), F.col("squares")), *shares, *fit)


#: Bins of the mutation histogram, in thousandths.
LOW, HIGH = -1000, 1000


def histogram(ever: DataFrame, now: DataFrame) -> DataFrame:
    """(run_id, bin, all_mutations, circulating_mutations), every bin; effects beyond the ends are counted in the end bins."""
    count = lambda df, name: df.groupBy("run_id", clamped()).agg(F.count("*").alias(name))
    runs = ever.select("run_id").unionByName(now.select("run_id")).distinct()
    bins = runs.withColumn("bin", F.explode(F.sequence(F.lit(LOW), F.lit(HIGH))))
    made = bins.join(count(ever, "a"), ["run_id", "bin"], "left").join(count(now, "c"), ["run_id", "bin"], "left")
    return made.select("run_id", "bin", F.coalesce("a", F.lit(0)).alias("all_mutations"), F.coalesce("c", F.lit(0)).alias("circulating_mutations"))


def clamped() -> Column:
    return F.greatest(F.least("effect", F.lit(HIGH)), F.lit(LOW)).alias("bin")


def histogram_change(new: DataFrame, gone: DataFrame, interval: int, number: str | None = None) -> DataFrame:
    """(run_id, interval, bin, born, died): what a save interval adds to the histograms, from its own new mutations and those of its dead (run_id, effect each); bins without a change have no rows.
    number: a column that says how many mutations a row stands for."""
    one = lambda df, name: df.groupBy("run_id", clamped()).agg((F.sum(number) if number else F.count("*")).alias(name))
    both = one(new, "born").join(one(gone, "died"), ["run_id", "bin"], "full")
    return both.select("run_id", F.lit(interval).alias("interval"), "bin", F.coalesce("born", F.lit(0)).alias("born"), F.coalesce("died", F.lit(0)).alias("died"))


def histograms(changes: DataFrame) -> DataFrame:
    """(run_id, interval, bin, all_mutations, circulating_mutations) of each stored interval, from the changes up to it; only bins that have had a mutation.

    Changes merge by adding up, whatever their number and order: those of one interval may come in parts. A window holds the changes of one bin.
    """
    c = changes.groupBy("run_id", "interval", "bin").agg(F.sum("born").alias("born"), F.sum("died").alias("died"))
    at = changes.select("run_id", "interval").distinct()
    seen = c.groupBy("run_id", "bin").agg(F.min("interval").alias("first"))
    grid = at.join(seen, "run_id").filter("interval >= first").select("run_id", "interval", "bin")  # at most a row a bin and interval
    upto = Window.partitionBy("run_id", "bin").orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda name: F.sum(F.coalesce(name, F.lit(0))).over(upto)
    return grid.join(c, ["run_id", "interval", "bin"], "left").select("run_id", "interval", "bin", total("born").alias("all_mutations"), (total("born") - total("died")).alias("circulating_mutations"))


def interval(year: Column, width: int) -> Column:
    """The save interval that a year's events are reported in: year 0 alone, then (k - 1) * width + 1 to k * width."""
    return F.ceil(year / width).cast("int")


def interval_counts(events: DataFrame, width: int) -> DataFrame:
    """Counts of each kind of event per run and save interval."""
    return events.groupBy("run_id", interval(F.col("sim_year"), width).alias("interval")).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("marriage", "birth", "random_death", "cull_death")])


def with_last_size(results: DataFrame) -> DataFrame:
    """Results with last_numinds: the population size of the row before, of the same run; null in the first."""
    return results.withColumn("last_numinds", F.lag("numinds").over(Window.partitionBy("run").orderBy("year")))
