"""Haplotypes as packed words: arrays of longs of WORD bits each, the first position in a word's highest bit. No step here makes a string of bits.

A haplotype table has run_id, ind_id, copy and words; `copies_of` has one row a carrier with both copies, c0 and c1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .genome import WORD, carriers, copies, found_runs, measured, whole_x
from .statistics import length_stats

#: Bits of a lane in which set bits are counted: two lanes in a long, for up to 2**31 - 1 copies a run.
LANE = WORD // 2


def span(low: Column, high: Column, word: Column) -> Column:
    """The bits of a word (its number from 0) whose positions are in [low, high)."""
    first = F.greatest(low - word * WORD, F.lit(0))
    after = F.least(high - word * WORD, F.lit(WORD))
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), (after - first).cast("int")) - 1
    return F.when(after > first, F.call_function("shiftleft", ones, (F.lit(WORD) - after).cast("int"))).otherwise(F.lit(0).cast("long"))


def word_count(numbits: int) -> int:
    return -(-numbits // WORD)


def from_spans(spans: Column, numbits: int) -> Column:
    """Words in which the bits of an array of (low, high) are set."""
    nothing = F.lit(0).cast("long")
    return F.transform(
        F.sequence(F.lit(0), F.lit(word_count(numbits) - 1)),
        lambda w: F.aggregate(F.filter(spans, lambda s: (s["low"] < (w + 1) * WORD) & (s["high"] > w * WORD)), nothing, lambda acc, s: acc.bitwiseOR(span(s["low"], s["high"], w))),
    )


def copies_of(haplotypes: DataFrame) -> DataFrame:
    """One row a carrier: run_id, ind_id, c0, c1; null for a copy that isn't there."""
    return copies(haplotypes, "words")


def masks(cross: DataFrame, numbits: int) -> DataFrame:
    """(run_id, child_id, role, parent, mask): words of the recombination masks. cross: of `genome.crossovers`."""
    end = F.col("qstart") + F.col("qlen")
    spans = lambda *s: F.array(*[F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")) for a, b in s])
    inner, outer = spans((F.col("lo"), F.col("hi"))), spans((F.col("pstart"), F.col("lo")), (F.col("hi"), end))
    own = F.when(whole_x(), F.array().cast("array<struct<low:int,high:int>>")).when(F.col("coin") == 1, inner).otherwise(outer)
    made = cross.groupBy("run_id", "child_id", "role", "parent").agg(F.flatten(F.collect_list(own)).alias("spans"))  # 23 rows each
    return made.select("run_id", "child_id", "role", "parent", from_spans(F.col("spans"), numbits).alias("mask"))


def meiosis(cross: DataFrame, haplotypes: DataFrame, numbits: int) -> DataFrame:
    """Haplotypes of the newborn, as `genome.meiosis` makes them: word by word (mask & copy 0) | (~mask & copy 1). Only carriers are joined, before masks are made; a child without any seed bit has no rows.
    Words are never broadcast, as their size can't be seen before they are made."""
    both = copies_of(haplotypes).withColumnRenamed("ind_id", "parent")
    zeros = F.array_repeat(F.lit(0).cast("long"), word_count(numbits))
    carried = cross.join(haplotypes.select("run_id", F.col("ind_id").alias("parent")).hint("merge"), ["run_id", "parent"], "left_semi")
    m = masks(carried, numbits).join(both.hint("merge"), ["run_id", "parent"]).withColumn("c0", F.coalesce("c0", zeros)).withColumn("c1", F.coalesce("c1", zeros))
    taken = F.transform("mask", lambda x, i: x.bitwiseAND(F.col("c0")[i]).bitwiseOR(F.bitwise_not(x).bitwiseAND(F.col("c1")[i])))
    made = m.select("run_id", F.col("child_id").alias("ind_id"), F.when(F.col("role") == "dad", 0).otherwise(1).alias("copy"), taken.alias("words"))
    return carriers(made, "words", zeros, lambda words: F.exists(words, lambda x: x != 0))


def first_bits(words: Column) -> Column:
    """Words in which the first bit of each run of ones is set."""
    nothing, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    before = lambda x, i: F.shiftright(x, 1).bitwiseOR(F.shiftleft(F.coalesce(F.get(words, i - 1), nothing).bitwiseAND(one), WORD - 1))
    return F.transform(words, lambda x, i: x.bitwiseAND(F.bitwise_not(before(x, i))))


def _at(places: list[int], size: int) -> np.ndarray:
    """Words with the bits at the places."""
    made = np.zeros(size, np.int64)
    for p in places:
        if p // WORD < size:
            made[p // WORD] |= 1 << (WORD - 1 - p % WORD)
    return made


def runs(words: pa.Array, cuts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last position of each maximal run of ones in an array of words; cuts: positions at which a run ends and another begins.
    First and last bits of runs are found word by word, with the carry of the word beside it."""
    sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    x = words.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    begins = bounds[:-1][sizes > 0]
    before[begins] = 0
    after[begins[1:] - 1] = 0
    number = np.arange(len(x)) - np.repeat(bounds[:-1], sizes)
    most = int(sizes.max(initial=0))
    first = x & ~(x >> 1 | (before & 1) << WORD - 1) | x & _at(cuts, most)[number]
    last = x & ~(x << 1 | after >> WORD - 1) | x & _at([c - 1 for c in cuts if c > 0], most)[number]

    def places(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words and positions of the bits that are set."""
        at = np.flatnonzero(np.unpackbits(marks.astype(">i8").view(np.uint8)))
        return at // 64, number[at // 64] * WORD + at % 64 - (64 - WORD)

    word, start = places(first)
    return np.searchsorted(bounds, word, "right") - 1, start, places(last)[1]


def islands(haplotypes: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """(run_id, ind_id, copy, start, length) of the maximal runs of ones, without a shuffle; they cross chromosomes unless cut, for example at the starts of arms."""
    return found_runs(haplotypes, "words", lambda words: runs(words, cuts or []))


def measures(haplotypes: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """`genome.measured` of words."""
    return measured(haplotypes, "words", lambda words: runs(words, cuts or []), lambda words: words)


def block_stats(haplotypes: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """As `statistics.block_stats`."""
    return length_stats(haplotypes, islands(haplotypes, cuts))


def allele_counts(haplotypes: DataFrame) -> DataFrame:
    """(run_id, ind_id, allele_count, num_blocks), as `genome.allele_counts`: set bits, and first bits of runs, of both copies."""
    total = lambda words: F.sum(F.aggregate(words, F.lit(0), lambda n, x: n + F.bit_count(x))).cast("int")
    return haplotypes.groupBy("run_id", "ind_id").agg(total(F.col("words")).alias("allele_count"), total(first_bits(F.col("words"))).alias("num_blocks"))


def by_word(haplotypes: DataFrame) -> DataFrame:
    """(run_id, ind_id, copy, word, bits): a row a word, words without a bit left out."""
    return haplotypes.select("run_id", "ind_id", "copy", F.posexplode("words").alias("word", "bits")).filter("bits <> 0")


def retained(haplotypes: DataFrame, numbits: int) -> DataFrame:
    """(run_id, retained, perc_seed_genome, av_coverage), as `statistics.coverage`: words are or-ed over all copies, and what is left is counted."""
    w = by_word(haplotypes).groupBy("run_id", "word").agg(F.bit_or("bits").alias("any"), F.sum(F.bit_count("bits")).alias("s"))
    made = w.groupBy("run_id").agg(F.sum(F.bit_count("any")).alias("kept"), F.sum("s").alias("s"))
    out = haplotypes.select("run_id").distinct().join(made, "run_id", "left")
    return out.select("run_id", F.coalesce("kept", F.lit(0)).alias("retained"), F.coalesce(F.col("kept") / numbits * 100, F.lit(0.0)).alias("perc_seed_genome"), F.coalesce(F.col("s") / (F.col("kept") * numbits), F.lit(0.0)).alias("av_coverage"))


def position_counts(haplotypes: DataFrame) -> DataFrame:
    """(run_id, position, n): set bits at each position over all copies, where there are any.

    A word is shifted LANE times, and each time two of its bits stand alone in the two lanes of a long; longs are summed, so LANE sums count all the bits of a word
    without taking it apart. Tasks add up their own words first.
    """
    lanes = (1 << LANE) | 1
    sums = [F.sum(F.call_function("shiftright", F.col("bits"), F.lit(s)).bitwiseAND(F.lit(lanes))).alias(f"s{s}") for s in range(LANE)]
    w = by_word(haplotypes).groupBy("run_id", "word").agg(*sums)
    # shift s leaves bit s in the low lane and bit s + LANE in the high one; bit b is position WORD - 1 - b of the word
    at = lambda b: (F.col("word") * WORD + (WORD - 1 - b)).alias("position")
    pairs = [F.struct(at(s), F.col(f"s{s}").bitwiseAND(F.lit((1 << LANE) - 1)).alias("n")) for s in range(LANE)]
    pairs += [F.struct(at(s + LANE), F.call_function("shiftright", F.col(f"s{s}"), F.lit(LANE)).alias("n")) for s in range(LANE)]
    return w.select("run_id", F.explode(F.array(*pairs)).alias("p")).select("run_id", "p.position", "p.n").filter("n > 0")


def heterozygosity(haplotypes: DataFrame, sizes: DataFrame, numbits: int) -> DataFrame:
    """(run_id, het, av_heterozygosity): positions that differ between a person's copies, by xor, and their share over the whole population (sizes: run_id, n)."""
    zeros = F.array_repeat(F.lit(0).cast("long"), word_count(numbits))
    bits = F.zip_with(F.coalesce("c0", zeros), F.coalesce("c1", zeros), lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long"))
    h = copies_of(haplotypes).groupBy("run_id").agg(F.sum(F.aggregate(bits, F.lit(0).cast("long"), lambda total, n: total + n)).alias("het"))
    return sizes.join(h, "run_id", "left").select("run_id", F.coalesce("het", F.lit(0)).alias("het"), (F.coalesce("het", F.lit(0)) / (numbits * F.col("n")) * 100).alias("av_heterozygosity"))
