"""Genomes: crossovers, masks, meiosis, centromeres, inherited and new mutations, blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.choice import poisson_drawn
from ..functions.rng import integer, uniform, weibull
from ..sources.dims import chromosome_rows

X = 23
ROLES = ("dad", "mom")


def crossovers(births: DataFrame, chromosomes: DataFrame, cfg: Config, year: int) -> DataFrame:
    """One row for each birth, parent and chromosome: where the parent's copies cross over in each arm, and a coin.

    [lo, hi) is the inner stretch: its mask is the coin, the outer stretches' the opposite; a father's chromosome X has mask 0 throughout.
    """
    sides = births.select("run_id", "child_id", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("parent")) for r in ROLES])).alias("s")).select("run_id", "child_id", "s.*")
    c = sides.crossJoin(F.broadcast(chromosomes))  # 23 rows
    u = lambda draw: uniform(draw, F.col("child_id"), F.col("role"), F.col("chrom"), seed=cfg.seed, run=F.col("run_id"), year=year)
    c = c.withColumn("ploc", integer(u("ploc"), 0, F.col("plen") - 1)).withColumn("qloc", integer(u("qloc"), 0, F.col("qlen") - 1)).withColumn("coin", integer(u("coin"), 0, 1))
    return c.withColumn("lo", F.col("pstart") + F.col("ploc")).withColumn("hi", F.col("qstart") + F.col("qloc"))


def whole_x() -> Column:
    return (F.col("role") == "dad") & (F.col("chrom") == X)


def joined_by_chrom(segments: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The 23 strings `seg` of each key, in the order of chromosomes, as one."""
    parts = F.array_sort(F.collect_list(F.struct("chrom", "seg")))
    return segments.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["seg"]), "").alias(name))


def mask_strings(cross: DataFrame) -> DataFrame:
    """(run_id, child_id, role, mask): the recombination mask as a string of 0 and 1."""
    inner, outer = F.col("coin").cast("string"), (1 - F.col("coin")).cast("string")
    seg = F.concat(F.repeat(outer, F.col("ploc")), F.repeat(inner, F.col("plen") - F.col("ploc") + F.col("qloc")), F.repeat(outer, F.col("qlen") - F.col("qloc")))
    seg = F.when(whole_x(), F.repeat(F.lit("0"), F.col("plen") + F.col("qlen"))).otherwise(seg)
    return joined_by_chrom(cross.withColumn("seg", seg), ["run_id", "child_id", "role"], "mask")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are wide, or that much is made of, by keys over all partitions of a shuffle: by their size on disk Spark would take few, as strings of bits compress well and people are short rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def copies(haplotypes: DataFrame, bits: str = "bits") -> DataFrame:
    """One row a carrier: run_id, ind_id, c0, c1."""
    one = lambda k: F.max(F.when(F.col("copy") == k, F.col(bits))).alias(f"c{k}")
    return haplotypes.groupBy("run_id", "ind_id").agg(one(0), one(1))


def carriers(made: DataFrame, bits: str, zeros: Column, some: Callable[[Column], Column]) -> DataFrame:
    """Of newborn haplotypes (run_id, ind_id, copy and bits) both copies of each child with some bit set, zeros for a copy that isn't there."""
    both = copies(made, bits).filter(F.coalesce(some(F.col("c0")), F.lit(False)) | F.coalesce(some(F.col("c1")), F.lit(False)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("copy"), F.coalesce(f"c{k}", zeros).alias(bits)) for k in (0, 1)]))
    return both.select("run_id", "ind_id", each.alias("h")).select("run_id", "ind_id", "h.*")


def meiosis(cross: DataFrame, haplotypes: DataFrame, numbits: int) -> DataFrame:
    """Haplotypes of the newborn: copy 0 from the father and 1 from the mother; bits with mask 1 come from the parent's copy 0, others from copy 1.

    Only carriers are joined: a parent without seed bits gives none, and a child without any has no rows. A parent's 23 chromosomes lie in one row when they meet the copies, so that
    text is moved once a parent and child; it is never broadcast, as its size can't be seen before it is made.
    """
    zeros = F.repeat(F.lit("0"), F.lit(numbits))
    of = F.array_sort(F.collect_list(F.struct("chrom", "pstart", "plen", "ploc", "qstart", "qlen", "lo", "hi", "coin")))
    parts = cross.groupBy("run_id", "child_id", "role", "parent").agg(of.alias("parts"))  # 23 rows each
    both = copies(dealt(haplotypes, "run_id", "ind_id")).select("run_id", F.col("ind_id").alias("parent"), F.coalesce("c0", zeros).alias("a"), F.coalesce("c1", zeros).alias("b"))
    cut = lambda s, at, n: F.substring(s, at + 1, n)

    def seg(p: Column) -> Column:
        inner, outer = F.when(p["coin"] == 1, F.col("a")).otherwise(F.col("b")), F.when(p["coin"] == 1, F.col("b")).otherwise(F.col("a"))
        own = F.concat(cut(outer, p["pstart"], p["ploc"]), cut(inner, p["lo"], p["hi"] - p["lo"]), cut(outer, p["hi"], p["qstart"] + p["qlen"] - p["hi"]))
        return F.when((F.col("role") == "dad") & (p["chrom"] == X), cut(F.col("b"), p["pstart"], p["plen"] + p["qlen"])).otherwise(own)

    made = parts.join(both.hint("merge"), ["run_id", "parent"]).withColumn("bits", F.array_join(F.transform("parts", seg), ""))
    made = made.select("run_id", F.col("child_id").alias("ind_id"), F.when(F.col("role") == "dad", 0).otherwise(1).alias("copy"), "bits")
    return carriers(made, "bits", zeros, lambda bits: F.instr(bits, "1") > 0)


def centromeres(cross: DataFrame, people: DataFrame) -> DataFrame:
    """(run_id, child_id, centromeres): 48 bits, at 2 * chrom + 0 the father's and + 1 the mother's; null if neither parent has any."""
    p = people.select("run_id", F.col("ind_id").alias("parent"), "centromeres")
    c = cross.join(p, ["run_id", "parent"])
    bit = F.coalesce(F.substring("centromeres", 2 * F.col("chrom") + (1 - F.col("coin")) + 1, F.lit(1)), F.lit("0"))
    place = 2 * F.col("chrom") + F.when(F.col("role") == "dad", 0).otherwise(1)
    rows = c.select("run_id", "child_id", place.alias("place"), bit.alias("bit"), F.col("centromeres").isNotNull().alias("has"))
    parts = F.array_sort(F.collect_list(F.struct("place", "bit")))
    made = rows.groupBy("run_id", "child_id").agg(F.concat(F.lit("00"), F.array_join(F.transform(parts, lambda x: x["bit"]), "")).alias("s"), F.bool_or("has").alias("has"))
    return made.select("run_id", "child_id", F.when(F.col("has"), F.col("s")).alias("centromeres"))


def chromosome_of(position: Column, multiplier: int = 1) -> Column:
    """The chromosome of a genome bin: how many of the 23 starts are at or before it."""
    return F.size(F.filter(F.array(*[F.lit(r[1]) for r in chromosome_rows(multiplier)]), lambda start: start <= position))


def inherited_mutations(mutations: DataFrame, cross: DataFrame, cfg: Config) -> DataFrame:
    """Mutations of the newborn from the parents' copies that the masks point at: an equality join on parent and chromosome, then a filter."""
    at = F.col("position")
    c = cross.select("run_id", "child_id", "role", F.col("parent").alias("ind_id"), "chrom", "lo", "hi", "coin")
    m = mutations.withColumn("chrom", chromosome_of(at, cfg.multiplier)).join(c, ["run_id", "ind_id", "chrom"])
    mask = F.when(whole_x(), 0).otherwise((((at >= F.col("lo")) & (at < F.col("hi"))) == (F.col("coin") == 1)).cast("int"))
    source = mask if cfg.mutation_source == "as_mask" else 1 - mask
    return m.filter(F.col("copy") == source).select("run_id", F.col("child_id").alias("ind_id"), F.when(F.col("role") == "dad", 0).otherwise(1).alias("copy"), "position", "effect")


def effect(cfg: Config, u: Column, w: Column, s: Column) -> Column:
    """A mutation's effect in thousandths: none with chance f_neutral, else Weibull, harmful unless s is within f_beneficial."""
    size = weibull(w, cfg.shape, cfg.scale) / cfg.Weibull_adj
    signed = F.when(s <= cfg.f_beneficial, size).otherwise(-size)
    return F.when(u < cfg.f_neutral, 0).otherwise((signed * 1000).cast("int"))


def new_mutations(births: DataFrame, cfg: Config, year: int, numbits: int) -> DataFrame:
    """(run_id, ind_id, copy, position, effect): a Poisson number for each birth."""
    u = lambda draw, *k: uniform(draw, F.col("child_id"), *k, seed=cfg.seed, run=F.col("run_id"), year=year)
    n = poisson_drawn(births.select("run_id", "child_id", u("npois").alias("u")), "u", cfg.mu, "k").filter("k > 0")
    j = n.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k"))))
    k = F.col("j")
    return j.select(
        "run_id",
        F.col("child_id").alias("ind_id"),
        integer(u("mcopy", k), 0, 1).alias("copy"),
        integer(u("pos", k), 0, numbits - 1).alias("position"),
        effect(cfg, u("neutral", k), u("weib", k), u("sign", k)).alias("effect"),
    )


def ones(bits: Column) -> Column:
    """The number of 1; zeros are taken out sixteen at a time, what is left one by one."""
    return F.length(F.replace(F.replace(bits, F.lit("0" * 16), F.lit("")), F.lit("0"), F.lit("")))


def allele_counts(haplotypes: DataFrame) -> DataFrame:
    """(run_id, ind_id, allele_count, num_blocks): bits and maximal runs of 1 of both copies."""
    return haplotypes.groupBy("run_id", "ind_id").agg(F.sum(ones(F.col("bits"))).cast("int").alias("allele_count"), F.sum(F.regexp_count("bits", F.lit("1+"))).cast("int").alias("num_blocks"))


def blocks(haplotypes: DataFrame, arms: DataFrame | None = None) -> DataFrame:
    """(run_id, ind_id, copy, length) of each maximal run of 1; runs cross chromosomes unless arms are given to split by."""
    h = haplotypes
    if arms is not None:
        # a row with all arms: the arms of a haplotype are cut in its own row, and a 0 between them ends the runs
        every = arms.agg(F.collect_list(F.struct("start", "length")).alias("arms"))
        h = h.crossJoin(F.broadcast(every)).withColumn("bits", F.expr("array_join(transform(arms, a -> substring(bits, a.start + 1, a.length)), '0')"))
    return h.select("run_id", "ind_id", "copy", F.explode(F.regexp_extract_all("bits", F.lit("(1+)"), F.lit(1))).alias("run")).select("run_id", "ind_id", "copy", F.length("run").alias("length"))


#: Bits that a word holds: a long without its sign.
WORD = 62


def words(bits: Column, numbits: int) -> Column:
    """A string of 0 and 1 as an array of longs, WORD bits each. The string is cut in one pass."""
    parts = F.regexp_extract_all(F.substring(bits, 1, -(-numbits // WORD) * WORD), F.lit(f"(.{{1,{WORD}}})"), F.lit(1))
    return F.transform(parts, lambda part: F.conv(part, 2, 10).cast("bigint"))


#: Bytes of haplotypes whose runs are looked for in one go.
AT_ONCE = 1 << 21


def found_runs(haplotypes: DataFrame, bits: str, find: Callable) -> DataFrame:
    """(run_id, ind_id, copy, start, length) of the maximal runs of ones, without a shuffle. find: of a column of haplotypes in Arrow the row, first and last position of each run, as numbers in order."""
    ids = ["run_id", "ind_id", "copy"]

    def cut(batches):
        for part in in_parts(batches, bits):
            row, first, last = find(part[bits])
            where = [pa.array(x.astype("int32")) for x in (first, last - first + 1)]
            yield pa.RecordBatch.from_arrays([part[c].take(pa.array(row)) for c in ids] + where, [*ids, "start", "length"])

    kinds = [f"{c} {haplotypes.schema[c].dataType.simpleString()}" for c in ids]
    return haplotypes.select(*ids, bits).mapInArrow(cut, ", ".join([*kinds, "start int", "length int"]))


def in_parts(batches: Iterable[pa.RecordBatch], bits: str) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some AT_ONCE bytes of haplotypes."""
    for batch in batches:
        step = max(1, AT_ONCE * len(batch) // max(1, batch[bits].nbytes))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def _ones(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte of an array of texts is 1, as one array, and where each text begins in it, with its end."""
    text = bits.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    ones = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] == ord("1")
    return ones, bounds - bounds[0]


def runs(bits: pa.Array, cuts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last position of each maximal run of 1 in an array of texts, which are looked at as one array of bytes; cuts: positions at which a run ends and another begins."""
    ones, bounds = _ones(bits)
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    for cut in cuts or []:
        begins = np.union1d(begins, (bounds[:-1] + cut)[bounds[:-1] + cut < bounds[1:]])
    ends = begins[1:] - 1
    first, last = ones.copy(), ones.copy()
    first[1:], last[:-1] = ones[1:] > ones[:-1], ones[:-1] > ones[1:]
    first[begins], last[ends] = ones[begins], ones[ends]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(bounds, first, "right") - 1
    return row, first - bounds[row], last - bounds[row]


def packed_texts(bits: pa.Array, numbits: int) -> pa.Array:
    """An array of texts as arrays of longs, WORD bits each; those of a shorter text end in zeros. Null stays null."""
    ones, bounds = _ones(bits)
    sizes = np.diff(bounds)
    count = -(-max(numbits, int(sizes.max(initial=0))) // WORD)
    flat = np.zeros((len(sizes), count * WORD), bool)
    if len(ones) and (sizes == sizes[0]).all():
        flat[:, : sizes[0]] = ones.reshape(len(sizes), sizes[0])
    else:
        flat[np.arange(count * WORD) < sizes[:, None]] = ones
    wide = np.zeros((len(sizes), count, 64), bool)
    wide[:, :, 64 - WORD :] = flat.reshape(len(sizes), count, WORD)
    longs = np.packbits(wide).view(">i8").astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * count), pa.array(longs), mask=bits.is_null())


def measured(haplotypes: DataFrame, bits: str, find: Callable, words: Callable) -> DataFrame:
    """(run_id, ind_id, copy, ones, blocks, squares, words) of each haplotype: its bits that are set, its maximal runs of them, the sum of the squares of their lengths, and it itself as words; all in one pass, without a shuffle.
    find: as of `found_runs`; words: makes words of a column of haplotypes in Arrow."""
    ids = ["run_id", "ind_id", "copy"]

    def measure(batches):
        for part in in_parts(batches, bits):
            row, first, last = find(part[bits])
            length = last - first + 1
            sums = [np.bincount(row, weight, len(part)).astype(np.int64) for weight in (length, None, length * length)]
            yield pa.RecordBatch.from_arrays([part[c] for c in ids] + [pa.array(x) for x in sums] + [words(part[bits])], [*ids, "ones", "blocks", "squares", "words"])

    kinds = [f"{c} {haplotypes.schema[c].dataType.simpleString()}" for c in ids]
    return haplotypes.select(*ids, bits).mapInArrow(measure, ", ".join([*kinds, "ones bigint", "blocks bigint", "squares bigint", "words array<bigint>"]))


def measures(haplotypes: DataFrame, numbits: int, cuts: list[int] | None = None) -> DataFrame:
    """`measured` of text."""
    return measured(haplotypes, "bits", lambda bits: runs(bits, cuts), lambda bits: packed_texts(bits, numbits))


def islands(haplotypes: DataFrame) -> DataFrame:
    """The same runs with their places, (run_id, ind_id, copy, start, length)."""
    return found_runs(haplotypes, "bits", runs)


def fitness(mutations: DataFrame, model: str = "running") -> DataFrame:
    """(run_id, ind_id, mutations, fitness) of people with any mutation.

    running: positions are counted along copy 0, then along copy 1, and at each place with mutations copy 0's summed effect there is
    weighed by the count so far; only places where copy 0 has mutations add anything. additive: 1 plus the sum of effects.
    """
    if model == "additive":
        return mutations.groupBy("run_id", "ind_id").agg(F.count("*").cast("int").alias("mutations"), (1 + F.sum("effect") / 1000).alias("fitness"))
    at = mutations.groupBy("run_id", "ind_id", "position").agg(
        F.sum(F.when(F.col("copy") == 0, 1).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("copy") == 1, 1).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("copy") == 0, F.col("effect")).otherwise(0)).alias("s0"),
    )
    whole = Window.partitionBy("run_id", "ind_id")
    upto = whole.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    c = at.withColumn("cum0", F.sum("n0").over(upto)).withColumn("cum1", F.sum("n1").over(upto)).withColumn("tot0", F.sum("n0").over(whole))
    term = F.when(F.col("n0") > 0, F.col("s0") / 1000.0 * (1.0 / F.col("cum0") + 1.0 / (F.col("tot0") + F.col("cum1"))))
    return c.groupBy("run_id", "ind_id").agg((F.sum("n0") + F.sum("n1")).cast("int").alias("mutations"), (1 + F.coalesce(F.sum(term), F.lit(0.0))).alias("fitness"))


def bin_fitness(mutations: DataFrame) -> DataFrame:
    """(run_id, ind_id, copy, position, fitness, num): of each genome bin with mutations."""
    return mutations.groupBy("run_id", "ind_id", "copy", "position").agg((1 + F.sum("effect") / 1000).alias("fitness"), F.count("*").alias("num"), F.sum("effect").alias("total"))
