"""Static tables: genome layout, actuarial risks, age pyramid. All are small and fixed, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lengths of the short (p) and long (q) arms of chromosomes 1 to 23.
P_ARMS = [125, 93, 91, 50, 48, 61, 60, 46, 49, 40, 54, 36, 18, 17, 18, 36, 24, 17, 27, 27, 13, 15, 60]
Q_ARMS = [126, 153, 112, 144, 135, 112, 101, 103, 93, 97, 83, 80, 98, 90, 84, 54, 56, 60, 38, 36, 35, 36, 95]

# Yearly risk of death by age group.
RISKS = {
    0: 0.108, 1: 0.0203, 5: 0.0055, 10: 0.0035, 15: 0.0047, 20: 0.0067, 25: 0.0093, 30: 0.0112, 35: 0.0124, 40: 0.0136,
    45: 0.0148, 50: 0.0175, 55: 0.0217, 60: 0.0295, 65: 0.0438, 70: 0.0676, 75: 0.0995, 80: 0.1495, 85: 0.2242,
}
#: The risk from age 1 to 4 (fixed value).
INFANT_RISK = 0.0203

# People by age, 0 to 113, of the sample population.
PYRAMID = [
    8895, 8793, 8533, 8405, 8182, 8142, 8116, 8038, 8007, 8078, 8007, 7986, 8028, 7978, 7928, 7850, 7734, 7777, 7701,
    7675, 7612, 7520, 7558, 7429, 7392, 7222, 7271, 7205, 7109, 6969, 6866, 6854, 6779, 6631, 6563, 6561, 6420, 6277,
    6301, 6220, 6170, 6041, 5907, 5883, 5838, 5651, 5591, 5564, 5481, 5322, 5229, 5096, 4996, 4888, 4848, 4693, 4584,
    4513, 4412, 4295, 4141, 4037, 3924, 3643, 3489, 3375, 3202, 3097, 2970, 2698, 2533, 2251, 2106, 1980, 1786, 1608,
    1442, 1310, 1114, 929, 813, 669, 586, 447, 342, 234, 216, 172, 131, 98, 76, 60, 41, 26, 18, 20, 20, 13, 13, 7, 4, 5, 1, 2, 4,
    1, 2, 3, 1, 2, 2, 0, 0, 1,
]
#: Ages that founders may have.
FOUNDER_AGES = 100


def arm_rows(multiplier: int = 1) -> list[tuple[int, str, int, int]]:
    """(chrom, arm, start, length): arms follow one another from 0."""
    out, at = [], 0
    for chrom, pair in enumerate(zip(P_ARMS, Q_ARMS, strict=True), 1):
        for arm, length in zip("pq", pair, strict=True):
            out.append((chrom, arm, at, length * multiplier))
            at += length * multiplier
    return out


def genome_size(multiplier: int = 1) -> int:
    return (sum(P_ARMS) + sum(Q_ARMS)) * multiplier


def arms(spark: SparkSession, multiplier: int = 1) -> DataFrame:
    return spark.createDataFrame(arm_rows(multiplier), "chrom int, arm string, start int, length int")


def read_arms(spark: SparkSession, path: str, multiplier: int = 1) -> DataFrame:
    """The same from a CSV with the columns Chromosome, Arm (0: p, 1: q), Start, Length."""
    raw = spark.read.csv(path, header=True, schema="Chromosome int, Arm int, Start int, Length int")
    return raw.select(F.col("Chromosome").alias("chrom"), F.when(F.col("Arm") == 0, "p").otherwise("q").alias("arm"), (F.col("Start") * multiplier).alias("start"), (F.col("Length") * multiplier).alias("length"))


def chromosome_rows(multiplier: int = 1) -> list[tuple[int, int, int, int, int]]:
    rows = arm_rows(multiplier)
    return [(p[0], p[2], p[3], q[2], q[3]) for p, q in zip(rows[::2], rows[1::2], strict=True)]


def chromosomes(spark: SparkSession, multiplier: int = 1) -> DataFrame:
    """One row a chromosome: chrom, pstart, plen, qstart, qlen."""
    return spark.createDataFrame(chromosome_rows(multiplier), "chrom int, pstart int, plen int, qstart int, qlen int")


def actuarial(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RISKS.items()), "age_group int, risk double")


def read_actuarial(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema="Age int, Risk double, PopProb double, x1 string, x2 string, x3 string", enforceSchema=True)
    return raw.select(F.col("Age").alias("age_group"), F.col("Risk").alias("risk"))


def pyramid_weights(n: int) -> list[int | float]:
    """Weights of founders' ages: whole people of n; plain shares where those are all 0."""
    total = sum(PYRAMID)
    whole = [int(p / total * n) for p in PYRAMID[:FOUNDER_AGES]]
    return whole if any(whole) else [p / total for p in PYRAMID[:FOUNDER_AGES]]


def age_ranges(n: int) -> list[tuple[int, float, float]]:
    """(age, low, high): the share of the cumulative weight that each age with any weight covers."""
    weights = pyramid_weights(n)
    total, at, out = sum(weights), 0, []
    for age, w in enumerate(weights):
        if w:
            out.append((age, at / total, (at + w) / total))
            at += w
    return out


def pyramid(spark: SparkSession) -> DataFrame:
    total = sum(PYRAMID)
    return spark.createDataFrame([(a, n, n / total) for a, n in enumerate(PYRAMID)], "age int, num int, p double")


def read_pyramid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="Age int, Num int, P double").toDF("age", "num", "p")
