"""Domain-shaped views of the driver tables, as Spark frames and as DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed
from . import dims

INDIVIDUALS = """
SELECT CAST(0 AS int) AS run_id, c_custkey AS ind_id, CAST(c_custkey % 2 AS int) AS sex,
       CAST(-((c_custkey*37) % 100) AS int) AS birth_year, CAST(85*(1 + c_custkey % 3) AS int) AS lifespan,
       CASE WHEN (c_custkey // 2) % 3 = 0 THEN c_custkey + 1 - 2*(c_custkey % 2) ELSE -1 END AS marriage_state,
       CAST(-(c_custkey % 5) AS int) AS year_of_last_birth,
       CAST((c_custkey*53) % 101 - 50 AS double)/100 AS lat, CAST((c_custkey*31) % 101 - 50 AS double)/100 AS lon,
       CASE WHEN c_custkey >= 50 THEN 2*((c_custkey-50) // 4) ELSE -1 END AS dad,
       CASE WHEN c_custkey >= 50 THEN 2*((c_custkey-50) // 4)+1 ELSE -1 END AS mom,
       CAST(1000 + c_custkey % 200 - 150 AS double)/1000 AS fitness,
       CAST(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 < 3 THEN c_custkey % 7 ELSE -1 END AS int) AS y_gens,
       CAST(CASE WHEN c_custkey % 11 < 4 THEN c_custkey % 11 ELSE -1 END AS int) AS mt_gens,
       CAST(CASE WHEN c_custkey % 13 < 9 THEN c_custkey % 13 ELSE -1 END AS int) AS max_genealo_gens,
       substr(repeat('0110100',7), CAST(1 + c_custkey % 2 AS int), 48) AS centromeres
FROM customer
"""
MUTATIONS = """
SELECT CAST(0 AS int) AS run_id, o.o_custkey AS ind_id, CAST(l.l_linenumber % 2 AS int) AS copy,
       CAST((l.l_partkey*7919 + l.l_linenumber) % 3046 AS int) AS position, CAST(l.l_quantity AS int) - 45 AS effect
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""
EVENTS = """
SELECT CAST(0 AS int) AS run_id, CAST(year(o_orderdate) - 1992 AS int) AS sim_year,
       CASE o_orderstatus WHEN 'F' THEN 'birth' WHEN 'O' THEN 'marriage' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'random_death' ELSE 'cull_death' END END AS kind
FROM orders
"""
HAPLOTYPES_DUCK = """
SELECT CAST(0 AS int) AS run_id, c_custkey AS ind_id, copy,
       array_to_string(list_transform(range(0,3046), lambda p: CASE WHEN (c_custkey*7+copy*13+(p // 16)) % 11 < 4 THEN '1' ELSE '0' END),'') AS bits
FROM customer CROSS JOIN (SELECT unnest([0,1]) AS copy)
"""


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """sql over the driver tables, as frames that are passed in by name."""
    return spark.sql(sql.replace("//", "div").replace("FROM customer", "FROM {customer}").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN orders", "JOIN {orders}").replace("FROM orders", "FROM {orders}"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, INDIVIDUALS, "customer")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, MUTATIONS, "lineitem", "orders")


def yearly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, EVENTS, "orders")


#: People whose haplotypes one task makes: some 30 MB of text. A person is a row of a few bytes, so that Parquet alone would deal thousands of times as much to a task.
PEOPLE_A_TASK = 5000
#: Bits of a haplotype come in stretches of STRETCH equal ones, and those of any haplotype are the same PERIOD stretches over and over, from one of them on.
STRETCH, PERIOD = 16, 11


def _both_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, ind_id, copy, key): two rows a person, dealt to tasks by the number of people, before anything wide is made."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    people = people.repartition(-(-people.count() // PEOPLE_A_TASK) or 1, "c_custkey")
    both = people.select(F.lit(0).alias("run_id"), F.col("c_custkey").alias("ind_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return both.withColumn("key", F.col("ind_id") * 7 + F.col("copy") * 13)


def _stretches(size: int, first: int = 0) -> str:
    """The bits from a stretch on."""
    return "".join(("1" if k % PERIOD < 4 else "0") * STRETCH for k in range(first, first + -(-size // STRETCH)))[:size]


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = dims.genome_size(), F.col("key")
    whole = F.lit(_stretches(size + PERIOD * STRETCH))
    # the remainder of a negative number is none above 0, so all stretches are ones up to number 0
    ones = F.repeat(F.lit("1"), (F.least(-key, F.lit(-(-size // STRETCH))) * STRETCH).cast("int"))
    bits = F.when(key >= 0, F.substring(whole, (key % PERIOD * STRETCH + 1).cast("int"), F.lit(size))).when(key < 0, F.substring(F.concat(ones, whole), 1, size))
    return _both_copies(spark, sf_dir).select("run_id", "ind_id", "copy", F.coalesce(bits, F.repeat(F.lit("0"), F.lit(size))).alias("bits"))


def packed_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as words of bits, made without a string a row."""
    size, key = dims.genome_size(), F.col("key")

    def word(w: Column) -> Column:
        """The bits of the stretches that lie in the word, at least in part."""
        low, high = w * packed.WORD, F.least(w * packed.WORD + packed.WORD, F.lit(size))
        own = lambda k: F.when((key + k) % PERIOD < 4, packed.span(k * STRETCH, F.least((k + 1) * STRETCH, F.lit(size)), w)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.sequence(F.floor(low / STRETCH).cast("int"), F.floor((high - 1) / STRETCH).cast("int")), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(own(k)))

    at = range(0, size, packed.WORD)
    known = [[int(bits[i : i + packed.WORD].ljust(packed.WORD, "0"), 2) for i in at] for bits in (_stretches(size, first) for first in range(PERIOD))]
    ready = F.get(F.array(*[F.expr(f"array({', '.join(f'{w}L' for w in words)})") for words in known]), (key % PERIOD).cast("int"))
    words = F.when(key >= 0, ready).otherwise(F.transform(F.sequence(F.lit(0), F.lit(len(at) - 1)), word))
    return _both_copies(spark, sf_dir).select("run_id", "ind_id", "copy", words.alias("words"))


def values(rows: list[tuple], names: str) -> str:
    """Rows as a SELECT from VALUES."""
    one = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


#: DuckDB text of each view.
DUCK = {
    "individuals": INDIVIDUALS,
    "mutations": MUTATIONS,
    "yearly_events": EVENTS,
    "haplotypes": HAPLOTYPES_DUCK,
    "arms": values(dims.arm_rows(), "chrom, arm, start, length"),
    "chromosomes": values(dims.chromosome_rows(), "chrom, pstart, plen, qstart, qlen"),
    "actuarial": values(list(dims.RISKS.items()), "age_group, risk"),
}


def duck(sql: str, *names: str, **more: str) -> str:
    """sql after a WITH clause of the named views and of further ones."""
    return "WITH " + ", ".join(f"{n} AS ({DUCK[n] if n in DUCK else more[n]})" for n in [*names, *more]) + " " + sql
