"""Queries of the population operators on views of the driver tables, with the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config
from .functions.choice import chosen, drawn, guide, poisson_drawn
from .functions.rng import integer, poisson_table, uniform, uniform_sql, weibull
from .operators import genome, mating, mortality, packed, pedigree, people, statistics
from .plans import logs, report, sinks
from .plans.state import checkpointer, shared_dir
from .sources import dims, founders, views
from .sources.views import duck

CFG = Config()
YEAR = 0
NUMBITS = dims.genome_size()
DISTANCE = 0.05
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def u(draw: str, *keys: str) -> str:
    return uniform_sql(draw, *keys, run="run_id")


# Shared SQL. ages are 0 - birth_year in year 0.
ELIGIBLE = "SELECT * FROM individuals WHERE sex = 1 AND marriage_state > -1 AND 0 - birth_year < lifespan * 0.5 AND year_of_last_birth + 3 <= 0"
PAIRS = "SELECT m.run_id, d.ind_id AS dad, m.ind_id AS mom, m.fitness AS mf, d.fitness AS df FROM eligible m JOIN individuals d ON d.ind_id = m.marriage_state"
BIRTHS = f"SELECT run_id, dad, mom, (SELECT max(ind_id) FROM individuals) + row_number() OVER (ORDER BY {u('child', 'mom')}, mom) AS child_id FROM pairs"
DRAWN = f"""SELECT b.run_id, b.child_id, b.role, b.parent, c.*,
    CAST(floor({u('ploc', 'child_id', 'role', 'chrom')} * plen) AS INTEGER) AS ploc, CAST(floor({u('qloc', 'child_id', 'role', 'chrom')} * qlen) AS INTEGER) AS qloc,
    CAST(floor({u('coin', 'child_id', 'role', 'chrom')} * 2) AS INTEGER) AS coin
    FROM (SELECT run_id, child_id, 'dad' AS role, dad AS parent FROM births UNION ALL SELECT run_id, child_id, 'mom', mom FROM births) b CROSS JOIN chromosomes c"""
CROSS = "SELECT *, CAST(pstart + ploc AS INTEGER) AS lo, CAST(qstart + qloc AS INTEGER) AS hi FROM drawn"
TO_BIRTHS = {"eligible": ELIGIBLE, "pairs": PAIRS, "births": BIRTHS}
TO_CROSS = TO_BIRTHS | {"drawn": DRAWN, "crossed": CROSS}
THRESHOLDS = """SELECT i.*, a.age_group, CASE WHEN 0 - birth_year > 0 AND 0 - birth_year < 5 THEN 0.0203::DOUBLE ELSE a.risk END * (85::DOUBLE / lifespan) + 1 - (1 + fitness / 1000) AS threshold
    FROM (SELECT *, least(CAST(trunc((0 - birth_year)::DOUBLE / lifespan * 85 / 5) AS INTEGER) * 5, 85) AS g FROM individuals) i JOIN actuarial a ON a.age_group = i.g"""
DEAD = f"SELECT run_id, ind_id FROM thresholds WHERE {u('die', 'ind_id')} < threshold"
TO_DEAD = {"thresholds": THRESHOLDS, "dead": DEAD}
SEED = f"SELECT ind_id FROM individuals ORDER BY {u('seed', 'ind_id')}, ind_id LIMIT 1"
BREEDS = "(0 - birth_year > 20 AND (sex = 0 OR 0 - birth_year < lifespan * 0.5))"
GROOMS = "SELECT * FROM individuals WHERE marriage_state = -1 AND 0 - birth_year > 20 AND sex = 0"
BRIDES = "SELECT * FROM individuals WHERE marriage_state = -1 AND 0 - birth_year > 20 AND sex = 1 AND 0 - birth_year < lifespan * 0.5"
MEN = f"SELECT *, row_number() OVER (ORDER BY {u('shufm', 'ind_id')}, ind_id) AS rank FROM grooms"
WOMEN = f"SELECT *, row_number() OVER (ORDER BY {u('shuff', 'ind_id')}, ind_id) AS rank FROM brides"
TO_RANKS = {"grooms": GROOMS, "brides": BRIDES, "men": MEN, "women": WOMEN}
CANDIDATES = f"SELECT m.ind_id AS man, w.ind_id AS woman, w.rank AS wr, w.birth_year - m.birth_year AS gap FROM men m JOIN women w ON sqrt(pow(w.lat - m.lat, 2) + pow(w.lon - m.lon, 2)) <= {DISTANCE}::DOUBLE"
PEOPLE_DNA = "SELECT i.*, h.a AS allele_count, h.b AS num_blocks FROM individuals i LEFT JOIN (SELECT ind_id, sum(length(replace(bits, '0', ''))) AS a, sum(len(regexp_extract_all(bits, '1+'))) AS b FROM haplotypes GROUP BY ind_id) h ON h.ind_id = i.ind_id"
LENGTHS = "SELECT ind_id, copy, length(unnest(regexp_extract_all(bits, '1+'))) AS n FROM haplotypes"
FITNESS = """SELECT ind_id, CAST(sum(n0) + sum(n1) AS INTEGER) AS mutations, 1 + coalesce(sum(CASE WHEN n0 > 0 THEN s0 / 1000.0::DOUBLE * (1.0::DOUBLE / cum0 + 1.0::DOUBLE / (tot0 + cum1)) END), 0) AS fitness FROM (
    SELECT *, sum(n0) OVER (PARTITION BY ind_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS cum0, sum(n1) OVER (PARTITION BY ind_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS cum1, sum(n0) OVER (PARTITION BY ind_id) AS tot0
    FROM (SELECT ind_id, position, count(CASE WHEN copy = 0 THEN 1 END) AS n0, count(CASE WHEN copy = 1 THEN 1 END) AS n1, sum(CASE WHEN copy = 0 THEN effect ELSE 0 END) AS s0 FROM mutations GROUP BY ALL)) GROUP BY ind_id"""


def half_even(x: str) -> str:
    """DuckDB SQL that rounds the shortest decimal form of a double to two places, halves to even."""
    t = f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 18)) * 100"
    return f"(CAST(CASE WHEN {t} - floor({t}) > 0.5 OR ({t} - floor({t}) = 0.5 AND floor({t})::BIGINT % 2 <> 0) THEN floor({t}) + 1 ELSE floor({t}) END AS DOUBLE) / 100 + 0.0)"


def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = views.individuals(spark, sf_dir)
    last = who.groupBy("run_id").agg(F.max("ind_id").alias("last_id"))
    return people.with_ids(people.couples(people.eligible_mothers(who, CFG, YEAR), who, CFG, YEAR), last, CFG, YEAR)


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome.crossovers(births(spark, sf_dir), dims.chromosomes(spark), CFG, YEAR)


def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.random_deaths(views.individuals(spark, sf_dir), dims.actuarial(spark), CFG, YEAR)


# people


@query(duck("SELECT ind_id, CAST(0 - birth_year AS INTEGER) AS age FROM grooms", "individuals", grooms=GROOMS))
def avail_grooms(spark, sf_dir):
    return people.singles(views.individuals(spark, sf_dir), CFG, YEAR, people.MALE).select("ind_id", people.age(YEAR).alias("age"))


@query(duck("SELECT ind_id, CAST(0 - birth_year AS INTEGER) AS age FROM brides", "individuals", brides=BRIDES))
def avail_brides(spark, sf_dir):
    return people.singles(views.individuals(spark, sf_dir), CFG, YEAR, people.FEMALE).select("ind_id", people.age(YEAR).alias("age"))


@query(duck("SELECT ind_id, marriage_state FROM eligible", "individuals", eligible=ELIGIBLE))
def pregnancy_eligible(spark, sf_dir):
    return people.eligible_mothers(views.individuals(spark, sf_dir), CFG, YEAR).select("ind_id", "marriage_state")


@query(duck(f"SELECT ind_id FROM eligible WHERE floor({u('birth', 'ind_id')} * 3) = 0", "individuals", eligible=ELIGIBLE))
def births_bernoulli(spark, sf_dir):
    return people.conceiving(people.eligible_mothers(views.individuals(spark, sf_dir), CFG, YEAR), CFG, YEAR).select("ind_id")


@query(duck("SELECT dad, mom FROM pairs", "individuals", eligible=ELIGIBLE, pairs=PAIRS))
def couples_join(spark, sf_dir):
    who = views.individuals(spark, sf_dir)
    return people.couples(people.eligible_mothers(who, CFG, YEAR), who, CFG, YEAR).select("dad", "mom")


@query(duck(f"SELECT dad, mom FROM pairs WHERE {u('select', 'mom')} < (df + mf) / 2", "individuals", eligible=ELIGIBLE, pairs=PAIRS))
def birth_selection(spark, sf_dir):
    who, cfg = views.individuals(spark, sf_dir), CFG.changed(selection="Birth")
    return people.couples(people.eligible_mothers(who, cfg, YEAR), who, cfg, YEAR).select("dad", "mom")


@query(duck("SELECT mom, child_id FROM births", "individuals", **TO_BIRTHS))
def id_allocation(spark, sf_dir):
    return births(spark, sf_dir).select("mom", "child_id")


@query(
    duck(
        f"""SELECT b.child_id AS ind_id, CAST(floor({uniform_sql('sex', 'child_id', run='b.run_id')} * 2) AS INTEGER) AS sex, 0 AS birth_year,
        greatest(CAST(trunc((d.lifespan + m.lifespan)::DOUBLE / 2 * 0.85::DOUBLE) AS INTEGER), 85) AS lifespan, {half_even('(d.lat + m.lat) / 2')} AS lat, {half_even('(d.lon + m.lon) / 2')} AS lon, b.dad, b.mom
        FROM births b JOIN individuals d ON d.ind_id = b.dad JOIN individuals m ON m.ind_id = b.mom""",
        "individuals",
        **TO_BIRTHS,
    )
)
def child_projection(spark, sf_dir):
    return people.children(births(spark, sf_dir), views.individuals(spark, sf_dir), CFG, YEAR).select("ind_id", "sex", "birth_year", "lifespan", "lat", "lon", "dad", "mom")


@query(
    duck(
        f"""SELECT b.child_id AS ind_id, CASE WHEN floor({uniform_sql('sex', 'child_id', run='b.run_id')} * 2) = 0 AND d.y_gens >= 0 THEN d.y_gens + 1 ELSE -1 END AS y_gens,
        CASE WHEN m.mt_gens >= 0 THEN m.mt_gens + 1 ELSE -1 END AS mt_gens,
        CASE WHEN greatest(d.max_genealo_gens, m.max_genealo_gens) >= 0 THEN greatest(d.max_genealo_gens, m.max_genealo_gens) + 1 ELSE -1 END AS max_genealo_gens
        FROM births b JOIN individuals d ON d.ind_id = b.dad JOIN individuals m ON m.ind_id = b.mom""",
        "individuals",
        **TO_BIRTHS,
    )
)
def child_generations(spark, sf_dir):
    return people.children(births(spark, sf_dir), views.individuals(spark, sf_dir), CFG, YEAR).select("ind_id", "y_gens", "mt_gens", "max_genealo_gens")


@query(duck("SELECT i.ind_id, CASE WHEN b.mom IS NULL THEN i.year_of_last_birth ELSE 0 END AS year_of_last_birth, CAST(CASE WHEN b.mom IS NOT NULL THEN 1 END AS INTEGER) AS numbirths FROM individuals i LEFT JOIN births b ON b.mom = i.ind_id", "individuals", **TO_BIRTHS))
def mother_update(spark, sf_dir):
    who = views.individuals(spark, sf_dir).withColumn("numbirths", F.lit(None).cast("int"))
    return people.after_births(who, births(spark, sf_dir), YEAR).select("ind_id", "year_of_last_birth", "numbirths")


@query("""WITH RECURSIVE individuals AS (%s), d AS (
        SELECT ind_id, 0 AS depth FROM individuals WHERE dad = -1
        UNION ALL SELECT i.ind_id, d.depth + 1 FROM individuals i JOIN d ON i.mom = d.ind_id)
    SELECT ind_id, CAST(depth AS INTEGER) AS depth FROM d""" % views.INDIVIDUALS)
def pedigree_depth_recursive(spark, sf_dir):
    return people.pedigree_depth(views.individuals(spark, sf_dir), checkpointer(spark)).select("ind_id", "depth")


# run 1 has the same people with a woman as the seed
@query("""WITH RECURSIVE i0 AS (%s), individuals AS (SELECT * FROM i0 UNION ALL SELECT 1, * EXCLUDE (run_id) FROM i0),
    links AS (SELECT run_id, ind_id, sex, dad AS parent, 1 AS father FROM individuals WHERE dad >= 0 UNION ALL SELECT run_id, ind_id, sex, mom, 0 FROM individuals WHERE mom >= 0),
    f AS (SELECT run_id, ind_id, 0 AS r, sex = 0 AS y, true AS mt FROM individuals WHERE ind_id = run_id
          UNION SELECT l.run_id, l.ind_id, f.r + 1, f.y AND l.father = 1 AND l.sex = 0, f.mt AND l.father = 0 FROM f JOIN links l ON l.run_id = f.run_id AND l.parent = f.ind_id),
    g AS (SELECT run_id, ind_id, max(CASE WHEN y THEN r END) AS y, max(CASE WHEN mt THEN r END) AS mt, min(r) AS least, max(r) AS most FROM f GROUP BY ALL)
    SELECT i.run_id, i.ind_id, CAST(coalesce(y, -1) AS INTEGER) AS y_gens, CAST(coalesce(mt, -1) AS INTEGER) AS mt_gens, CAST(coalesce(least, -1) AS INTEGER) AS min_genealo_gens, CAST(coalesce(most, -1) AS INTEGER) AS max_genealo_gens
    FROM individuals i LEFT JOIN g ON g.run_id = i.run_id AND g.ind_id = i.ind_id""" % views.INDIVIDUALS)
def genealogy_generations(spark, sf_dir):
    one = views.individuals(spark, sf_dir)
    who = one.unionByName(one.withColumn("run_id", F.lit(1)))
    return pedigree.genealogy(who, who.filter("ind_id = run_id"), checkpointer(spark))


# ind_id // 3 % 4 - 1 stands for the fewest generations: the views have none
LEAST = "CAST(ind_id // 3 % 4 - 1 AS INTEGER)"
SAME = "CASE WHEN greatest(d.g, m.g) >= 0 THEN greatest(d.g, m.g) + 1 ELSE -1 END"


@query(
    duck(
        f"""SELECT b.child_id AS ind_id, {SAME} AS same, CASE WHEN d.g >= 0 AND m.g >= 0 THEN least(d.g, m.g) + 1 ELSE {SAME} END AS true_least
        FROM births b JOIN least_gens d ON d.ind_id = b.dad JOIN least_gens m ON m.ind_id = b.mom""",
        "individuals",
        **TO_BIRTHS,
        least_gens=f"SELECT ind_id, {LEAST} AS g FROM individuals",
    )
)
def child_min_generations(spark, sf_dir):
    who = views.individuals(spark, sf_dir).withColumn("min_genealo_gens", F.expr("cast(ind_id div 3 % 4 - 1 as int)"))
    born = births(spark, sf_dir)
    made = lambda how, name: people.children(born, who, CFG.changed(genealogy_min=how), YEAR).select("ind_id", F.col("min_genealo_gens").alias(name))
    return made("same", "same").join(made("true", "true_least"), "ind_id")


@query(duck("SELECT ind_id, sex, birth_year, dad, mom, year_of_last_birth FROM individuals UNION ALL SELECT child_id, CAST(floor(%s * 2) AS INTEGER), 0, dad, mom, NULL FROM births" % uniform_sql("sex", "child_id", run="run_id"), "individuals", **TO_BIRTHS))
def append_newborn(spark, sf_dir):
    who = views.individuals(spark, sf_dir)
    born = people.children(births(spark, sf_dir), who, CFG, YEAR)
    return people.with_newborn(who, born).select("ind_id", "sex", "birth_year", "dad", "mom", "year_of_last_birth")


# marriage


@query(duck("SELECT m.ind_id AS man, w.ind_id AS woman FROM men m JOIN women w ON w.rank = m.rank", "individuals", **TO_RANKS))
def random_marriage(spark, sf_dir):
    return mating.random_pairs(views.individuals(spark, sf_dir), CFG, YEAR).select("man", "woman")


@query(duck("SELECT m.ind_id AS man, w.ind_id AS woman, 'random' AS how FROM men m JOIN women w ON w.rank = m.rank", "individuals", **TO_RANKS))
def marriage_dispatch(spark, sf_dir):
    """Pairs by whichever way the parameter says: 1 is random; a tiny distance in which nobody lives adds none."""
    who = views.individuals(spark, sf_dir)
    apart = who.withColumn("lat", F.col("ind_id") * 10.0)
    pairs = lambda p, cfg, how: mating.marriages(p, cfg, YEAR, checkpointer(spark)).select("man", "woman", F.lit(how).alias("how"))
    return pairs(who, CFG, "random").unionByName(pairs(apart, CFG.changed(random_mating=DISTANCE), "near"))


@query(duck("""SELECT i.ind_id, coalesce(p.woman, q.man, i.marriage_state) AS marriage_state, CASE WHEN q.man IS NOT NULL THEN -3 ELSE i.year_of_last_birth END AS year_of_last_birth
    FROM individuals i LEFT JOIN wed p ON p.man = i.ind_id LEFT JOIN wed q ON q.woman = i.ind_id""", "individuals", **TO_RANKS, wed="SELECT m.ind_id AS man, w.ind_id AS woman FROM men m JOIN women w ON w.rank = m.rank"))
def spouse_update(spark, sf_dir):
    who = views.individuals(spark, sf_dir)
    return mating.married(who, mating.random_pairs(who, CFG, YEAR), CFG).select("ind_id", "marriage_state", "year_of_last_birth")


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    who = views.individuals(spark, sf_dir)
    return mating.shuffled(people.singles(who, CFG, YEAR, people.MALE), "shufm", CFG, YEAR), mating.shuffled(people.singles(who, CFG, YEAR, people.FEMALE), "shuff", CFG, YEAR)


@query(duck("SELECT man, woman, CAST(gap AS INTEGER) AS gap FROM candidates", "individuals", **TO_RANKS, candidates=CANDIDATES))
def mate_candidates_distance(spark, sf_dir):
    return mating.candidates(*both_sides(spark, sf_dir), DISTANCE).select("man", "woman", "gap")


@query(duck("SELECT man, woman, CAST(gap AS INTEGER) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY man ORDER BY CASE WHEN gap > 0 THEN 0 ELSE 1 END, abs(gap), wr) AS n FROM candidates) WHERE n = 1", "individuals", **TO_RANKS, candidates=CANDIDATES))
def mate_argmin_age(spark, sf_dir):
    return mating.nearest(*both_sides(spark, sf_dir), DISTANCE).select("man", "woman", "gap")


@query(None)
def distance_marriage(spark, sf_dir):
    return mating.distance_pairs(views.individuals(spark, sf_dir), CFG.changed(random_mating=DISTANCE), YEAR, checkpointer(spark)).select("man", "woman")


# death


@query(duck("SELECT ind_id, 85::DOUBLE / lifespan AS modifier FROM individuals", "individuals"))
def risk_modifier(spark, sf_dir):
    return views.individuals(spark, sf_dir).select("ind_id", mortality.risk_modifier(CFG).alias("modifier"))


@query(duck("SELECT ind_id, CAST(age_group AS INTEGER) AS age_group FROM thresholds", "individuals", "actuarial", thresholds=THRESHOLDS))
def age_bucket(spark, sf_dir):
    return views.individuals(spark, sf_dir).select("ind_id", mortality.age_bucket(CFG, YEAR).alias("age_group"))


@query(duck("SELECT sex, CAST(age_group AS INTEGER) AS age_group, count(*) AS n, round(sum(greatest(threshold, 0)), 6) AS expected_deaths, count(CASE WHEN %s THEN 1 END) AS breeders FROM thresholds GROUP BY ALL" % BREEDS, "individuals", "actuarial", thresholds=THRESHOLDS))
def expected_risk_join(spark, sf_dir):
    t = mortality.thresholds(views.individuals(spark, sf_dir), dims.actuarial(spark), CFG, YEAR)
    return t.groupBy("sex", "age_group").agg(F.count("*").alias("n"), F.round(F.sum(F.greatest("threshold", F.lit(0.0))), 6).alias("expected_deaths"), F.count_if(mortality.breeders(CFG, YEAR)).alias("breeders"))


@query(duck("SELECT ind_id FROM dead", "individuals", "actuarial", **TO_DEAD))
def random_deaths(spark, sf_dir):
    return dead(spark, sf_dir).select("ind_id")


@query(duck(f"SELECT ind_id, ind_id <> (SELECT ind_id FROM seed) AS counted FROM thresholds WHERE CASE WHEN ind_id = (SELECT ind_id FROM seed) THEN 0 - birth_year >= lifespan ELSE {u('die', 'ind_id')} < threshold END", "individuals", "actuarial", **TO_DEAD, seed=SEED))
def seed_exempt_deaths(spark, sf_dir):
    who = views.individuals(spark, sf_dir)
    return mortality.random_deaths(who, dims.actuarial(spark), CFG, YEAR, founders.seed_person(who, CFG, YEAR)).select("ind_id", "counted")


@query(duck("SELECT ind_id FROM individuals WHERE ind_id NOT IN (SELECT ind_id FROM dead)", "individuals", "actuarial", **TO_DEAD))
def anti_join_dead(spark, sf_dir):
    return mortality.without(views.individuals(spark, sf_dir), dead(spark, sf_dir)).select("ind_id")


@query(duck("SELECT ind_id, CASE WHEN marriage_state IN (SELECT ind_id FROM dead) THEN -1 ELSE marriage_state END AS marriage_state FROM individuals WHERE ind_id NOT IN (SELECT ind_id FROM dead)", "individuals", "actuarial", **TO_DEAD))
def widow_reset(spark, sf_dir):
    return mortality.buried(views.individuals(spark, sf_dir), dead(spark, sf_dir)).select("ind_id", "marriage_state")


@query(duck("SELECT m.ind_id, m.copy, m.position, m.effect FROM mutations m WHERE m.ind_id NOT IN (SELECT ind_id FROM dead)", "individuals", "actuarial", "mutations", **TO_DEAD))
def anti_join_mutations(spark, sf_dir):
    return mortality.without(views.mutations(spark, sf_dir), dead(spark, sf_dir)).select("ind_id", "copy", "position", "effect")


@query(duck(f"SELECT count(CASE WHEN {BREEDS} THEN 1 END) AS breeders FROM individuals", "individuals"))
def breeding_count(spark, sf_dir):
    return statistics.breeding(views.individuals(spark, sf_dir), CFG, YEAR).select("breeders")


CULLED = f"SELECT ind_id FROM (SELECT ind_id, row_number() OVER (ORDER BY {u('cull', 'ind_id')}, ind_id) AS r FROM individuals WHERE ind_id <> (SELECT ind_id FROM seed)) WHERE r <= (SELECT count(*) FROM individuals) - "


@query(duck(CULLED + "100", "individuals", seed=SEED))
def maxpop_cull(spark, sf_dir):
    who = views.individuals(spark, sf_dir)
    caps = who.select("run_id").distinct().withColumn("cap", F.lit(CFG.cap(YEAR)))
    return mortality.culled(who, caps, CFG, YEAR, founders.seed_person(who, CFG, YEAR)).select("ind_id")


@query(duck(CULLED + "CAST(floor(floor((SELECT count(*) FROM individuals) * 0.9::DOUBLE) * 1.02::DOUBLE) AS BIGINT)", "individuals", seed=SEED))
def growth_cull(spark, sf_dir):
    who = views.individuals(spark, sf_dir)
    last = who.groupBy("run_id").agg(F.floor(F.count("*") * 0.9).alias("n"))
    return mortality.culled(who, mortality.growth_caps(last, CFG), CFG, YEAR, founders.seed_person(who, CFG, YEAR)).select("ind_id")


@query(duck(CULLED + "40", "individuals", seed=SEED))
def bottleneck_cull(spark, sf_dir):
    """The cap of a year within a bottleneck."""
    who, cfg = views.individuals(spark, sf_dir), CFG.changed(bottleneck_start=YEAR - 2, bottleneck_end=YEAR, bottleneck_size=40)
    caps = who.select("run_id").distinct().withColumn("cap", F.lit(cfg.cap(YEAR)))
    return mortality.culled(who, caps, cfg, YEAR, founders.seed_person(who, cfg, YEAR)).select("ind_id")


@query(duck(f"""SELECT ind_id FROM (SELECT ind_id, b, sum(b) OVER (ORDER BY {u('cull', 'ind_id')}, ind_id ROWS UNBOUNDED PRECEDING) AS t
    FROM (SELECT *, CAST({BREEDS} AS INTEGER) AS b FROM individuals) WHERE ind_id <> (SELECT ind_id FROM seed)) WHERE t - b < (SELECT count(CASE WHEN {BREEDS} THEN 1 END) FROM individuals) - 100""", "individuals", seed=SEED))
def breeder_cull(spark, sf_dir):
    who = views.individuals(spark, sf_dir)
    return mortality.culled_breeders(who, CFG.cap(YEAR), CFG, YEAR, founders.seed_person(who, CFG, YEAR)).select("ind_id")


# founders and the seed


@query("SELECT CAST(i AS BIGINT) AS ind_id, CAST(i % 2 AS INTEGER) AS sex, -100 AS birth_year, 900 AS lifespan, CAST(i + 1 - 2 * (i % 2) AS BIGINT) AS marriage_state, CAST(CASE WHEN i % 2 = 1 THEN -3 END AS INTEGER) AS year_of_last_birth, 0.0::DOUBLE AS lat, 0.0::DOUBLE AS lon FROM range(2) t(i)")
def founders_eden(spark, sf_dir):
    return founders.eden(spark, CFG).select("ind_id", "sex", "birth_year", "lifespan", "marriage_state", "year_of_last_birth", "lat", "lon")


@query("SELECT CAST(i AS BIGINT) AS ind_id, CAST(i % 2 AS INTEGER) AS sex, -100 AS birth_year, 650 AS lifespan, CAST(i + 1 - 2 * (i % 2) AS BIGINT) AS marriage_state, CAST(CASE WHEN i % 2 = 1 THEN -3 END AS INTEGER) AS year_of_last_birth, 0.0::DOUBLE AS lat, 0.0::DOUBLE AS lon FROM range(6) t(i)")
def founders_flood(spark, sf_dir):
    return founders.flood(spark, CFG).select("ind_id", "sex", "birth_year", "lifespan", "marriage_state", "year_of_last_birth", "lat", "lon")


COORDINATES = f"""round_even({uniform_sql('r', 'ind_id')} * 0.5 * cos({uniform_sql('theta', 'ind_id')} * (2 * pi())), 2) + 0.0 AS lat, round_even({uniform_sql('r', 'ind_id')} * 0.5 * sin({uniform_sql('theta', 'ind_id')} * (2 * pi())), 2) + 0.0 AS lon"""


@query(
    f"""WITH ages AS ({views.values(dims.age_ranges(100), 'age, low, high')})
    SELECT ind_id, CAST(floor({uniform_sql('sex0', 'ind_id')} * 2) AS INTEGER) AS sex, CAST(-age AS INTEGER) AS birth_year, 85 AS lifespan, {COORDINATES}
    FROM (SELECT CAST(i AS BIGINT) AS ind_id FROM range(100) t(i)) p JOIN ages ON {uniform_sql('age', 'ind_id')} >= low AND {uniform_sql('age', 'ind_id')} < high"""
)
def founders_default(spark, sf_dir):
    return founders.default(spark, CFG).select("ind_id", "sex", "birth_year", "lifespan", "lat", "lon")


@query(duck(f"SELECT ind_id, CAST(age AS INTEGER) AS age FROM individuals JOIN ages ON {u('age', 'ind_id')} >= low AND {u('age', 'ind_id')} < high", "individuals", ages=views.values(dims.age_ranges(20_000), "age, low, high")))
def age_cdf_sample(spark, sf_dir):
    who = views.individuals(spark, sf_dir).select("ind_id", uniform("age", F.col("ind_id"), run=F.col("run_id")).alias("u"))
    return drawn(who, "u", dims.age_ranges(20_000), "age").select("ind_id", "age")


@query(duck(f"SELECT ind_id, {COORDINATES} FROM individuals", "individuals"))
def random_coordinates(spark, sf_dir):
    lat, lon = founders.coordinates(F.col("ind_id"))
    return views.individuals(spark, sf_dir).select("ind_id", lat.alias("lat"), lon.alias("lon"))


@query(duck(SEED, "individuals"))
def seed_pick(spark, sf_dir):
    return founders.seed_person(views.individuals(spark, sf_dir), CFG, YEAR).select("ind_id")


@query(duck(f"SELECT ind_id, sex, CASE WHEN ind_id = (SELECT ind_id FROM seed) THEN repeat('1', 48) ELSE centromeres END AS centromeres, CASE WHEN ind_id = (SELECT ind_id FROM seed) AND sex = 0 THEN 0 ELSE y_gens END AS y_gens, CASE WHEN ind_id = (SELECT ind_id FROM seed) THEN 0 ELSE mt_gens END AS mt_gens, CASE WHEN ind_id = (SELECT ind_id FROM seed) THEN {2 * NUMBITS} END AS allele_count FROM individuals", "individuals", seed=SEED))
def seed_inoculation(spark, sf_dir):
    who = views.individuals(spark, sf_dir).withColumns({"allele_count": F.lit(None).cast("int"), "num_blocks": F.lit(None).cast("int"), "min_genealo_gens": F.lit(-1)})
    return founders.inoculated(who, founders.seed_person(who, CFG, YEAR), NUMBITS).select("ind_id", "sex", "centromeres", "y_gens", "mt_gens", "allele_count")


@query(duck(f"SELECT i.ind_id, count(CASE WHEN {uniform_sql('het', 'i.ind_id', 'p', run='i.run_id')} < 0.3::DOUBLE THEN 1 END) AS allele_count FROM individuals i, range({NUMBITS}) t(p) GROUP BY i.ind_id", "individuals"))
def init_heterozygosity(spark, sf_dir):
    made = founders.heterozygous(views.individuals(spark, sf_dir), CFG.changed(init_heterozygosity=0.3), NUMBITS)
    return genome.allele_counts(made).select("ind_id", F.col("allele_count").cast("bigint").alias("allele_count"))


# genomes


@query(f"SELECT chrom, arm, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length FROM ({views.DUCK['arms']})")
def arm_scan(spark, sf_dir):
    return dims.arms(spark)


@query(f"SELECT CAST(sum(length) AS BIGINT) AS genome_size FROM ({views.DUCK['arms']})")
def genome_size(spark, sf_dir):
    return dims.arms(spark).agg(F.sum("length").alias("genome_size"))


@query(duck("SELECT child_id, role, CAST(chrom AS INTEGER) AS chrom, ploc, qloc, coin, lo, hi FROM crossed", "individuals", "chromosomes", **TO_CROSS))
def crossovers(spark, sf_dir):
    return cross(spark, sf_dir).select("child_id", "role", "chrom", "ploc", "qloc", "coin", "lo", "hi")


MASK_SEG = "CASE WHEN role = 'dad' AND chrom = 23 THEN repeat('0', plen + qlen) ELSE repeat(CAST(1 - coin AS VARCHAR), ploc) || repeat(CAST(coin AS VARCHAR), plen - ploc + qloc) || repeat(CAST(1 - coin AS VARCHAR), qlen - qloc) END"


@query(duck(f"SELECT child_id, role, string_agg({MASK_SEG}, '' ORDER BY chrom) AS mask FROM crossed GROUP BY ALL", "individuals", "chromosomes", **TO_CROSS))
def mask_string(spark, sf_dir):
    return genome.mask_strings(cross(spark, sf_dir)).select("child_id", "role", "mask")


SPLICED = """SELECT child_id AS ind_id, CAST(CASE role WHEN 'dad' THEN 0 ELSE 1 END AS INTEGER) AS copy, string_agg(CASE WHEN role = 'dad' AND chrom = 23 THEN substr(b, pstart + 1, plen + qlen) ELSE
        substr(CASE coin WHEN 1 THEN b ELSE a END, pstart + 1, ploc) || substr(CASE coin WHEN 1 THEN a ELSE b END, lo + 1, hi - lo) || substr(CASE coin WHEN 1 THEN b ELSE a END, hi + 1, qstart + qlen - hi) END, '' ORDER BY chrom) AS bits
        FROM crossed c JOIN (SELECT ind_id, max(CASE copy WHEN 0 THEN bits END) AS a, max(CASE copy WHEN 1 THEN bits END) AS b FROM haplotypes GROUP BY ind_id) h ON h.ind_id = c.parent GROUP BY ALL"""


@query(duck(SPLICED, "individuals", "haplotypes", "chromosomes", **TO_CROSS))
def meiosis_splice(spark, sf_dir):
    return genome.meiosis(cross(spark, sf_dir), views.haplotypes(spark, sf_dir), NUMBITS).select("ind_id", "copy", "bits")


def words_sql(table: str) -> str:
    """DuckDB SQL of the words of a table of strings of bits: a row a word that has a bit."""
    word = f"list_reduce(list_transform(string_split(rpad(substr(bits, w * {genome.WORD} + 1, {genome.WORD}), {genome.WORD}, '0'), ''), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 2 + b)"
    return f"SELECT * FROM (SELECT ind_id, copy, CAST(w AS INTEGER) AS word, CAST({word} AS BIGINT) AS bits FROM {table}, range({packed.word_count(NUMBITS)}) t(w)) WHERE bits <> 0"


@query(duck(words_sql("spliced"), "individuals", "haplotypes", "chromosomes", **TO_CROSS, spliced=SPLICED))
def meiosis_words(spark, sf_dir):
    made = packed.meiosis(cross(spark, sf_dir), views.packed_haplotypes(spark, sf_dir), NUMBITS)
    return packed.by_word(made).select("ind_id", "copy", "word", "bits")


@query(
    duck(
        """SELECT child_id, '00' || string_agg(substr(centromeres, CAST(2 * chrom + (1 - coin) + 1 AS BIGINT), 1), '' ORDER BY chrom, role) AS centromeres
        FROM crossed c JOIN individuals i ON i.ind_id = c.parent GROUP BY child_id""",
        "individuals",
        "chromosomes",
        **TO_CROSS,
    )
)
def centromere_inherit(spark, sf_dir):
    return genome.centromeres(cross(spark, sf_dir), views.individuals(spark, sf_dir)).select("child_id", "centromeres")


@query(
    duck(
        """SELECT c.child_id AS ind_id, CAST(CASE role WHEN 'dad' THEN 0 ELSE 1 END AS INTEGER) AS copy, m.position, m.effect FROM mutations m
        JOIN crossed c ON c.parent = m.ind_id AND m.position >= pstart AND m.position < qstart + qlen
        WHERE m.copy = CASE WHEN role = 'dad' AND chrom = 23 THEN 0 WHEN (m.position >= lo AND m.position < hi) = (coin = 1) THEN 1 ELSE 0 END""",
        "individuals",
        "mutations",
        "chromosomes",
        **TO_CROSS,
    )
)
def mutation_inherit(spark, sf_dir):
    return genome.inherited_mutations(views.mutations(spark, sf_dir), cross(spark, sf_dir), CFG).select("ind_id", "copy", "position", "effect")


POISSON_SQL = f"len(list_filter([{', '.join(f'{c!r}::DOUBLE' for c in poisson_table(1.0))}], lambda c: c <= {uniform_sql('npois', 'ind_id', run='run_id')}))"


@query(duck(f"SELECT ind_id, CAST({POISSON_SQL} AS INTEGER) AS k FROM individuals", "individuals"))
def poisson_draws(spark, sf_dir):
    draws = views.individuals(spark, sf_dir).select("ind_id", uniform("npois", F.col("ind_id"), run=F.col("run_id")).alias("u"))
    return poisson_drawn(draws, "u", CFG.mu, "k").select("ind_id", "k")


# the sums of a large mean as a table: the number drawn is how many of them are at or below u
LARGE_MEAN = 5000.0
LARGE_SUMS = f"SELECT unnest(range(1, {len(poisson_table(LARGE_MEAN)) + 1})) AS k, unnest([{', '.join(f'{c!r}::DOUBLE' for c in poisson_table(LARGE_MEAN))}]) AS c"


@query(duck(f"SELECT o_orderkey, CAST(coalesce(k, 0) AS INTEGER) AS k FROM (SELECT o_orderkey, {uniform_sql('npois', 'o_orderkey')} AS u FROM orders) d ASOF LEFT JOIN (SELECT max(k) AS k, c FROM sums GROUP BY c) s ON d.u >= s.c", sums=LARGE_SUMS))
def poisson_large_mean(spark, sf_dir):
    draws = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", uniform("npois", F.col("o_orderkey")).alias("u"))
    return poisson_drawn(draws, "u", LARGE_MEAN, "k").select("o_orderkey", "k")


@query(f"""WITH w AS (SELECT n_nationkey AS nation, c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS w FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE round(c_acctbal * 100) > 0),
    s AS (SELECT *, CAST(sum(w) OVER (PARTITION BY nation ORDER BY {uniform_sql('guide', 'c_custkey')}, c_custkey) - w AS BIGINT) AS low, CAST(sum(w) OVER (PARTITION BY nation) AS BIGINT) AS total FROM w),
    d AS (SELECT o_orderkey, CAST(o_orderkey % 25 AS INTEGER) AS nation, {uniform_sql('pick', 'o_orderkey')} AS u FROM orders),
    t AS (SELECT d.*, CAST(floor(u * total) AS BIGINT) AS ticket FROM d JOIN (SELECT DISTINCT nation, total FROM s) n USING (nation))
    SELECT o_orderkey, t.nation, s.c_custkey FROM t ASOF JOIN s ON t.nation = s.nation AND t.ticket >= s.low""")
def weighted_choice(spark, sf_dir):
    """For each order a customer of one nation, each with a chance in proportion to the balance."""
    weights = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    draws = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 25).cast("int").alias("nation"), uniform("pick", F.col("o_orderkey")).alias("u"))
    table, totals = guide(weights, "c_custkey", "cents", ["nation"])
    return chosen(draws, table, totals, "u", ["nation"]).select("o_orderkey", "nation", "c_custkey")


def effect_sql(*keys: str) -> str:
    w = f"0.05::DOUBLE * pow(-ln(1 - {u('weib', *keys)}), 1.0::DOUBLE)"
    return f"CASE WHEN {u('neutral', *keys)} < 0.5 THEN 0 ELSE CAST(trunc((CASE WHEN {u('sign', *keys)} <= 0.0001::DOUBLE THEN {w} ELSE -({w}) END) * 1000) AS INTEGER) END"


@query(duck(f"SELECT ind_id, {effect_sql('ind_id')} AS effect FROM individuals", "individuals"))
def weibull_effect(spark, sf_dir):
    d = lambda draw: uniform(draw, F.col("ind_id"), run=F.col("run_id"))
    return views.individuals(spark, sf_dir).select("ind_id", genome.effect(CFG, d("neutral"), d("weib"), d("sign")).alias("effect"))


@query(
    duck(
        f"SELECT child_id AS ind_id, CAST(floor({u('mcopy', 'child_id', 'j')} * 2) AS INTEGER) AS copy, CAST(floor({u('pos', 'child_id', 'j')} * {NUMBITS}) AS INTEGER) AS position, {effect_sql('child_id', 'j')} AS effect FROM new",
        "individuals",
        **TO_BIRTHS,
        new=f"SELECT run_id, child_id, unnest(range(1, {POISSON_SQL.replace('ind_id', 'child_id')} + 1)) AS j FROM births",
    )
)
def poisson_new_mutations(spark, sf_dir):
    return genome.new_mutations(births(spark, sf_dir), CFG, YEAR, NUMBITS).select("ind_id", "copy", "position", "effect")


@query(duck("SELECT ind_id, CAST(sum(length(replace(bits, '0', ''))) AS INTEGER) AS allele_count, CAST(sum(len(regexp_extract_all(bits, '1+'))) AS INTEGER) AS num_blocks FROM haplotypes GROUP BY ind_id", "haplotypes"))
def allele_count(spark, sf_dir):
    return genome.allele_counts(views.haplotypes(spark, sf_dir)).select("ind_id", "allele_count", "num_blocks")


@query(ORACLE_SQL["allele_count"])
def allele_count_words(spark, sf_dir):
    return packed.allele_counts(views.packed_haplotypes(spark, sf_dir)).select("ind_id", "allele_count", "num_blocks")


@query(duck("SELECT ind_id, copy, CAST(n AS INTEGER) AS length FROM lengths", "haplotypes", lengths=LENGTHS))
def blocks_regex(spark, sf_dir):
    return genome.blocks(views.haplotypes(spark, sf_dir)).select("ind_id", "copy", "length")


@query(
    duck(
        """SELECT ind_id, copy, CAST(min(p) - 1 AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS length FROM (
        SELECT ind_id, copy, p, p - row_number() OVER (PARTITION BY ind_id, copy ORDER BY p) AS island FROM (SELECT ind_id, copy, unnest(range(1, length(bits) + 1)) AS p, bits FROM haplotypes) WHERE substr(bits, p, 1) = '1') GROUP BY ind_id, copy, island""",
        "haplotypes",
    )
)
def blocks_islands(spark, sf_dir):
    return genome.islands(views.haplotypes(spark, sf_dir)).select("ind_id", "copy", "start", "length")


@query(ORACLE_SQL["blocks_islands"])
def blocks_islands_words(spark, sf_dir):
    return packed.islands(views.packed_haplotypes(spark, sf_dir)).select("ind_id", "copy", "start", "length")


@query(
    duck(
        """SELECT count(*) AS tot_blocks, max(m) AS av_block_size, round_even(sqrt(round_even(CAST(sum(n * n) AS DOUBLE) / count(*) - 2 * max(m) * CAST(sum(n) AS DOUBLE) / count(*) + max(m) * max(m), 2)), 1) AS sd_block_size
        FROM lengths, (SELECT round_even(CAST(sum(n) AS DOUBLE) / count(*), 1) AS m FROM lengths)""",
        "haplotypes",
        lengths=LENGTHS,
    )
)
def block_stats(spark, sf_dir):
    return statistics.block_stats(views.haplotypes(spark, sf_dir)).select("tot_blocks", "av_block_size", "sd_block_size")


@query(ORACLE_SQL["block_stats"])
def block_stats_words(spark, sf_dir):
    return packed.block_stats(views.packed_haplotypes(spark, sf_dir)).select("tot_blocks", "av_block_size", "sd_block_size")


@query(
    duck(
        "SELECT ind_id, copy, CAST(length(unnest(regexp_extract_all(substr(bits, CAST(start + 1 AS BIGINT), CAST(length AS BIGINT)), '1+'))) AS INTEGER) AS length FROM haplotypes CROSS JOIN arms",
        "haplotypes",
        "arms",
    )
)
def blocks_by_arm(spark, sf_dir):
    return genome.blocks(views.haplotypes(spark, sf_dir), dims.arms(spark)).select("ind_id", "copy", "length")


@query(ORACLE_SQL["blocks_by_arm"])
def blocks_by_arm_words(spark, sf_dir):
    return packed.islands(views.packed_haplotypes(spark, sf_dir), [start for _, _, start, _ in dims.arm_rows()]).select("ind_id", "copy", "length")


COUNTS = "SELECT p - 1 AS position, count(*) AS n FROM (SELECT unnest(range(1, length(bits) + 1)) AS p, bits FROM haplotypes) WHERE substr(bits, p, 1) = '1' GROUP BY ALL"


@query(duck("SELECT CAST(position AS INTEGER) AS position, n FROM counts", "haplotypes", counts=COUNTS))
def position_counts(spark, sf_dir):
    return statistics.position_counts(views.haplotypes(spark, sf_dir)).select("position", "n")


@query(duck(f"SELECT count(*) AS retained, round(count(*) / {NUMBITS}::DOUBLE * 100, 9) AS perc_seed_genome, round(CAST(sum(n) AS DOUBLE) / (count(*) * {NUMBITS}), 9) AS av_coverage FROM counts", "haplotypes", counts=COUNTS))
def seed_retained(spark, sf_dir):
    return statistics.coverage(views.haplotypes(spark, sf_dir), NUMBITS).select("retained", F.round("perc_seed_genome", 9).alias("perc_seed_genome"), F.round("av_coverage", 9).alias("av_coverage"))


@query(ORACLE_SQL["position_counts"])
def position_counts_words(spark, sf_dir):
    return packed.position_counts(views.packed_haplotypes(spark, sf_dir)).select(F.col("position").cast("int").alias("position"), "n")


@query(ORACLE_SQL["seed_retained"])
def seed_retained_words(spark, sf_dir):
    return packed.retained(views.packed_haplotypes(spark, sf_dir), NUMBITS).select("retained", F.round("perc_seed_genome", 9).alias("perc_seed_genome"), F.round("av_coverage", 9).alias("av_coverage"))


@query(
    duck(
        f"""SELECT CAST(sum(d) AS BIGINT) AS het, round(CAST(sum(d) AS DOUBLE) / ({NUMBITS}::BIGINT * (SELECT count(*) FROM individuals)) * 100, 9) AS av_heterozygosity FROM (
        SELECT len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda x: x[1] <> x[2])) AS d FROM (SELECT ind_id, max(CASE copy WHEN 0 THEN bits END) AS a, max(CASE copy WHEN 1 THEN bits END) AS b FROM haplotypes GROUP BY ind_id))""",
        "individuals",
        "haplotypes",
    )
)
def heterozygosity(spark, sf_dir):
    sizes = views.individuals(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"))
    return statistics.heterozygosity(views.haplotypes(spark, sf_dir), sizes, NUMBITS).select(F.col("het").cast("bigint").alias("het"), F.round("av_heterozygosity", 9).alias("av_heterozygosity"))


@query(ORACLE_SQL["heterozygosity"])
def heterozygosity_words(spark, sf_dir):
    sizes = views.individuals(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"))
    return packed.heterozygosity(views.packed_haplotypes(spark, sf_dir), sizes, NUMBITS).select("het", F.round("av_heterozygosity", 9).alias("av_heterozygosity"))


def with_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.individuals(spark, sf_dir).join(genome.allele_counts(views.haplotypes(spark, sf_dir)), ["run_id", "ind_id"], "left")


@query(
    duck(
        """SELECT count(*) AS numinds, count(CASE WHEN y_gens > 0 THEN 1 END) AS Y_descends, count(CASE WHEN mt_gens > 0 THEN 1 END) AS mt_descends, count(CASE WHEN max_genealo_gens > 0 THEN 1 END) AS genealo_descends, count(CASE WHEN allele_count > 0 THEN 1 END) AS genetic_descends,
        count(CASE WHEN num_blocks > 0 THEN 1 END) AS inds_with_blocks, CAST(sum(length(replace(centromeres, '0', ''))) AS BIGINT) AS num_centromeres FROM dna""",
        "individuals",
        "haplotypes",
        dna=PEOPLE_DNA,
    )
)
def misc_descendant_stats(spark, sf_dir):
    return statistics.descendants(with_dna(spark, sf_dir)).drop("run_id")


# mutations and fitness


@query(duck("SELECT ind_id, mutations, round(fitness, 9) AS fitness FROM fit", "mutations", fit=FITNESS))
def fitness_running(spark, sf_dir):
    return genome.fitness(views.mutations(spark, sf_dir)).select("ind_id", "mutations", F.round("fitness", 9).alias("fitness"))


@query(duck("SELECT ind_id, CAST(count(*) AS INTEGER) AS mutations, round(1 + sum(effect) / 1000.0::DOUBLE, 9) AS fitness FROM mutations GROUP BY ind_id", "mutations"))
def fitness_additive(spark, sf_dir):
    return genome.fitness(views.mutations(spark, sf_dir), "additive").select("ind_id", "mutations", F.round("fitness", 9).alias("fitness"))


def with_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.mutations(spark, sf_dir).groupBy("run_id", "ind_id").agg(F.count("*").cast("int").alias("mutations"))
    return views.individuals(spark, sf_dir).join(n, ["run_id", "ind_id"], "left")


@query(
    duck(
        f"""SELECT round(sum(fitness) / count(*), 9) AS av_ind_fitness, round(sum(fitness) / ({NUMBITS} * count(*) * 2), 9) AS av_bin_fitness, (SELECT count(*) FROM mutations m JOIN individuals i ON i.ind_id = m.ind_id) AS num_mutations,
        round((SELECT count(*) FROM mutations m JOIN individuals i ON i.ind_id = m.ind_id)::DOUBLE / count(*), 9) AS av_mutations_per_ind,
        round((SELECT count(*) FROM mutations m JOIN individuals i ON i.ind_id = m.ind_id)::DOUBLE / (count(*) * {NUMBITS} * 2), 9) AS av_mutations_per_bin FROM individuals""",
        "individuals",
        "mutations",
    )
)
def fitness_stats(spark, sf_dir):
    f = statistics.fitness_stats(with_mutations(spark, sf_dir), NUMBITS)
    return f.select(*[F.round(c, 9).alias(c) for c in ("av_ind_fitness", "av_bin_fitness")], "num_mutations", *[F.round(c, 9).alias(c) for c in ("av_mutations_per_ind", "av_mutations_per_bin")])


@query(duck("SELECT ind_id, copy, position, round(1 + sum(effect) / 1000.0::DOUBLE, 9) AS fitness, count(*) AS num FROM mutations GROUP BY ind_id, copy, position", "mutations"))
def bin_fitness(spark, sf_dir):
    return genome.bin_fitness(views.mutations(spark, sf_dir)).select("ind_id", "copy", "position", F.round("fitness", 9).alias("fitness"), "num")


@query(duck("SELECT effect, count(*) AS n FROM mutations GROUP BY effect", "mutations"))
def hist_circulating(spark, sf_dir):
    return views.mutations(spark, sf_dir).groupBy("effect").agg(F.count("*").alias("n"))


@query(
    duck(
        """SELECT CAST(b AS INTEGER) AS bin, (SELECT count(*) FROM mutations m WHERE m.effect = b) AS all_mutations, (SELECT count(*) FROM mutations m WHERE m.effect = b AND ind_id NOT IN (SELECT ind_id FROM dead)) AS circulating_mutations
        FROM range(-1000, 1001) t(b)""",
        "individuals",
        "actuarial",
        "mutations",
        **TO_DEAD,
    )
)
def hist_all_zero_filled(spark, sf_dir):
    ever = views.mutations(spark, sf_dir)
    return statistics.histogram(ever, mortality.without(ever, dead(spark, sf_dir))).select("bin", "all_mutations", "circulating_mutations")


# of 100 years before this one, in save intervals of 25: a person's mutations are new in that of the birth, and gone one to three intervals later with the death
BORN = "CAST(ceil((birth_year + 99) / 25.0) AS INTEGER)"
GONE = f"CASE WHEN d.ind_id IS NOT NULL THEN {BORN} + 1 + CAST(i.ind_id % 3 AS INTEGER) END"


@query(
    duck(
        """SELECT k AS interval, effect AS bin, count(*) AS all_mutations, count(CASE WHEN gone IS NULL OR gone > k THEN 1 END) AS circulating_mutations
        FROM lives JOIN (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS k) ON born <= k GROUP BY ALL""",
        "individuals",
        "actuarial",
        "mutations",
        **TO_DEAD,
        lives=f"SELECT m.effect, {BORN} AS born, {GONE} AS gone FROM mutations m JOIN individuals i ON i.ind_id = m.ind_id LEFT JOIN dead d ON d.ind_id = i.ind_id",
    )
)
def hist_by_interval(spark, sf_dir):
    """Both histograms at the end of each save interval, from changes that are stored interval by interval (one of them twice) and merged."""
    who = views.individuals(spark, sf_dir)
    fate = who.join(dead(spark, sf_dir).select("run_id", "ind_id", F.lit(True).alias("dies")), ["run_id", "ind_id"], "left")
    born = F.ceil((F.col("birth_year") + 99) / 25).cast("int")
    lives = views.mutations(spark, sf_dir).join(fate.select("run_id", "ind_id", born.alias("born"), F.when(F.col("dies"), born + 1 + (F.col("ind_id") % 3).cast("int")).alias("gone")), ["run_id", "ind_id"])
    # all mutations are read and joined once: a row an effect and pair of intervals is left
    lives = checkpointer(spark)(lives.groupBy("run_id", "effect", "born", "gone").agg(F.count("*").alias("n")))
    path = f"{shared_dir(spark)}/histogram-{uuid.uuid4().hex}"
    for k in [*range(8), 3]:
        change = statistics.histogram_change(lives.filter(F.col("born") == k), lives.filter(F.col("gone") == k), k, "n").withColumnRenamed("interval", "year")
        logs.write_log(change, who.select("run_id", F.lit(k).alias("year")).distinct(), path)
    changes = logs.read_log(spark, path).withColumnRenamed("year", "interval")
    # every interval is reported, also one in which nothing changed
    every = who.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("interval")).distinct()
    none = every.join(changes.select("run_id", "bin").distinct(), "run_id").select("run_id", "interval", "bin", F.lit(0).cast("long").alias("born"), F.lit(0).cast("long").alias("died"))
    return statistics.histograms(changes.unionByName(none)).filter("all_mutations > 0").select("interval", "bin", "all_mutations", "circulating_mutations")


# reports


@query(duck("SELECT sim_year AS year, kind, count(*) AS n FROM yearly_events GROUP BY ALL", "yearly_events"))
def log_rewritten(spark, sf_dir):
    """A log of events in which some years were written wrongly first, and one year has no rows any more of those it had."""
    events = views.yearly_events(spark, sf_dir).withColumnRenamed("sim_year", "year")
    rows = events.groupBy("run_id", "year", "kind").agg(F.count("*").alias("n"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    wrong = rows.withColumn("n", F.col("n") + 1).unionByName(rows.filter("year = 0").withColumn("year", F.lit(50)))
    logs.write_log(wrong, wrong.select("run_id", "year"), path)
    years = rows.select("run_id", "year").unionByName(rows.select("run_id", F.lit(50).alias("year")))
    logs.write_log(rows, years, path)
    return logs.read_log(spark, path).select("year", "kind", "n")


@query(duck("SELECT CAST(ceil(sim_year / 3.0) AS INTEGER) AS interval, count(CASE WHEN kind = 'marriage' THEN 1 END) AS marriages, count(CASE WHEN kind = 'birth' THEN 1 END) AS births, count(CASE WHEN kind = 'random_death' THEN 1 END) AS random_deaths, count(CASE WHEN kind = 'cull_death' THEN 1 END) AS cull_deaths FROM yearly_events GROUP BY 1", "yearly_events"))
def interval_tracking(spark, sf_dir):
    return statistics.interval_counts(views.yearly_events(spark, sf_dir), 3).select("interval", "marriages", "births", "random_deaths", "cull_deaths")


MARKS = """SELECT x, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY chrom DESC, o DESC) AS n FROM (
    SELECT chrom, 0 AS o, unnest(range(pstart, pstart + 3)) AS x, 0 AS r, 255 AS g, 0 AS b FROM chromosomes UNION ALL SELECT chrom, 1, unnest(range(qstart - 3, qstart + 3)), 0, 0, 255 FROM chromosomes
    UNION ALL SELECT chrom, 2, unnest(range(qstart + qlen - 4, qstart + qlen - 1)), 0, 255, 0 FROM chromosomes UNION ALL SELECT chrom, 3, qstart + qlen - 1, 0, 0, 0 FROM chromosomes)) WHERE n = 1"""


@query(duck("SELECT CAST(x AS INTEGER) AS x, r, g, b FROM marks", "chromosomes", marks=MARKS))
def genome_ruler_pixels(spark, sf_dir):
    return report.ruler(dims.arms(spark)).select("x", "r", "g", "b")


@query(duck(f"SELECT i.ind_id, CAST(c.copy AS INTEGER) AS copy, coalesce(h.bits, repeat('0', {NUMBITS})) AS bits FROM individuals i CROSS JOIN (SELECT unnest([0, 1]) AS copy) c LEFT JOIN haplotypes h ON h.ind_id = i.ind_id AND h.copy = c.copy", "individuals", "haplotypes"))
def genome_map_pixels(spark, sf_dir):
    return report.genome_rows(views.individuals(spark, sf_dir), views.haplotypes(spark, sf_dir), NUMBITS).select("ind_id", "copy", "bits")


@query(duck("SELECT ind_id, copy, position, CASE WHEN t > 0 THEN 0 ELSE 255 END AS r, CASE WHEN t >= 0 THEN 255 ELSE 0 END AS g, CASE WHEN t = 0 THEN 255 ELSE 0 END AS b FROM (SELECT ind_id, copy, position, sum(effect) AS t FROM mutations GROUP BY ALL)", "mutations"))
def mutation_map_pixels(spark, sf_dir):
    return report.mutation_pixels(views.mutations(spark, sf_dir)).select("ind_id", "copy", "position", "r", "g", "b")


@query(
    duck(
        """SELECT ind_id AS ID, birth_year AS birthyear, 0 AS deathyear, sex, dad AS father, mom AS mother, lifespan, lat, lon, marriage_state AS married, -1 AS numbirths, y_gens AS Ygens, mt_gens AS MTgens,
        max_genealo_gens AS MaxGenealGens, CAST(length(replace(centromeres, '0', '')) AS INTEGER) AS CentromereCount, fitness, 'r' AS CauseOfDeath FROM individuals WHERE ind_id IN (SELECT ind_id FROM dead)""",
        "individuals",
        "actuarial",
        **TO_DEAD,
    )
)
def deaths_log_row(spark, sf_dir):
    gone = views.individuals(spark, sf_dir).join(dead(spark, sf_dir), ["run_id", "ind_id"]).withColumn("year", F.lit(YEAR))
    return sinks.death_rows(gone).select("ID", "birthyear", "deathyear", "sex", "father", "mother", "lifespan", "lat", "lon", "married", "numbirths", "Ygens", "MTgens", "MaxGenealGens", "CentromereCount", "fitness", "CauseOfDeath")


@query(duck("SELECT ind_id AS ID, birth_year AS birthyear, 7 AS deathyear, '-1' AS CauseOfDeath FROM individuals ORDER BY ind_id", "individuals"))
def survivors_sorted(spark, sf_dir):
    return sinks.survivor_rows(views.individuals(spark, sf_dir), 7).select("ID", "birthyear", "deathyear", "CauseOfDeath")


@query(
    duck(
        """SELECT i.ind_id, CAST(c.copy AS INTEGER) AS copy, count(CASE WHEN m.t > 0 THEN 1 END) AS better, count(CASE WHEN m.t = 0 THEN 1 END) AS neutral, count(CASE WHEN m.t < 0 THEN 1 END) AS worse, CAST(min(m.position) AS INTEGER) AS first_bin
        FROM individuals i CROSS JOIN (SELECT unnest([0, 1]) AS copy) c LEFT JOIN (SELECT ind_id, copy, position, sum(effect) AS t FROM mutations GROUP BY ALL) m ON m.ind_id = i.ind_id AND m.copy = c.copy GROUP BY ALL""",
        "individuals",
        "mutations",
    )
)
def mutation_map_rows(spark, sf_dir):
    rows = report.mutation_rows(views.individuals(spark, sf_dir), views.mutations(spark, sf_dir))
    of = lambda r, g: F.size(F.filter("spots", lambda p: (p["r"] == r) & (p["g"] == g))).cast("bigint")
    return rows.select("ind_id", "copy", of(0, 255).alias("better"), of(255, 255).alias("neutral"), of(255, 0).alias("worse"), F.get("spots", F.lit(0))["position"].alias("first_bin"))


@query(
    duck(
        """SELECT ind_id AS ID, birth_year AS birthyear, CASE WHEN ind_id IN (SELECT ind_id FROM dead) THEN 0 ELSE 7 END AS deathyear, CASE WHEN ind_id IN (SELECT ind_id FROM dead) THEN 'r' ELSE '-1' END AS CauseOfDeath FROM individuals""",
        "individuals",
        "actuarial",
        **TO_DEAD,
    )
)
def deaths_with_survivors(spark, sf_dir):
    who, gone = views.individuals(spark, sf_dir), dead(spark, sf_dir)
    log = sinks.log_rows(who.join(gone, ["run_id", "ind_id"]).withColumn("year", F.lit(YEAR)), mortality.without(who, gone), 7)
    return log.select("ID", "birthyear", "deathyear", "CauseOfDeath")


MUTATED = "(SELECT count(*) FROM mutations m JOIN individuals i ON i.ind_id = m.ind_id)::DOUBLE"
SIZE = "(SELECT count(*) FROM individuals)::DOUBLE"
EVENT = "(SELECT count(*) FROM yearly_events WHERE sim_year = 0 AND kind = '{}')::DOUBLE AS {}s"
ROW = f"""SELECT 0 AS run, 0 AS year, {SIZE} AS numinds, {', '.join(EVENT.format(k, k) for k in ('marriage', 'birth', 'random_death', 'cull_death'))},
    (SELECT count(CASE WHEN allele_count > 0 THEN 1 END) FROM dna)::DOUBLE AS genetic_descends, (SELECT count(CASE WHEN max_genealo_gens > 0 THEN 1 END) FROM dna)::DOUBLE AS genealo_descends,
    (SELECT count(CASE WHEN y_gens > 0 THEN 1 END) FROM dna)::DOUBLE AS Y_descends, (SELECT count(CASE WHEN mt_gens > 0 THEN 1 END) FROM dna)::DOUBLE AS mt_descends,
    (SELECT sum(length(replace(centromeres, '0', ''))) FROM dna)::DOUBLE AS num_centromeres, (SELECT count(*) FROM lengths)::DOUBLE AS tot_blocks, (SELECT m FROM mean_length) AS av_block_size,
    (SELECT round_even(sqrt(round_even(CAST(sum(n * n) AS DOUBLE) / count(*) - 2 * max(m) * CAST(sum(n) AS DOUBLE) / count(*) + max(m) * max(m), 2)), 1) FROM lengths, mean_length) AS sd_block_size,
    (SELECT sum(fitness) / count(*) FROM individuals) AS av_ind_fitness, (SELECT sum(fitness) / ({NUMBITS} * count(*) * 2) FROM individuals) AS av_bin_fitness, {MUTATED} AS num_mutations,
    {MUTATED} / {SIZE} AS av_mutations_per_ind, {MUTATED} / ({SIZE} * {NUMBITS} * 2) AS av_mutations_per_bin, (SELECT count(*) / {NUMBITS}::DOUBLE * 100 FROM counts) AS perc_seed_genome_retained,
    (SELECT CAST(sum(n) AS DOUBLE) / (count(*) * {NUMBITS}) FROM counts) AS av_seed_genome_coverage, (SELECT CAST(sum(d) AS DOUBLE) FROM differ) / ({NUMBITS}::BIGINT * {SIZE}) * 100 AS av_heterozygosity"""
TO_ROW = {
    "dna": PEOPLE_DNA,
    "lengths": LENGTHS,
    "mean_length": "SELECT round_even(CAST(sum(n) AS DOUBLE) / count(*), 1) AS m FROM lengths",
    "counts": COUNTS,
    "differ": "SELECT len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda x: x[1] <> x[2])) AS d FROM (SELECT ind_id, max(CASE copy WHEN 0 THEN bits END) AS a, max(CASE copy WHEN 1 THEN bits END) AS b FROM haplotypes GROUP BY ind_id)",
    "one_row": ROW,
}
ROW_VIEWS = ("individuals", "haplotypes", "mutations", "yearly_events")


def one_row(spark: SparkSession, sf_dir: str, words: bool = False) -> DataFrame:
    from types import SimpleNamespace

    sizes = views.individuals(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"))
    held = views.packed_haplotypes(spark, sf_dir) if words else views.haplotypes(spark, sf_dir)
    state = SimpleNamespace(people=with_mutations(spark, sf_dir), haplotypes=held, sizes=sizes)
    return report.results_row(state, views.yearly_events(spark, sf_dir), CFG.changed(track_DNA=True, track_mutations=True), YEAR)


@query(duck("SELECT run, year, %s FROM one_row" % ", ".join(f"round({c}, 9) AS {c}" for c in report.RESULTS[2:]), *ROW_VIEWS, **TO_ROW))
def results_row(spark, sf_dir):
    return one_row(spark, sf_dir).select("run", "year", *[F.round(c, 9).alias(c) for c in report.RESULTS[2:]])


@query(ORACLE_SQL["results_row"])
def results_row_words(spark, sf_dir):
    """The same from packed haplotypes, without any string of bits."""
    return one_row(spark, sf_dir, True).select("run", "year", *[F.round(c, 9).alias(c) for c in report.RESULTS[2:]])


@query(duck("SELECT run, year, %s FROM one_row" % ", ".join(f"format('{{:.1f}}', round_even({c}, 1)) AS {c}" for c in report.ONE_DECIMAL), *ROW_VIEWS, **TO_ROW))
def results_printed(spark, sf_dir):
    return report.printed(one_row(spark, sf_dir)).select("run", "year", *report.ONE_DECIMAL)


@query(duck("SELECT year, numinds, lag(numinds) OVER (ORDER BY year) AS last_numinds FROM (SELECT y.year, count(*) AS numinds FROM (SELECT DISTINCT birth_year AS year FROM individuals) y JOIN individuals i ON i.birth_year <= y.year GROUP BY 1)", "individuals"))
def population_lag(spark, sf_dir):
    """The number of people born up to each year, with that of the year before."""
    born = views.individuals(spark, sf_dir).groupBy(F.col("run_id").alias("run"), F.col("birth_year").alias("year")).agg(F.count("*").alias("n"))  # a row a year
    sizes = born.select("run", "year", F.sum("n").over(Window.partitionBy("run").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)).alias("numinds"))
    return statistics.with_last_size(sizes).select("year", "numinds", "last_numinds")


@query(duck("SELECT CAST(interval AS INTEGER) AS interval, variable, value FROM (SELECT CAST(ceil(sim_year / 3.0) AS INTEGER) AS interval, count(CASE WHEN kind = 'marriage' THEN 1 END) AS marriages, count(CASE WHEN kind = 'birth' THEN 1 END) AS births FROM yearly_events GROUP BY 1) UNPIVOT (value FOR variable IN (marriages, births))", "yearly_events"))
def plot_series(spark, sf_dir):
    counts = statistics.interval_counts(views.yearly_events(spark, sf_dir), 3).select(F.lit(0).alias("run"), F.col("interval").alias("year"), "marriages", "births")
    return report.series(counts, ["marriages", "births"]).select(F.col("year").alias("interval"), "variable", "value")
