"""Small golden cases, invariants of a run, and every query against its SQL."""

import itertools
import math
import re
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from kinfold import queries as q
from kinfold.config import Config
from kinfold.functions.choice import chosen, guide, guided, poisson_drawn, poisson_ranges
from kinfold.functions.ranking import ranked, running_sum
from kinfold.functions.rng import poisson_table
from kinfold.functions.selection import lowest
from kinfold.operators import genome, mating, mortality, packed, pedigree, people, statistics
from kinfold.plans import logs, sinks
from kinfold.plans.state import checkpointer
from kinfold.sources import dims, founders
from kinfold.streaming.intervals import interval_stream

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem nation".split()


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(q.ORACLE_SQL[name])
    cols = sorted(want.columns)
    got = q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert plain(got.select(cols).collect()) == plain(want.select(*[f'"{x}"' for x in cols]).fetchall())


def haplotypes(spark, *bits):
    return spark.createDataFrame([(0, i, k, b) for i, pair in enumerate(bits) for k, b in enumerate(pair)], "run_id int, ind_id bigint, copy int, bits string")


def test_blocks_of_edge_cases(spark):
    h = haplotypes(spark, ("0000000000", "1111000000"), ("0110111001", "0000000000"))
    assert sorted(r["length"] for r in genome.blocks(h).collect()) == [1, 2, 3, 4]
    assert sorted(map(tuple, genome.islands(h).select("ind_id", "start", "length").collect())) == [(0, 0, 4), (1, 1, 2), (1, 4, 3), (1, 9, 1)]
    none = statistics.block_stats(haplotypes(spark, ("0000", "0000"))).first()
    assert (none["tot_blocks"], none["av_block_size"], none["sd_block_size"]) == (0, 0.0, 0.0)


def test_seed_alone(spark):
    n = dims.genome_size()
    assert n == 3046
    h = founders.seed_haplotypes(spark.createDataFrame([(0, 5)], "run_id int, ind_id bigint"), n)
    b = statistics.block_stats(h).first()
    assert (b["tot_blocks"], b["av_block_size"], b["sd_block_size"]) == (2, 3046.0, 0.0)
    c = statistics.coverage(h, n).first()
    assert (c["perc_seed_genome"], c["av_coverage"]) == (100.0, pytest.approx(2 / n))
    assert statistics.heterozygosity(h, spark.createDataFrame([(0, 3)], "run_id int, n bigint"), n).first()["av_heterozygosity"] == 0


def test_ranks_are_a_permutation(spark):
    df = spark.range(5000).select(F.lit(0).alias("run_id"), F.col("id"), (F.xxhash64("id") % 1000 / 2000 + 0.5).alias("u"))
    got = ranked(df, "u", "id").orderBy("u", "id").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    sums = running_sum(df.withColumn("v", F.col("id") % 3), "v", "u", "id").orderBy("u", "id").collect()
    total = 0
    for r in sums:
        total += r["v"]
        assert r["total"] == total


def test_parameters():
    cfg = Config.from_strings({"num_runs": "2", "max_growth_rate": "1.5", "track_DNA": "1", "scenario": "Default,Flood,Eden", "selection": "Birth,Annual", "plot": "numinds,births"})
    assert (cfg.num_runs, cfg.max_growth_rate, cfg.track_DNA, cfg.scenario, cfg.plot) == (2, 1.5, True, "Default", ("numinds", "births"))
    assert cfg.selects("birth") and not cfg.selects("annual")
    assert Config(bottleneck_start=3, bottleneck_end=5, bottleneck_size=7).cap(4) == 7
    with pytest.raises(KeyError):
        Config.from_strings({"nothing": "1"})


def test_founder_weights():
    assert sum(w > 0 for w in dims.pyramid_weights(100)) == 56
    assert all(0 < w < 1 for w in dims.pyramid_weights(20))
    low, high = dims.age_ranges(100)[0][1], dims.age_ranges(100)[-1][2]
    assert (low, high) == (0.0, pytest.approx(1.0))
    assert poisson_table(100.0)[-1] == pytest.approx(1.0)


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Chromosome,Arm,Start,Length\n1,0,0,5\n1,1,5,7\n")
    assert [tuple(r) for r in dims.read_arms(spark, str(tmp_path / "a.csv"), 2).collect()] == [(1, "p", 0, 10), (1, "q", 10, 14)]
    (tmp_path / "r.csv").write_text("Age,Risk,PopProb,,,\n0,0.5,0.1,,,\n1,0.25,0.1,,,note\n")
    assert [tuple(r) for r in dims.read_actuarial(spark, str(tmp_path / "r.csv")).collect()] == [(0, 0.5), (1, 0.25)]
    (tmp_path / "p.csv").write_text("parameter,label,type,value_format,default,group\nnum_runs,Runs,Text,int,3,main\nscenario,S,Dropdown,string,\"Flood,Eden\",main\n")
    cfg = Config.from_csv(str(tmp_path / "p.csv"))
    assert (cfg.num_runs, cfg.scenario) == (3, "Flood")


def single(spark, rows):
    return spark.createDataFrame(rows, "run_id int, ind_id bigint, sex int, birth_year int, lifespan int, marriage_state bigint, year_of_last_birth int, lat double, lon double")


def serial_choice(rows, men, women, distance):
    """Men in order take the best woman left: younger ones by the smallest gap, then the others, ties by the women's order."""
    by = {x[1]: x for x in rows}
    left, out = list(women), []
    place = {w: i for i, w in enumerate(women)}
    for m in men[: min(len(men), len(women))]:
        fits = [w for w in left if math.sqrt((by[w][7] - by[m][7]) ** 2 + (by[w][8] - by[m][8]) ** 2) <= distance]
        if fits:
            gap = lambda w: by[w][3] - by[m][3]  # noqa: E731, B023
            w = min(fits, key=lambda w: (gap(w) <= 0, abs(gap(w)), place[w]))
            left.remove(w)
            out.append((m, w))
    return out


def in_ranks(df, cfg):
    return [[x["ind_id"] for x in mating.shuffled(people.singles(df, cfg, 0, sex), draw, cfg, 0).orderBy("rank").collect()] for sex, draw in ((0, "shufm"), (1, "shuff"))]


@pytest.mark.parametrize(("n", "spread", "years", "distance"), [(60, 6, 12, 0.4), (600, 6, 12, 0.4), (120, 0, 3, 0.4), (400, 3, 20, 0.0), (300, 9, 1, 0.15)])
def test_distance_marriage_is_serial_choice(spark, n, spread, years, distance):
    """Also where all live in one place, are of one age, or must be of one place."""
    import random

    r = random.Random(5)
    rows = [(0, i, i % 2, -25 - r.randrange(years), 850, -1, 0, r.randrange(-spread, spread + 1) / 10, r.randrange(-spread, spread + 1) / 10) for i in range(n)]
    df, cfg = single(spark, rows), Config(random_mating=distance)
    got = mating.distance_pairs(df, cfg, 0, checkpointer(spark))
    assert sorted(map(tuple, got.select("man", "woman").collect())) == sorted(serial_choice(rows, *in_ranks(df, cfg), distance))


def test_nearest_is_the_best_of_all_pairs(spark):
    import random

    r = random.Random(6)
    rows = [(i % 3 // 2, i, i % 2, -25 - r.randrange(30), 850, -1, 0, r.randrange(-9, 10) / 20, r.randrange(-9, 10) / 20) for i in range(400)]
    df, cfg = single(spark, rows), Config()
    men, women = (mating.shuffled(people.singles(df, cfg, 0, sex), draw, cfg, 0) for sex, draw in ((0, "shufm"), (1, "shuff")))
    for distance in (0.0, 0.1, 0.33, 2.0):
        pairs = {}
        for p in mating.candidates(men, women, distance).collect():
            key = (p["older"], p["size"], p["woman_rank"])
            if p["man"] not in pairs or key < pairs[p["man"]][0]:
                pairs[p["man"]] = (key, p["run_id"], p["woman"], p["gap"])
        got = mating.nearest(men, women, distance)
        assert sorted(map(tuple, got.select("run_id", "man", "woman", "gap").collect())) == sorted((run, m, w, g) for m, (_, run, w, g) in pairs.items())


def test_empty_sides_marry_nobody(spark):
    none, cfg = single(spark, []), Config(random_mating=0.3)
    assert mating.distance_pairs(none, cfg, 0, checkpointer(spark)).count() == 0
    assert mating.distance_pairs(single(spark, [(0, 1, 0, -30, 85, -1, 0, 0.0, 0.0)]), cfg, 0, checkpointer(spark)).count() == 0


def test_partitions_do_not_change_draws(spark):
    cfg = Config(start_pop_size=200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, mating.random_pairs(founders.default(spark, cfg), cfg, 0).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and got[0]


def test_child_bits_come_from_the_parent(spark):
    n = dims.genome_size()
    births = spark.createDataFrame([(0, 0, 1, 10)], "run_id int, dad bigint, mom bigint, child_id bigint")
    cross = genome.crossovers(births, dims.chromosomes(spark), Config(), 0)
    h = haplotypes(spark, ("1" * n, "0" * n), ("1" * n, "0" * n))
    masks = {r["role"]: r["mask"] for r in genome.mask_strings(cross).collect()}
    bits = {r["copy"]: r["bits"] for r in genome.meiosis(cross, h, n).collect()}
    assert bits == {0: masks["dad"], 1: masks["mom"]}  # copy 0 is all ones: the mask itself is what is inherited
    assert genome.meiosis(cross, haplotypes(spark, ("0" * n, "0" * n)), n).count() == 0


def test_culls_spare_the_seed(spark):
    df = single(spark, [(0, i, i % 2, -30, 85, -1, 0, 0.0, 0.0) for i in range(30)])
    seeds = spark.createDataFrame([(0, 7)], "run_id int, ind_id bigint")
    caps = spark.createDataFrame([(0, 1)], "run_id int, cap bigint")
    gone = {r["ind_id"] for r in mortality.culled(df, caps, Config(), 0, seeds).collect()}
    assert gone == set(range(30)) - {7}
    assert 7 not in {r["ind_id"] for r in mortality.culled_breeders(df, 3, Config(), 0, seeds).collect()}


def pixels(path):
    """(width, rows) of an RGB picture, chunk by chunk, with all checksums tested."""
    import zlib

    with open(path, "rb") as f:
        data = f.read()
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + content)
        if kind == b"IHDR":
            width, height = struct.unpack(">II", content[:8])
        body += content * (kind == b"IDAT")
        at += 12 + n
    raw = zlib.decompress(body)  # tests the Adler-32
    assert len(raw) == height * (3 * width + 1)
    rows = [raw[k * (3 * width + 1) : (k + 1) * (3 * width + 1)] for k in range(height)]
    assert all(r[0] == 0 for r in rows)
    return width, [r[1:] for r in rows]


def test_pictures(spark, tmp_path, monkeypatch):
    """Any number of rows over many tasks and chunks; people without bits are black, an empty population gives the ruler alone."""
    from kinfold.plans import png

    monkeypatch.setattr(png, "CHUNK", 2000)
    n = dims.genome_size()
    rnd = __import__("random").Random(4)
    bits = {(i, k): "".join(rnd.choice("01") for _ in range(n)) for i in range(60) for k in (0, 1) if i % 3}
    who = spark.createDataFrame([(0, i) for i in range(60)], "run_id int, ind_id bigint").repartition(4)
    h = spark.createDataFrame([(0, i, k, b) for (i, k), b in bits.items()], "run_id int, ind_id bigint, copy int, bits string")
    sinks.genome_map(who, h, dims.arms(spark), n, str(tmp_path / "g.png"))
    width, rows = pixels(tmp_path / "g.png")
    colour = {"1": b"\xff\0\0", "0": b"\0\0\0"}
    assert width == n and rows[:10] == sinks.ruler_rows(dims.arms(spark), n)
    assert rows[10:] == [b"".join(map(colour.__getitem__, bits.get((i, k), "0" * n))) for i in range(60) for k in (0, 1)]
    m = spark.createDataFrame([(0, 0, 0, 5, -3), (0, 1, 1, 9, 2), (0, 1, 1, 9, -2)], "run_id int, ind_id bigint, copy int, position int, effect int")
    sinks.mutation_map(who.filter("ind_id < 2"), m, dims.arms(spark), n, str(tmp_path / "m.png"))
    want = [bytearray(3 * n) for _ in range(4)]
    want[0][15:18], want[3][27:30] = b"\xff\0\0", b"\xff\xff\xff"
    assert pixels(tmp_path / "m.png")[1][10:] == list(map(bytes, want))
    sinks.genome_map(who.filter("ind_id < 0"), h, dims.arms(spark), n, str(tmp_path / "e.png"))
    assert len(pixels(tmp_path / "e.png")[1]) == 10


def test_checksums_join():
    import os
    import zlib

    from kinfold.plans.png import adler_of_both

    for sizes in ((0, 0), (1, 0), (0, 7), (70_000, 200_000), (5, 65_521)):
        a, b = map(os.urandom, sizes)
        assert adler_of_both(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_log_of_repeated_years(spark, tmp_path):
    """A year is there once however often it is written; what a broken writer left isn't read; a column may be added later."""
    path = str(tmp_path / "log")
    frame = lambda rows, more="": spark.createDataFrame(rows, "run_id int, year int, id long" + more)
    years = lambda *ys: spark.createDataFrame([(0, y) for y in ys], "run_id int, year int")
    logs.write_log(frame([(0, 1, 5), (0, 1, 6), (0, 2, 7), (0, 3, 8), (0, 9, 9)]), years(1, 2, 3), path)
    logs.write_log(frame([(0, 2, 70)]), years(2, 3), path)
    got = lambda: sorted((r["year"], r["id"]) for r in logs.read_log(spark, path).collect())
    assert got() == [(1, 5), (1, 6), (2, 70)]
    logs._replaced(frame([(0, 1, 99)]).withColumn("_write", F.lit("never finished")), path + "/rows")
    assert got() == [(2, 70)]
    logs.write_log(frame([(0, 1, 5, "x")], ", cause string"), years(1), path)
    assert got() == [(1, 5), (2, 70)] and {r["cause"] for r in logs.read_log(spark, path).collect()} == {None, "x"}


def test_histogram_changes_add_up(spark):
    """Equal to a recount after each interval, also when the changes of an interval come in parts; effects beyond the ends are counted in the end bins."""
    import random

    r = random.Random(8)
    lives = [(r.randrange(2), r.choice([-1500, -3, 0, 4, 1200]), r.randrange(5), r.choice([None, 3, 4, 5])) for _ in range(300)]
    df = spark.createDataFrame(lives, "run_id int, effect int, born int, gone int").filter("gone IS NULL OR gone >= born")
    lives = [tuple(x) for x in df.collect()]
    parts = [statistics.histogram_change(df.filter((F.col("born") == k) & (F.pmod("effect", F.lit(2)) == p)), df.filter((F.col("gone") == k) & (F.pmod("effect", F.lit(2)) == p)), k) for k in range(6) for p in (0, 1)]
    changes = parts[0]
    for p in parts[1:]:
        changes = changes.unionByName(p)
    got = {tuple(x)[:3]: tuple(x)[3:] for x in statistics.histograms(changes).collect()}
    want = {}
    for run in (0, 1):
        for k in sorted({x[2] for x in lives if x[0] == run} | {x[3] for x in lives if x[0] == run and x[3] is not None}):
            for b in (-1000, -3, 0, 4, 1000):
                own = [x for x in lives if x[0] == run and max(-1000, min(1000, x[1])) == b and x[2] <= k]
                if own:
                    want[run, k, b] = (len(own), sum(x[3] is None or x[3] > k for x in own))
    assert got == want


def test_words_are_the_bits(spark):
    """Packed haplotypes against strings: odd sizes, ends of words, a copy that isn't there."""
    rnd = __import__("random").Random(2)
    for n in (1, 61, 62, 63, 124, 200):
        bits = {(i, k): "".join(rnd.choice("0001") for _ in range(n)) for i in range(12) for k in (0, 1) if (i, k) != (3, 0)}
        spans = [(0, i, k, [(m.start(), m.end()) for m in __import__("re").finditer("1+", b)]) for (i, k), b in bits.items()]
        df = spark.createDataFrame(spans, "run_id int, ind_id long, copy int, spans array<struct<low:int,high:int>>")
        h = df.withColumn("words", packed.from_spans(F.col("spans"), n)).drop("spans")
        got = {(r["ind_id"], r["copy"]): r["words"] for r in h.collect()}
        assert got == {key: [int(b[a : a + 62].ljust(62, "0"), 2) for a in range(0, n, 62)] for key, b in bits.items()}
        counts = {r["position"]: r["n"] for r in packed.position_counts(h).collect()}
        assert counts == {p: c for p in range(n) if (c := sum(b[p] == "1" for b in bits.values()))}
        kept = packed.retained(h, n).first()
        assert kept["retained"] == len(counts)
        het = packed.heterozygosity(h, spark.createDataFrame([(0, 12)], "run_id int, n long"), n).first()["het"]
        assert het == sum(bits.get((i, 0), "0" * n)[p] != bits[i, 1][p] for i in range(12) for p in range(n))
        for cuts in (None, [0], sorted({0, n // 3, n // 2, n - 1}), list(range(n))):
            marks = {*(cuts or []), n}
            want = sorted((i, k, m.start() + a, m.end() - m.start()) for (i, k), b in bits.items() for a, z in itertools.pairwise(sorted({0, *marks})) for m in re.finditer("1+", b[a:z]))
            assert sorted((r["ind_id"], r["copy"], r["start"], r["length"]) for r in packed.islands(h, cuts).collect()) == want
        alleles = {r["ind_id"]: (r["allele_count"], r["num_blocks"]) for r in packed.allele_counts(h).collect()}
        assert alleles == {i: tuple(sum(f(bits.get((i, k), "")) for k in (0, 1)) for f in (lambda b: b.count("1"), lambda b: len(re.findall("1+", b)))) for i in range(12)}


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2.5), (1, 1, 3.5)], "run int, year int, numinds double")
    sinks.write_csv(df, str(tmp_path / "r"))
    sinks.write_csv(df, str(tmp_path / "r"), append=True)
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 4


def test_stream_of_events(spark, tmp_path):
    rows = [(0, y, k) for y in range(10) for k in ("birth", "marriage")]
    spark.createDataFrame(rows, "run_id int, sim_year int, kind string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("run_id int, sim_year int, kind string").parquet(str(tmp_path / "e"))
    run = interval_stream(stream, 3).writeStream.outputMode("complete").format("memory").queryName("intervals").start()
    run.processAllAvailable()
    run.stop()
    got = {(r["interval"], r["kind"]): r["n"] for r in spark.table("intervals").collect()}
    assert got == {(i, k): 1 if i == 0 else 3 for i in range(4) for k in ("birth", "marriage")}


def test_poisson_of_large_means():
    """The cumulative chances end near 1 and have their middle at the mean, far beyond where exp(-mean) is 0."""
    for mean in (0.0, 0.3, 40.0, 1000.0, 5000.0):
        table = poisson_table(mean)
        assert table == sorted(table) and table[-1] == pytest.approx(1, abs=1e-9)
        assert abs(sum(c < 0.5 for c in table) - mean) <= 1


def test_pedigree_of_a_long_line(spark):
    """More generations than a recursive query allows; a line that leaves the table is left out, one without an end is refused."""
    n = 1500
    rows = [(0, i, -1 if i == 0 else 0, i - 1) for i in range(n)] + [(0, 5000, 1, 4999), (1, 0, -1, -1), (1, 1, 0, 0)]
    df = spark.createDataFrame(rows, "run_id int, ind_id bigint, dad bigint, mom bigint")
    got = {(r["run_id"], r["ind_id"]): r["depth"] for r in people.pedigree_depth(df, checkpointer(spark)).collect()}
    assert got == {(0, i): i for i in range(n)} | {(1, 0): 0, (1, 1): 1}


def test_ids_depend_on_seed_and_year(spark):
    births = spark.createDataFrame([(0, 0, m) for m in range(40)], "run_id int, dad bigint, mom bigint")
    last = spark.createDataFrame([(0, 99)], "run_id int, last_id bigint")
    ids = lambda seed, year: tuple(r["child_id"] for r in people.with_ids(births, last, Config(seed=seed), year).orderBy("mom").collect())
    assert len({ids(0, 0), ids(0, 1), ids(5, 0)}) == 3 and sorted(ids(5, 1)) == list(range(100, 140)) and ids(0, 1) == ids(0, 1)


def test_runs_and_words(spark):
    bits = ["0000", "1111", "0110111001", "1", "0", "10" * 100 + "1"]
    df = spark.createDataFrame([(0, i, 0, b) for i, b in enumerate(bits)], "run_id int, ind_id bigint, copy int, bits string")
    want = {(i, m.start(), len(m.group())) for i, b in enumerate(bits) for m in __import__("re").finditer("1+", b)}
    assert {(r["ind_id"], r["start"], r["length"]) for r in genome.islands(df).collect()} == want
    counts = {r["position"]: r["n"] for r in statistics.position_counts(df).collect()}
    assert counts == {p: n for p in range(201) if (n := sum(b[p : p + 1] == "1" for b in bits))}
    w = df.filter("ind_id = 5").select(genome.words(F.col("bits"), 201).alias("w")).first()["w"]
    assert w == [int(bits[5][k : k + 62], 2) for k in range(0, 201, 62)]


def test_population_queries_without_a_library_of_the_others():
    """Where a library that only the text operators need is missing, the entry still has the population queries."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert set(out.stdout.split()) == set(q.QUERIES)


@pytest.mark.parametrize("few", [1, 7, 100_000])
def test_lowest_is_a_plain_cut(spark, few):
    """With weights of 0, equal numbers, limits of 0, beyond the sum, and of runs without rows; refined to single rows, and not at all."""
    import random

    r = random.Random(few)
    rows = [(run, i, r.choice([r.randrange(2**52) / 2.0**52, r.randrange(8) / 8, 0.25 + r.randrange(9) * 2.0**-52]), r.choice([0, 0, 1, 3])) for run in range(5) for i in range(200)]
    limits = {0: 17, 1: 0, 2: 10_000, 3: 60, 9: 4}
    df = spark.createDataFrame(rows, "run_id int, id long, u double, w int")
    table = spark.createDataFrame(list(limits.items()), "run_id int, limit long")
    for weight in (None, F.col("w")):
        want = []
        for run, limit in limits.items():
            total = 0
            for x in sorted((x for x in rows if x[0] == run), key=lambda x: (x[2], x[1])):
                if total >= limit:
                    break
                want.append((run, x[1]))
                total += 1 if weight is None else x[3]
        got = lowest(df, table, "u", "id", weight, few=few)
        assert got.columns == df.columns and sorted((x["run_id"], x["id"]) for x in got.collect()) == sorted(want)


def test_poisson_by_guide_is_the_count_of_sums(spark):
    for mean in (0.0, 0.3, 40.0, 5000.0):
        sums = poisson_table(mean)
        us = [k / 997 for k in range(997)] + [0.0, 1 - 2.0**-52, *[c for c in sums if c < 1][:300]]
        df = spark.createDataFrame(list(enumerate(us)), "id int, u double")
        got = {x["id"]: x["k"] for x in poisson_drawn(df, "u", mean, "k").collect()}
        assert got == {i: sum(c <= x for c in sums) for i, x in enumerate(us)}
        assert len(guided(poisson_ranges(mean))) <= 2 * len(sums) + 2


def test_choice_by_guide(spark):
    """One value with nearly all weight, values without any, and a group where nothing has weight."""
    rows = [("a", k, w) for k, w in enumerate([1, 0, 5000, 2, 0, 7])] + [("b", 9, 3), ("c", 8, 0)]
    table, totals = guide(spark.createDataFrame(rows, "g string, k long, w long"), "k", "w", ["g"])
    assert table.count() <= 2 * 5
    draws = spark.createDataFrame([(g, n, (n + 0.5) / 5010) for g in "abc" for n in range(5010)], "g string, n int, u double")
    got = {(x["g"], x["k"]): x["n"] for x in chosen(draws, table, totals, "u", ["g"]).groupBy("g", "k").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 0): 1, ("a", 2): 5000, ("a", 3): 2, ("a", 5): 7, ("b", 9): 5010}


def test_genealogy_of_odd_pedigrees(spark):
    """A line of many lengths, a parent missing from the table, no descendants, a seed that isn't there, a cycle."""
    rows = [(0, 0, 0, -1, -1), (0, 1, 1, -1, -1), (0, 2, 0, 0, 1), (0, 3, 1, 2, 1), (0, 4, 0, 0, 3), (0, 5, 0, 4, 99), (0, 6, 1, -1, 3), (0, 7, 0, 98, 97), (1, 0, 0, -1, -1), (2, 5, 1, -1, -1)]
    schema = "run_id int, ind_id long, sex int, dad long, mom long"
    df = spark.createDataFrame(rows, schema)
    seeds = spark.createDataFrame([(0, 0), (1, 0), (2, 77)], "run_id int, ind_id long")
    got = {tuple(x)[:2]: tuple(x)[2:] for x in pedigree.genealogy(df, seeds, checkpointer(spark)).collect()}
    assert got == {(0, 0): (0, 0, 0, 0), (0, 1): (-1,) * 4, (0, 2): (1, -1, 1, 1), (0, 3): (-1, -1, 2, 2), (0, 4): (1, -1, 1, 3), (0, 5): (2, -1, 2, 4), (0, 6): (-1, -1, 3, 3), (0, 7): (-1,) * 4, (1, 0): (0, 0, 0, 0), (2, 5): (-1,) * 4}
    loop = spark.createDataFrame([(0, 0, 0, 1, -1), (0, 1, 0, 0, -1)], schema)
    with pytest.raises(ValueError, match="cycle"):
        pedigree.genealogy(loop, seeds, checkpointer(spark))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distance_marriage_takes_few_steps_in_a_crowd(spark, monkeypatch):
    """steps grew with the people of a place; neighbourhoods beyond the bound go by rounds, to the same couples."""
    import random

    r = random.Random(7)
    rows = [(i % 5 // 4, i, i % 2, -25 - r.randrange(4), 850, -1, 0, r.randrange(3) / 10, r.randrange(2) * 5.0) for i in range(300)]
    df, cfg, steps = single(spark, rows), Config(random_mating=0.15), []
    got = mating.distance_pairs(df, cfg, 0, lambda f: steps.append(1) or f.localCheckpoint())
    couples = sorted(map(tuple, got.select("run_id", "man", "woman").collect()))
    assert len(couples) > 100 and len(steps) < 20
    monkeypatch.setattr(mating, "IN_TURN", 100)
    assert sorted(map(tuple, mating.distance_pairs(df, cfg, 0, checkpointer(spark)).collect())) == couples


def test_wide_text_is_not_broadcast(spark):
    """Spark can't see the size of text and words that it has yet to make."""
    sf = "/root/testdata/sf0.001"
    for name in ("meiosis_splice", "meiosis_words", "genome_map_pixels"):
        assert "strategy=merge" in plan(q.QUERIES[name](spark, sf))


def test_people_are_dealt_before_bits_are_made(spark, monkeypatch):
    """A row group of people is one task of Parquet, whatever is made of them."""
    monkeypatch.setattr(q.views, "PEOPLE_A_TASK", 40)
    for view in (q.views.haplotypes, q.views.packed_haplotypes):
        assert view(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    few = q.views.individuals(spark, "/root/testdata/sf0.001").coalesce(1)
    assert founders.heterozygous(few, Config(init_heterozygosity=0.3), 50).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bits_of_odd_keys(spark, tmp_path):
    """Both views give the stretches of their definition, also for keys below 0."""
    keys = [-900, -27, -3, -1, 0, 1, 5, 12345678901]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    want = {(k, c): "".join("1" if math.fmod(k * 7 + c * 13 + p // 16, 11) < 4 else "0" for p in range(q.NUMBITS)) for k in keys for c in (0, 1)}
    assert {(x.ind_id, x.copy): x.bits for x in q.views.haplotypes(spark, str(tmp_path)).collect()} == want
    for x in q.views.packed_haplotypes(spark, str(tmp_path)).collect():
        assert "".join(f"{w:062b}" for w in x.words)[: q.NUMBITS] == want[x.ind_id, x.copy]


def test_draws_below_a_limit(spark):
    """all, none and some of the bits."""
    who = spark.createDataFrame([(1, 7), (2, 7)], "run_id int, ind_id bigint")
    for h in (0.0, 0.3, 1.0):
        u = spark.range(90).select(*[q.uniform("het", F.lit(7), F.col("id"), run=run).alias(f"r{run}") for run in (1, 2)]).orderBy("id").collect()
        got = {x.run_id: x.bits for x in founders.heterozygous(who, Config(init_heterozygosity=h), 90).filter("copy = 0").collect()}
        assert got == {run: "".join("1" if x[f"r{run}"] < h else "0" for x in u) for run in (1, 2)}


def test_copies_meet_as_words(spark):
    """Sorting the text of all copies took the memory of a task."""
    assert "THEN bits" not in plan(q.heterozygosity(spark, "/root/testdata/sf0.001"))


def test_mutations_are_joined_once_for_all_intervals(spark, monkeypatch):
    """each save interval read and joined all mutations twice."""
    read, change = [], statistics.histogram_change
    monkeypatch.setattr(statistics, "histogram_change", lambda new, gone, *more: read.extend(new.inputFiles() + gone.inputFiles()) or change(new, gone, *more))
    q.hist_by_interval(spark, "/root/testdata/sf0.001")
    assert read and not [f for f in read if "lineitem" in f]


def test_runs_are_found_in_whole_batches(spark, monkeypatch):
    """Runs were gathered row by row into arrays that grew with each."""
    for name in ("block_stats_words", "blocks_by_arm_words", "blocks_islands_words"):
        assert "zip_with" not in plan(q.QUERIES[name](spark, SF))
    for name in ("seed_retained", "blocks_islands"):
        assert "regexp_extract_all" not in plan(q.QUERIES[name](spark, SF))
    bits = [None, "", "1", "0", "01" * 40, "", None, "1" * 130, "1", "0" * 62 + "1"]
    want = sorted((i, m.start(), len(m.group())) for i, b in enumerate(bits) for m in re.finditer("1+", b or ""))
    text = spark.createDataFrame([(0, i, 0, b) for i, b in enumerate(bits)], "run_id int, ind_id long, copy int, bits string")
    words = [None if b is None else [int(b[a : a + 62].ljust(62, "0"), 2) for a in range(0, len(b), 62)] for b in bits]
    packs = spark.createDataFrame([(0, i, 0, w) for i, w in enumerate(words)], "run_id int, ind_id long, copy int, words array<long>")
    for bytes_at_once in (1, 200, 1 << 21):
        monkeypatch.setattr(genome, "AT_ONCE", bytes_at_once)
        for found in (genome.islands(text), packed.islands(packs)):
            assert sorted((x.ind_id, x.start, x.length) for x in found.coalesce(1).collect()) == want


def test_zeros_are_taken_out_in_stretches(spark):
    """F16: zeros were taken out one by one."""
    bits = ["", "1", "0", "0" * 16, "0" * 33, "1" + "0" * 17 + "1", "0" * 15 + "1" + "0" * 31 + "11", "10" * 40]
    df = spark.createDataFrame([(b,) for b in bits], "bits string")
    assert [x.n for x in df.coalesce(1).select(genome.ones(F.col("bits")).alias("n")).collect()] == [b.count("1") for b in bits]
    assert f"replace(bits#, {'0' * 16}, )" in re.sub(r"#\d+", "#", plan(df.select(genome.ones(F.col("bits")))))


def test_results_row_is_one_pass(spark, monkeypatch):
    """people were joined and haplotypes made anew for each figure of the results row; all of them come from one pass, the same as one by one."""
    for name in ("results_row", "results_row_words", "results_printed"):
        read = re.findall(r"Relation \[(c_custkey|l_orderkey)", plan(q.QUERIES[name](spark, SF)))
        assert read.count("l_orderkey") == 1 and read.count("c_custkey") == 3  # customer: the size of the population, the people, their haplotypes
    n, cuts = 130, [0, 40, 62, 63, 124]
    bits = {(0, 0, 0): "1" * n, (0, 0, 1): "01" * 65, (0, 1, 0): "0" * n, (0, 1, 1): ("0" * 61 + "11" + "0" * 67), (0, 2, 0): "1" * n, (0, 9, 0): "1" + "0" * 129, (0, 9, 1): "0" * n, (1, 0, 0): "0" * n, (1, 0, 1): None}
    text = spark.createDataFrame([(*k, b) for k, b in bits.items()], "run_id int, ind_id long, copy int, bits string")
    words = spark.createDataFrame([(*k, b and [int(b[a : a + 62].ljust(62, "0"), 2) for a in range(0, n, 62)]) for k, b in bits.items()], "run_id int, ind_id long, copy int, words array<long>")
    people = [(0, 0, 1, -1, 2, "101", 0.5, 3), (0, 1, 0, 1, 1, "000", 1.5, None), (0, 2, -1, 5, -1, "110", 1.0, 2), (0, 3, 1, 1, 1, "1", 1.0, None), (0, 0, 1, -1, 2, "101", 0.5, 3), (0, None, 1, 1, 1, "1", 1.0, 1), (1, 0, 1, 1, 1, "1", 1.0, 0), (2, 0, 1, 1, 1, "1", 1.0, None)]
    who = spark.createDataFrame(people, "run_id int, ind_id long, y_gens int, mt_gens int, max_genealo_gens int, centromeres string, fitness double, mutations int")
    sizes = who.groupBy("run_id").agg(F.count("*").alias("n"))
    names = {"perc_seed_genome": "perc_seed_genome_retained", "av_coverage": "av_seed_genome_coverage"}
    dna = who.join(genome.allele_counts(text), ["run_id", "ind_id"], "left")
    same = [statistics.descendants(dna).drop("numinds", "inds_with_blocks"), statistics.fitness_stats(who, n)]
    for held, own, cut in ((text, statistics, None), (words, packed, cuts)):
        parts = [*same, packed.block_stats(words, cut), (statistics.coverage if own is statistics else packed.retained)(held, n), own.heterozygosity(held, sizes, n)]
        want: dict = {}
        for r in itertools.chain(*[part.withColumnsRenamed(names).drop("retained", "het").collect() for part in parts]):
            want.setdefault(r["run_id"], {}).update({k: float(v or 0) for k, v in r.asDict().items()})
        for bytes_at_once in (1, 1 << 21):
            monkeypatch.setattr(genome, "AT_ONCE", bytes_at_once)
            measures = packed.measures(held, cut) if own is packed else genome.measures(held, n, cut)
            got = {r["run_id"]: {k: float(v or 0) for k, v in r.asDict().items()} for r in statistics.whole_row(who, measures.coalesce(1), n, own is packed, True).collect()}
            assert {k: {c: v[c] for c in want[k]} for k, v in got.items()} == {k: pytest.approx(v) for k, v in want.items()}
    numbers = lambda df: sorted((r["copy"], r["ind_id"], r["ones"], r["blocks"], r["squares"], r["words"]) for r in df.filter("run_id = 0").collect())
    assert numbers(genome.measures(text, n, cuts)) == numbers(packed.measures(words, cuts))
