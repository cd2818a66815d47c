"""Exact top-k search (8): multi-resolution segment statistics, coarse to fine, then exact scores for survivors.

For vectors cut into segments of length L with means m and deviations s,
|x - q|^2 >= sum over segments of L * ((mx - mq)^2 + (sx - sq)^2), which is the same as
<x, q> <= sum of L * (mx * mq + sx * sq), since |x|^2 = sum of L * (m^2 + s^2). Finer segments give tighter bounds; a pair whose bound is
below what the query's k-th best has at least is out, and only pairs that are left at the finest resolution get an exact integer score.

Segments should hold unequal energy, so vectors are turned first to the axes of most variance (fitted on a bounded sample; a turn changes no product, and
bounds are widened for its rounding). The coarsest resolution has segments of 1, 1, 2, 4, 8, ... axes, each finer one halves them; one that would hold as many
numbers as the vector is left out, as the product itself costs no more.

Candidates are packed in blocks by cells of their coarse statistics (a tree of medians of the sample), and each cell's rows are dealt once to as many parts as they need, so
that a cell with any share of the rows is split. Of each cell the box of its statistics bounds every product with it: a query goes only to the parts of cells whose box
reaches its limit, and a part works out its statistics once. Limits come from a first pass over one in LIMIT_PART rows; a part raises them as it finds better rows,
and sends at most k rows a query, none below the limit. Of a block those rows and queries go on to a finer resolution that have a pair left; once few pairs are left, these alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, written

QUERIES_PER_BLOCK, ROWS_PER_BLOCK = 512, 4096
#: Numbers (rows times their length) that a part of the candidates holds, and that a task holds while it packs them.
PART_NUMBERS, PACK_NUMBERS = 1 << 21, 1 << 23
#: Rows of the sample that a cell has at least, which bounds the cells by FIT_ROWS / LEAF.
LEAF = 4
#: One in so many rows (by a hash of the id) takes part in the pass that finds limits.
LIMIT_PART = 64
#: Rows that the turn is fitted on, and the longest vectors that are turned.
FIT_ROWS, FIT_DIM = 4096, 1024
#: Pairs scored in one go; relative widening of the bounds; pairs are taken one by one where no more than one in SPARSE is left.
PAIRS, SLACK, SPARSE = 1 << 17, 1e-6, 8


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x); vectors that are null, empty or hold a null or non-finite component, and rows without an id, are left out."""
    v = F.col(vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # beyond 2^62 / scale a component has no exact long; it is held at that bound
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & good).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62))))).alias("v")
    )


def resolutions(dim: int) -> list[np.ndarray]:
    """Segment starts of each resolution, coarse to fine, as long as their two numbers a segment are fewer than the axes."""
    starts = [0, *(1 << k for k in range(dim.bit_length()) if 1 << k < dim)]
    out = []
    while 2 * len(starts) < dim:
        out.append(np.array(starts))
        ends = [*starts[1:], dim]
        starts = sorted({*starts, *((a + b) // 2 for a, b in zip(starts, ends, strict=True))})
    return out


def statistics(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per row and segment: sqrt(L) * mean and sqrt(L) * deviation; the product of two rows of these bounds the inner product."""
    n = np.diff([*starts, x.shape[1]])
    total, square = np.add.reduceat(x, starts, 1), np.add.reduceat(x * x, starts, 1)
    spread = np.sqrt(np.maximum(square - total * total / n, 0))
    return np.hstack([total / np.sqrt(n), spread])


def fitted_turns(candidates: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the axes of most variance first, as the columns of a matrix: from FIT_ROWS rows at most, with the least hashes."""
    return {dim: turn for dim, (_, turn) in _fitted(candidates).items()}


def _fitted(candidates: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    rows = candidates.filter(F.size("v") <= FIT_DIM).withColumn("h", F.xxhash64("vec_id", "v")).orderBy("h").limit(FIT_ROWS).select("v").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r["v"])
    samples = {dim: np.array(vs, float) for dim, vs in by.items()}
    return {dim: (x, np.linalg.eigh(x.T @ x)[1][:, ::-1]) for dim, x in samples.items() if np.abs(x).max() < 2.0**50}


class Space:
    """The turn of vectors of one length, and the cells of their coarse statistics, numbered from `first`: a full binary tree of medians of the sample."""

    def __init__(self, sample: np.ndarray, turn: np.ndarray, cells: int, first: int):
        self.turn, self.first = turn, first
        self.depth = max(1, min(cells, len(sample) // LEAF)).bit_length() - 1
        self.cells = 1 << self.depth
        self.axis, self.cut = np.zeros(self.cells - 1, np.int64), np.zeros(self.cells - 1)
        held = {0: self.coarse(sample)}
        for node in range(self.cells - 1):
            x = held.pop(node)
            if len(x):
                self.axis[node] = x.var(0).argmax()
                self.cut[node] = np.median(x[:, self.axis[node]])
            high = x[:, self.axis[node]] > self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = x[~high], x[high]

    def coarse(self, v: np.ndarray) -> np.ndarray:
        y = v.astype(np.float64) @ self.turn
        levels = resolutions(y.shape[1])
        return statistics(y, levels[0]) if levels else y

    def cell(self, coarse: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(coarse), np.int64), np.arange(len(coarse))
        for _ in range(self.depth):
            at = 2 * at + 1 + (coarse[rows, self.axis[at]] > self.cut[at])
        return self.first + at - (self.cells - 1)


def fitted_spaces(candidates: DataFrame, rows: int) -> dict[int, Space]:
    """A space for each length in the sample, with a cell for some ROWS_PER_BLOCK of the rows. Rows of other lengths are all in cell -1, which every query reaches."""
    fitted, out, first = _fitted(candidates), {}, 0
    total = sum(len(x) for x, _ in fitted.values())
    for dim, (x, turn) in sorted(fitted.items()):
        out[dim] = Space(x, turn, -(-rows * len(x) // total // ROWS_PER_BLOCK), first)
        first += out[dim].cells
    return out


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(1))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, vectors as rows) for each length of the vectors of a batch."""
    sizes = batch.column("v").value_lengths().to_numpy()
    flat = batch.column("v").flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, flat[starts[at][:, None] + np.arange(dim)]


BLOCK = "dim int, cell int, numbers long, ids binary, data binary, norm double, low array<double>, high array<double>"


def _packed(rows: int, spaces: dict[int, Space]):
    """Blocks of some rows of one cell, with the box of their coarse statistics and their largest norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        numbers = 0

        def out(dim: int, cell: int) -> pa.RecordBatch:
            nonlocal numbers
            ids, v = (np.concatenate(c) for c in zip(*held.pop((dim, cell)), strict=True))
            numbers -= v.size
            box = [None, None]
            if dim in spaces:
                coarse = spaces[dim].coarse(v)
                box = [coarse.min(0).tolist(), coarse.max(0).tolist()]
            cells = [dim, cell, v.size, ids.astype("<i8").tobytes(), v.astype("<i8").tobytes(), float(norms(v).max()), *box]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            all_ids = batch.column("vec_id").to_numpy()
            for dim, at, v in by_length(batch):
                cells = spaces[dim].cell(spaces[dim].coarse(v)) if dim in spaces else np.full(len(at), -1)
                for cell in np.unique(cells).tolist():
                    mine = np.flatnonzero(cells == cell)
                    block = held.setdefault((dim, cell), [])
                    block.append((all_ids[at[mine]], v[mine]))
                    numbers += len(mine) * dim
                    if sum(len(i) for i, _ in block) >= rows:
                        yield out(dim, cell)
            if numbers > PACK_NUMBERS:
                for key in list(held):
                    yield out(*key)
        for key in list(held):
            yield out(*key)

    return pack


@dataclass
class Cell:
    """Where the blocks of a cell are: parts from `first` on; and its box and largest norm, if there is one."""

    first: int
    parts: int
    norm: float = 0.0
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def reached(self, coarse: np.ndarray, norm: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which queries may have a product of at least their limit with a row of the cell."""
        if self.low is None:
            return np.ones(len(norm), bool)
        return np.maximum(coarse, 0) @ self.high + np.minimum(coarse, 0) @ self.low + SLACK * norm * self.norm + SLACK >= limit


def laid_out(blocks: DataFrame) -> dict[int, Cell]:
    """The cells of written blocks, FIT_ROWS / LEAF and one at most, with as many parts as their rows need."""
    boxes: dict[int, list] = {}
    for r in blocks.select("cell", F.posexplode(F.arrays_zip("low", "high"))).groupBy("cell", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high")).orderBy("cell", "pos").collect():
        boxes.setdefault(r["cell"], []).append((r["low"], r["high"]))
    out, first = {}, 0
    for r in blocks.groupBy("cell").agg(F.sum("numbers").alias("numbers"), F.max("norm").alias("norm")).orderBy("cell").collect():
        low, high = np.array(boxes[r["cell"]]).T if r["cell"] in boxes else (None, None)
        out[r["cell"]] = Cell(first, -(-r["numbers"] // PART_NUMBERS), r["norm"], low, high)
        first += out[r["cell"]].parts
    return out


QUERY = "part int, dim int, ids binary, keys binary, limits binary, data binary"


def _routed(rows: int, spaces: dict[int, Space], cells: dict[int, Cell]):
    """Blocks of queries for each part that they may find something in."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def out(dim: int) -> Iterator[pa.RecordBatch]:
            ids, keys, limits, v = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            space = spaces.get(dim)
            coarse, norm = (space.coarse(v), norms(v)) if space else (None, norms(v))
            # at the bound anything may tie
            least = np.where(limits > -(2.0**63), limits, -np.inf)
            for cell in range(space.first, space.first + space.cells) if space else [-1]:
                if cell not in cells:
                    continue
                at = np.flatnonzero(cells[cell].reached(coarse, norm, least))
                if not len(at):
                    continue
                columns = [ids[at].astype("<i8"), keys[at].astype("<i8"), limits[at].astype("<f8"), v[at].astype("<i8")]
                for part in range(cells[cell].first, cells[cell].first + cells[cell].parts):
                    arrays = [pa.array([part], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)]
                    yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in QUERY.split(", ")])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("vec_id", "key", "limit")]
            for dim, at, v in by_length(batch):
                for a in range(0, len(at), rows):
                    some = at[a : a + rows]
                    held.setdefault(dim, []).append((*(c[some] for c in columns), v[a : a + rows]))
                    if sum(len(x[0]) for x in held[dim]) >= rows:
                        yield from out(dim)
        for dim in list(held):
            yield from out(dim)

    return route


class Rows:
    """Vectors with their statistics at all resolutions."""

    def __init__(self, v: np.ndarray, turn: np.ndarray | None):
        self.v, y = v, v.astype(np.float64)
        self.norm = np.sqrt((y * y).sum(1))
        y = y if turn is None else y @ turn
        self.statistics = [statistics(y, starts) for starts in resolutions(v.shape[1])]


def exact(q: np.ndarray, x: np.ndarray, narrow: bool) -> np.ndarray:
    """The integer inner product of each pair of rows; beyond 64 bits held at the bound."""
    if narrow:
        return np.einsum("ij,ij->i", q, x)
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(u, w, strict=True)))) for u, w in zip(q, x, strict=True)], np.int64)


def survivors(q: Rows, x: Rows, limit: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Of the pairs (query, row) that are alive those whose bounds reach the query's limit at every resolution; and how many were left after each."""
    at, rows, left = np.arange(len(q.v)), np.arange(len(x.v)), []
    limit = np.where(limit > -(2.0**63), limit, -np.inf)  # at the bound anything may tie
    pairs = None
    for a, b in zip(q.statistics, x.statistics, strict=True):
        if pairs is None:
            alive = alive & (a[at] @ b[rows].T + SLACK * q.norm[at, None] * x.norm[rows] + SLACK >= limit[at, None])
            keep, wanted = alive.any(1), alive.any(0)
            at, rows, alive = at[keep], rows[wanted], alive[np.ix_(keep, wanted)]
            left.append(int(alive.sum()))
            if left[-1] * SPARSE <= alive.size:
                i, j = np.nonzero(alive)
                pairs = at[i], rows[j]
            continue
        i, j = pairs
        good = [np.einsum("ij,ij->i", a[u], b[w]) + SLACK * q.norm[u] * x.norm[w] + SLACK >= limit[u] for u, w in ((i[c : c + PAIRS], j[c : c + PAIRS]) for c in range(0, len(i), PAIRS))]
        good = np.concatenate(good) if good else np.empty(0, bool)
        pairs = i[good], j[good]
        left.append(int(good.sum()))
    if pairs is None:
        i, j = np.nonzero(alive)
        pairs = at[i], rows[j]
    return *pairs, left


def scored(q: Rows, x: Rows, i: np.ndarray, j: np.ndarray, largest: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, rows, exact scores) of pairs: by one product of all their queries and rows where many of these are pairs and doubles hold all sums exactly, else PAIRS at a time.
    No sum of the products is beyond `largest`."""
    at, rows = np.unique(i), np.unique(j)
    if largest < 2.0**53 and len(i) * SPARSE > len(at) * len(rows):
        product = q.v[at].astype(np.float64) @ x.v[rows].astype(np.float64).T
        yield i, j, product[np.searchsorted(at, i), np.searchsorted(rows, j)].astype(np.int64)
        return
    for a in range(0, len(i), PAIRS):
        u, w = i[a : a + PAIRS], j[a : a + PAIRS]
        yield u, w, exact(q.v[u], x.v[w], largest < 2.0**62)


def best(i: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, np.negative(scores, where=scores > -(2**63), out=np.full(len(scores), 2**63 - 1, np.int64)), i))
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - first < k]


def search(q_ids: np.ndarray, q: Rows, limit: np.ndarray, blocks: list[tuple[np.ndarray, Rows]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, vec_id, score) of the k best of each query in the blocks of a part, if they reach its limit."""
    limit, at, ids, scores = limit.copy(), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    largest = float(np.abs(q.v.astype(float)).max(initial=0))
    for own, x in blocks:
        bound = largest * float(np.abs(x.v.astype(float)).max(initial=0)) * x.v.shape[1]
        i, j, _ = survivors(q, x, limit, q_ids[:, None] != own[None, :])
        for u, w, s in scored(q, x, i, j, bound):
            ok = s >= limit[u]
            at, ids, scores = np.concatenate([at, u[ok]]), np.concatenate([ids, own[w[ok]]]), np.concatenate([scores, s[ok]])
            keep = best(at, ids, scores, k)
            at, ids, scores = at[keep], ids[keep], scores[keep]
            # the k-th best so far is a limit for what comes
            full = np.flatnonzero(np.bincount(at, minlength=len(limit)) == k)
            limit[full] = np.maximum(limit[full], scores[np.searchsorted(at, full, "right") - 1])
    return at, ids, scores


def _searched(queries: DataFrame, blocks: DataFrame, k: int, spaces: dict[int, Space], cells: dict[int, Cell], turns: dict[int, np.ndarray]) -> DataFrame:
    """(query_id, key, vec_id, score): the k best of each query in each part of the blocks that may hold some."""
    spark = queries.sparkSession
    parts = max(1, sum(c.parts for c in cells.values()))
    places = F.broadcast(spark.createDataFrame([(n, c.first, c.parts) for n, c in cells.items()], "cell int, first int, parts int"))  # a row a cell
    x = blocks.join(places, "cell").select((F.col("first") + F.pmod(F.xxhash64("ids"), F.col("parts"))).cast("int").alias("part"), "dim", "ids", "data")
    q = queries.mapInArrow(_routed(QUERIES_PER_BLOCK, spaces, cells), QUERY)
    both = x.withColumn("query", F.lit(False)).unionByName(q.withColumn("query", F.lit(True)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part, a part's candidates before its queries."""
        part, held = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, held = r["part"], {}
                dim = r["dim"]
                ids, rows = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["data"], "<i8").reshape(-1, dim)
                if not r["query"]:
                    # a short first block gives limits to start with
                    cuts = [0, 64, len(ids)] if not held.get(dim) and len(ids) > 64 else [0, len(ids)]
                    held.setdefault(dim, []).extend((ids[a:b], Rows(rows[a:b], turns.get(dim))) for a, b in zip(cuts, cuts[1:], strict=False))
                elif dim in held:
                    keys = np.frombuffer(r["keys"], "<i8")
                    at, found, scores = search(ids, Rows(rows, turns.get(dim)), np.frombuffer(r["limits"], "<f8"), held[dim], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[at], keys[at], found, scores)], ["query_id", "key", "vec_id", "score"])

    return both.repartition(parts, "part").sortWithinPartitions("part", "query").mapInArrow(run, "query_id long, key long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with the candidates, its own id left out.

    Both tables are as `quantised` makes them (nulls are gone there). Vectors of another length than the query's take no part; a
    candidate that repeats counts once per row; queries that repeat an id and the vector are one, those that repeat the id with another vector have a ranking each;
    scores beyond 64 bits are held at the bound, where they tie; fewer than k candidates give fewer rows; empty tables none; columns beside vec_id and v must not be there (`quantised` leaves them behind).
    """
    short_batches(queries.sparkSession)
    queries = queries.withColumn("key", F.xxhash64("v")).dropDuplicates(["vec_id", "key"])
    n, numbers = candidates.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    spaces = fitted_spaces(candidates, n)
    turns = {dim: space.turn for dim, space in spaces.items()}
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # limits from some rows: cells would leave out nothing while there are none
    some = candidates.filter(F.pmod(F.xxhash64("vec_id"), F.lit(LIMIT_PART)) == 0).mapInArrow(_packed(ROWS_PER_BLOCK, {}), BLOCK)
    first = _searched(queries.withColumn("limit", F.lit(float("-inf"))), some, k, {}, {-1: Cell(0, max(1, -(-numbers // LIMIT_PART // PART_NUMBERS)))}, turns)
    limits = ranked(first).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "key", F.col("score").cast("double").alias("limit"))
    # written, so that the limits aren't found again for each reading of the queries
    limited = written(queries.join(limits, ["vec_id", "key"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("-inf")))), "limits")
    blocks = written(candidates.mapInArrow(_packed(ROWS_PER_BLOCK, spaces), BLOCK), "blocks")
    return ranked(_searched(limited, blocks, k, spaces, laid_out(blocks), turns)).select("query_id", "rank", "vec_id", "score")
