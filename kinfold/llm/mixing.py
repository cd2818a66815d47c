"""Mixing sources to target weights (4): min-cost flow over membership patterns, then seeded selection.

A document belongs to one or more sources; its set of sources is its pattern. Documents are aggregated
by pattern (one row a pattern reaches the driver), a min-cost
flow routes the patterns' words to the sources' quotas - each repetition of a pattern costs more than
the one before, up to a limit - and the flow of a pattern becomes whole passes over its documents plus a
seeded choice for the rest. Patterns that share no source, not even by others between them, are flows of their own. The choice is a cut in the order of a
seeded hash: a histogram of hash ranges, which stays a table, finds the range that holds the cut, and only that range's documents are ordered.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcastable, carried, plainly_named, written

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: A document is taken at most so many times.
REPEATS = 3
#: Relative weights by position in the order of sources, repeating (fixed values of the task).
WEIGHTS = (5, 2, 1)
#: Hash ranges of a pattern's histogram: each holds one in so many of its documents.
RANGES = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple = WEIGHTS, limit: float = REPEATS, total: int | None = None) -> dict:
    """Words wanted of each source: its weight's share of all words, at most `limit` times what it has; the excess is shared anew by weight.

    Sources in the order of code points, null last; weights repeat. A source of size 0 gets 0. total: all words, where sources overlap.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values()) if total is None else total), list(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > limit * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in over:
            out[s] = float(limit * sizes[s])
        left -= sum(out[s] for s in open_ if s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def flow(patterns: list[tuple[tuple, int]], quotas: dict, limit: int = REPEATS) -> list[int]:
    """Words taken of each (sources, size) pattern: a min-cost flow by successive shortest paths.

    Arcs: start -> pattern, `limit` of them with the pattern's size each and costs 0, 1, 4, ... (convex:
    the k-th repetition costs k squared, so repetitions are spread); pattern -> each of its sources; source -> end with its quota.
    """
    names = {s: len(patterns) + 1 + i for i, s in enumerate(quotas)}
    end = len(patterns) + len(names) + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> None:
        for u, v, room, price in ((a, b, c, w), (b, a, 0, -w)):
            graph[u].append(len(to))
            to.append(v)
            cap.append(room)
            cost.append(price)

    for i, (sources, size) in enumerate(patterns, 1):
        for k in range(limit):
            arc(0, i, size, k * k)
        for s in sources:
            arc(i, names[s], limit * size, 0)
    for s, quota in quotas.items():
        arc(names[s], end, round(quota), 0)
    potential = [0] * (end + 1)
    while True:
        far = [float("inf")] * (end + 1)
        back = [-1] * (end + 1)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in graph[u]:
                if cap[e] and (n := d + cost[e] + potential[u] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], back[to[e]] = n, e
                    heapq.heappush(queue, (n, to[e]))
        if back[end] < 0:
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        path, v = [], end
        while v:
            path.append(back[v])
            v = to[back[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    # the room of a reversed start arc is what flows into the pattern
    return [sum(cap[e] for e in graph[i] if e % 2 and to[e] == 0) for i in range(1, len(patterns) + 1)]


def flows(patterns: list[tuple[tuple, int]], quotas: dict, limit: int = REPEATS) -> list[int]:
    """`flow`, separately for groups of patterns without a common source."""
    parent = {s: s for s in quotas}

    def top(s):
        while parent[s] != s:
            parent[s] = s = parent[parent[s]]
        return s

    for sources, _ in patterns:
        for s in sources[1:]:
            parent[top(s)] = top(sources[0])
    groups: dict = {}
    for i, (sources, _) in enumerate(patterns):
        groups.setdefault(top(sources[0]), []).append(i)
    out = [0] * len(patterns)
    for at in groups.values():
        own = {s: quotas[s] for i in at for s in patterns[i][0]}
        for i, words in zip(at, flow([patterns[i] for i in at], own, limit), strict=True):
            out[i] = words
    return out


def mix(docs: DataFrame, sources: str | Column = "source", seed: int = 7, weights: tuple = WEIGHTS, limit: int = REPEATS, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, sources, source_size, target, times, part, taken.

    `sources` is a string column (one source a document, null its own source) or an array column
    (overlapping sources; source_size and target are then those of its first source). times is how often the
    document is taken whole, part the words of one more copy (of one document a pattern at most), taken = times * size + part.
    Runs agree: the order is md5(seed, doc_id; a hash of the text where there is no id), then doc_id, then a hash of the text, so that what is left are rows
    with one source, id and text, of which it is the same whichever gets more; then
    the column `row` if named (a number of each row's own, see `keyed`), which is returned too. Null and empty texts have size 0 and are taken
    once or as often as others (taken 0); other columns don't matter; an empty table gives no rows.
    """
    if isinstance(sources, str):
        docs = plainly_named(docs, "doc_id", "text", sources, *([row] if row else []))
    column = F.col(sources) if isinstance(sources, str) else sources
    kind = docs.select(column.alias("s")).schema["s"].dataType.typeName()
    members = F.array_sort(F.array_distinct(column)) if kind == "array" else F.array(column.cast("string"))
    tie = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text"), F.col("tie").cast("string"))))), 1, 13), 16, 10).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"), members.alias("sources"), tie.alias("tie"), *([F.col(row).alias("row")] if row else [])).withColumn("key", key)
    base = base.withColumn("bin", (F.col("key") / F.lit((1 << 52) // RANGES)).cast("int"))
    hist = written(base.groupBy("sources", "bin").agg(F.sum("size").alias("words")), "ranges")
    plan = hist.groupBy("sources").agg(F.sum("words").alias("words")).collect()  # one row a pattern
    patterns = [(tuple(r["sources"] or [None]), r["words"]) for r in plan]
    sizes: dict = {}
    for names, words in patterns:
        for s in names:
            sizes[s] = sizes.get(s, 0) + words
    want = targets(sizes, weights, limit, sum(words for _, words in patterns))
    rows = []
    for r, (names, size), words in zip(plan, patterns, flows(patterns, want, limit), strict=True):
        whole = min(limit, words // size) if size else 1
        rows.append((r["sources"], int(whole), int(words - whole * size if size else 0), int(sizes[names[0]]), float(want[names[0]])))
    table = docs.sparkSession.createDataFrame(rows, "sources array<string>, whole int, left long, source_size long, target double").alias("t")
    # the range in which a pattern's rest ends: at most RANGES rows a pattern are ordered
    upto = F.sum("words").over(Window.partitionBy("h.sources").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    cut = hist.alias("h").join(table, F.col("h.sources").eqNullSafe(F.col("t.sources"))).select("t.*", "bin", "words", upto.alias("upto")).filter("upto >= left and upto - words < left")
    cut = cut.select(F.col("sources").alias("cut_sources"), F.col("bin").alias("cut"), (F.col("left") - F.col("upto") + F.col("words")).alias("rest")).alias("c")
    plan_table = table.join(cut, F.col("t.sources").eqNullSafe(F.col("c.cut_sources")), "left").select("t.*", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("rest", F.lit(0)).alias("rest"))
    plan_table = broadcastable(written(plan_table, "cuts")).alias("p")  # a row a pattern
    joined = base.alias("b").join(plan_table, F.col("b.sources").eqNullSafe(F.col("p.sources"))).select("b.*", "whole", "source_size", "target", "cut", "rest")
    order = Window.partitionBy("sources").orderBy("key", "doc_id", "tie", *(["row"] if row else [])).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("size").over(order)
    # the document at the cut is taken in part: just the words that are missing
    ranked = joined.filter("bin = cut").withColumn("extra", (total <= F.col("rest")).cast("int")).withColumn("part", F.when(total > F.col("rest"), F.greatest(F.col("rest") - total + F.col("size"), F.lit(0))).otherwise(0))
    outside = joined.filter("bin <> cut").withColumn("extra", (F.col("bin") < F.col("cut")).cast("int")).withColumn("part", F.lit(0).cast("long"))
    both = ranked.unionByName(outside).withColumn("times", F.col("whole") + F.col("extra"))
    return both.select("doc_id", "size", "sources", "source_size", "target", "times", "part", (F.col("times") * F.col("size") + F.col("part")).alias("taken"), *(["row"] if row else []))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed documents with their own columns: a document taken k times is k rows, one taken 0 times is gone; a part counts as a copy from half the document on. Rows without an id and repeated ids are taken row by row.

    Null and empty texts have no words and are taken as often as their source is taken whole; null is a source of its own; ties are settled as in `mix`; other columns pass
    through whatever their names; texts of any length count whole; an empty table gives no rows."""
    more = ((F.col("size") > 0) & (2 * F.col("part") >= F.col("size"))).cast("int")
    held, row, restored = carried(docs, "doc_id", "text", "source")
    times = mix(held, seed=seed, row=row).select(F.col("row").alias(row), (F.col("times") + more).alias("_times")).filter("_times > 0")
    return restored(held.join(times, row).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))))
