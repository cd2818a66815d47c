"""N-gram Jaccard join (1): prefix-tree joins over groups that share rare prefixes, exact and whole.

Two texts link when the Jaccard similarity of their sets of word shingles reaches NUMERATOR / DENOMINATOR. The steps:

1. Texts with equal sets become one set with the smallest id.
2. In the order of a 64-bit hash of the shingle, two linked sets share at least k shingles among the first n - ceil(0.75 n) + k of each
   (the prefix rule). A set stays in play only if enough of its prefix occurs in other sets' prefixes. Input partitions settle what they see
   themselves and send one row per shard of shingles, so a shingle that a third of all rows hold reaches a shard once a partition.
3. Sets in play meet under their first HEADS shingles, in groups that are dealt in chunks with one common member when they are large.
   In a chunk the sets form a prefix tree, most frequent shingles first; each set walks it, sharing partial
   overlaps, leaving out subtrees that can't reach the overlap in what remains, or whose members are all connected with it by now.
   This connects nearly all that links, and large groups of copies become one component in linear time.
4. A link that is still missing joins two components, and all that its sets share lies in both. So a set of which three quarters don't occur in
   other components is done. The others take the prefix rule again, now with the shingles that occur in fewest sets first (of
   three quarters and a bit, the prefix is that bit), and those that share a shingle of it form families. A family meets in one prefix tree; a large one
   is dealt in blocks, so that each block of its largest component meets each block of the other members, and these meet each other.
   Families beyond WHOLE sets meet shingle by shingle instead. Trees leave out members of one component.

Small tables (see `broadcastable`) go to the large ones. Each set is sent once per head and once or little more per family, never once per pair. Hashes of 64 bits stand for shingles and sets; a
collision is the only way to a wrong result. Working tables are removed when the components are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GROUP_BYTES, Scratch, broadcastable, byte_texts, carried, mixed, rows, short_batches, signed, written

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Prefix shingles that an input partition holds before it settles and sends them.
HELD = 1_500_000
#: Sets, and shingles, of one chunk of a group; sets of a family that is dealt as a whole.
CHUNK, CHUNK_SHINGLES, WHOLE = 1500, 2_000_000, 30_000
#: First shingles of a set under which it meets others before the families are made.
HEADS = 2
MULTIPLIERS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text: WORDS words each; a shorter text is one shingle; none without words."""
    words = text.lower().split()
    n = len(words)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)] if n else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    total = h[: n - WORDS + 1] * MULTIPLIERS[0]
    for k in range(1, WORDS):
        total += h[k : n - WORDS + 1 + k] * MULTIPLIERS[k]
    return np.unique(mixed(total))


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def least_overlap(n: int) -> int:
    return -(-NUMERATOR * n // DENOMINATOR)


#: A set must share one shingle and so large a part of its size within its prefix.
PART = 10
LEAST = f"(({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR})"


def prefix(n: int) -> int:
    """The length of a prefix in which linked sets share 1 + n // PART."""
    return n - least_overlap(n) + 1 + n // PART


def linked(n: int, m: int, overlap: int) -> bool:
    return overlap > 0 and DENOMINATOR * overlap >= NUMERATOR * (n + m - overlap)


def least_shared() -> Column:
    """What a set of n must share within its prefix with any partner, which has three quarters of n at least."""
    return 1 + F.expr(f"{LEAST} div {PART}")


POSTINGS = "shard int, tokens binary, owners binary, sids binary, sid long, n long, credit long, holds long, doc_id long, row long"
POSTING_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 6]
POSTING_NAMES = [c.split()[0] for c in POSTINGS.split(", ")]
#: What comes back from the shards: rows of documents (no holds), and credits of sets.
FOUND = POSTINGS.split("sids binary, ")[1]
TOKEN = np.dtype([("low", "<u4"), ("high", "u1")])


def _postings(shards: int):
    """Prefix shingles of each distinct set. What occurs twice here is credited to its sets at once; of every
    shingle one posting goes to its shard (cut to 40 bits: a chance match there only keeps a set in play), marked
    in the owner's lowest bit if the credit was given. Beside them a row for each document: its set and the number of its shingles."""

    def settled(sids: list[int], ns: list[int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff([*start, len(tokens)])
        many = size > 1
        credit = np.bincount(owner[np.repeat(many, size)], minlength=len(sids))
        k = len(sids)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, t) for t in POSTING_KINDS[:4]] + [pa.array(x, pa.int64()) for x in (sids, ns, credit, np.ones(k, np.int64))] + [pa.nulls(k, pa.int64())] * 2, POSTING_NAMES)
        tokens, owner = tokens[start], owner[start]
        shard = (tokens >> np.uint64(40)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        table = np.array(sids, np.int64)
        for s in range(shards):
            at = order[cuts[s] : cuts[s + 1]]
            if not len(at):
                continue
            out = np.empty(len(at), TOKEN)
            out["low"], out["high"] = tokens[at] & np.uint64(0xFFFFFFFF), (tokens[at] >> np.uint64(32)) & np.uint64(255)
            own, back = np.unique(owner[at], return_inverse=True)
            marked = (back.astype("<u4") << np.uint32(1)) | many[at].astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((s, out.tobytes(), marked.tobytes(), table[own].tobytes(), *[None] * 6), POSTING_KINDS, strict=True)], POSTING_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        seen: set[int] = set()
        sids, ns, parts, held = [], [], [], 0
        for batch in batches:
            keys, lens, k = [], [], batch.num_rows
            for _, text in rows([batch]):
                t = shingles(text)
                lens.append(len(t))
                keys.append(key := set_key(t) if len(t) else None)
                if not len(t) or key in seen:
                    continue
                seen.add(key)
                sids.append(key)
                ns.append(len(t))
                parts.append(t[: prefix(len(t))])
                held += len(parts[-1])
                if held > HELD:
                    yield from settled(sids, ns, parts)
                    seen, sids, ns, parts, held = set(), [], [], [], 0
            own = batch.column("row") if "row" in batch.schema.names else pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, t) for t in POSTING_KINDS[:4]] + [pa.array(x, pa.int64()) for x in (keys, lens)] + [pa.nulls(k, pa.int64())] * 2 + [batch.column("doc_id"), own], POSTING_NAMES)
        if sids:
            yield from settled(sids, ns, parts)

    return run


def _credits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Credits to sets for shingles that different sets sent to a shard (rows sorted by shard); rows without a shard pass."""

    def finish(parts: list) -> pa.RecordBatch:
        raw = np.concatenate([np.frombuffer(p[0], TOKEN) for p in parts])
        tokens = raw["low"].astype(np.uint64) | (raw["high"].astype(np.uint64) << np.uint64(32))
        marked = [np.frombuffer(p[1], "<u4") for p in parts]
        sids = [np.frombuffer(p[2], "<i8") for p in parts]
        base = np.concatenate([[0], np.cumsum([len(s) for s in sids])])
        owner = np.concatenate([(m >> np.uint32(1)).astype(np.int64) + b for m, b in zip(marked, base, strict=False)])
        given = np.concatenate(marked) & np.uint32(1)
        table = np.concatenate(sids)
        order = np.argsort(tokens, kind="stable")
        tokens, owner, given = tokens[order], owner[order], given[order]
        sid = table[owner]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        shared = (np.minimum.reduceat(sid, start) != np.maximum.reduceat(sid, start)) | (np.maximum.reduceat(given, start) > 0)
        hit = np.repeat(shared, np.diff([*start, len(tokens)])) & (given == 0)
        own, credit = np.unique(sid[hit], return_counts=True)
        empty = pa.nulls(len(own), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(own), empty, pa.array(credit, pa.int64()), pa.array(np.zeros(len(own), np.int64)), empty, empty], POSTING_NAMES[4:])

    shard, parts = None, []
    for batch in batches:
        near = batch.column("shard").is_null()
        if passing := batch.filter(near).select(POSTING_NAMES[4:]):
            yield passing
        columns = batch.filter(pc.invert(near)).select(POSTING_NAMES[:4]).columns
        for s, *part in zip(*(c.to_pylist() for c in columns), strict=True):
            if parts and s != shard:
                yield finish(parts)
                parts = []
            shard = s
            parts.append(part)
    if parts:
        yield finish(parts)


WHOLE_SET = "sid long, n long, tokens array<long>"


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sids, parts = [], []
        wanted = batch.column("sid").to_pylist() if "sid" in batch.schema.names else [None] * batch.num_rows  # None: whatever the text's own is
        for sid, text in zip(wanted, (t.as_py() for t in batch.column("text")), strict=True):
            t = shingles(text)
            if not len(t) or (own := set_key(t)) != (own if sid is None else sid):
                continue
            sids.append(own)
            parts.append(signed(t))
        n = [len(t) for t in parts]
        tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(n, pa.int64()), tokens], ["sid", "n", "tokens"])


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Tree:
    """A prefix tree of sets of ranks, given sorted: a node is a range of sets that begin alike, and holds the ranks that these share beyond their parent's."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray):
        k = len(sets)
        size = np.array([len(s) for s in sets])
        lcp = np.zeros(k, np.int64)
        for i in range(1, k):
            m = min(size[i - 1], size[i])
            diff = np.flatnonzero(sets[i - 1][:m] != sets[i][:m])
            lcp[i] = diff[0] if len(diff) else m
        # each level of nodes after the one above, so that the children of a node stand together
        rows, parts, level = [], [], [(0, k, 0)]
        while level:
            below = []
            for i, j, start in level:
                end = int(size[i]) if j - i == 1 else int(lcp[i + 1 : j].min())
                cuts = [i, *(i + 1 + np.flatnonzero(lcp[i + 1 : j] == end)).tolist(), j] if j - i > 1 else []
                own = [(a, b, end) for a, b in zip(cuts, cuts[1:], strict=False)]
                rows.append((i, j, end - start, int(n[i:j].min()), int(n[i:j].max()), int(size[i:j].max()) - end, len(own)))
                parts.append(sets[i][start:end])
                below += own
            level = below
        self.first, self.past, self.part, self.fewest, self.most, self.longest, self.children = np.array(rows, np.int64).T
        self.start = np.cumsum(self.part) - self.part
        self.child = 1 + np.cumsum(self.children) - self.children
        self.ranks = np.concatenate(parts)

    def near(self, x: int, own: np.ndarray, nx: int, mark: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets after x, and what each shares with it, that x may link with and that aren't labelled like it. Partial overlaps are those of
        whole nodes; a subtree is left out where what remains can't make up the overlap, and a level is looked at only where a node above it wasn't left out."""
        low, high = least_overlap(nx), DENOMINATOR * nx // NUMERATOR
        others = np.concatenate([[0], np.cumsum(label != label[x])])
        at, overlap, passed = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        found, shares = [], []
        while len(at):
            past = self.past[at]
            keep = (past > x + 1) & (self.most[at] >= low) & (self.fewest[at] <= high)
            keep &= others[past] > others[np.minimum(np.maximum(self.first[at], x + 1), past)]
            at, overlap, passed = at[keep], overlap[keep], passed[keep]
            start, size = self.start[at], self.part[at]
            total = np.concatenate([[0], np.cumsum(mark[self.ranks[ranges(start, size)]])])
            ends = np.cumsum(size)
            overlap = overlap + total[ends] - total[ends - size]
            passed = np.where(size > 0, np.searchsorted(own, self.ranks[np.maximum(start + size, 1) - 1], "right"), passed)
            need = -(-NUMERATOR * (nx + np.maximum(self.fewest[at], low)) // (NUMERATOR + DENOMINATOR))
            keep = overlap + np.minimum(len(own) - passed, self.longest[at]) >= need
            at, overlap, passed = at[keep], overlap[keep], passed[keep]
            leaf = self.children[at] == 0
            found.append(self.first[at[leaf]])
            shares.append(overlap[leaf])
            more = self.children[at]
            at, overlap, passed = ranges(self.child[at], more), np.repeat(overlap, more), np.repeat(passed, more)
        return np.concatenate([*found, np.empty(0, np.int64)]), np.concatenate([*shares, np.empty(0, np.int64)])


def tree_links(sids: list[int], sets: list[np.ndarray], known: list[int] | None = None, sizes: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning star (set, smallest set of its component) of the links among sets, by a prefix tree; with the components known so far, only links
    that join two of them. sizes: how many shingles each has, if those that no other can share are left out of `sets`."""
    lens = sizes or [len(s) for s in sets]
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int32)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.int32)
    common = int((count > 1).sum())  # shingles of one set alone have the last ranks and can't overlap
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    short = [np.sort(rank[back[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    short = [s[: np.searchsorted(s, common)] for s in short]
    order = sorted((i for i in range(len(sets)) if len(short[i]) >= least_overlap(lens[i])), key=lambda i: short[i].astype(">i4").tobytes())
    if len(order) < 2:
        return []
    ids, n, sets = [sids[i] for i in order], np.array([lens[i] for i in order]), [short[i] for i in order]
    label = np.arange(len(ids)) if known is None else np.unique([known[i] for i in order], return_inverse=True)[1]
    if (label == label[0]).all():
        return []
    tree = Tree(sets, n)
    joined: list[tuple[int, int]] = []
    mark = np.zeros(common, bool)
    for x in range(len(ids) - 1):
        if (label[x + 1 :] == label[x]).all():
            continue
        mark[sets[x]] = True
        for i, overlap in zip(*(v.tolist() for v in tree.near(x, sets[x], int(n[x]), mark, label)), strict=True):
            if i > x and label[i] != label[x] and linked(int(n[x]), int(n[i]), overlap):
                joined.append((ids[x], ids[i]))
                label[label == label[i]] = label[x]
        mark[sets[x]] = False
    if known is not None:
        return joined
    least: dict[int, int] = {}
    for i, c in zip(ids, label.tolist(), strict=True):
        least[c] = min(i, least.get(c, i))
    return [(i, least[c]) for i, c in zip(ids, label.tolist(), strict=True) if i != least[c]]


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each (key, chunk), rows sorted by them; between components, if the rows have them."""

    def finish(group: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        known = [c for _, _, c in group.values()]
        got = tree_links(list(group), [t for t, _, _ in group.values()], None if None in known else known, [n for _, n, _ in group.values()]) if len(group) > 1 else []
        if got:
            yield pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in got], pa.int64()), "v": pa.array([b for _, b in got], pa.int64())})

    last, group = None, {}
    for batch in batches:
        tokens = batch.column("tokens")
        flat, cuts = tokens.flatten().to_numpy(), np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())]).tolist()
        for key, chunk, sid, n, component, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "sid", "n", "component")), cuts, cuts[1:], strict=False):
            if (key, chunk) != last:
                yield from finish(group)
                last, group = (key, chunk), {}
            group[sid] = flat[a:b], n, component
    yield from finish(group)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that each node of (u, v) reaches, by alternating large and small stars until nothing changes."""
    e = scratch.written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v"))
        e = scratch.written(small.filter("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _chunks(sets: str, shingles_: str) -> Column:
    """How many chunks a group of so many sets and shingles makes."""
    return F.greatest(F.ceil(F.col(sets) / CHUNK), F.ceil(F.col(shingles_) / CHUNK_SHINGLES))


def _blocks(members: DataFrame) -> DataFrame:
    """(key, chunk, sid, component): members (key, sid, n, component) of groups dealt so that all pairs of different components meet.

    The largest component of a key goes block by block to every block of the others, which also go to each other. So
    a set is repeated once a block of the others, however large the largest component is. A small group is one chunk.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("c", "component", "w")).alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w")).filter(F.col("c") > F.col("most.c"))
    half = lambda c, w: F.greatest(F.ceil(2 * c / CHUNK), F.ceil(2 * w / CHUNK_SHINGLES), F.lit(1))
    main, rest = (F.col("most.c"), F.col("most.w")), (F.col("c") - F.col("most.c"), F.col("w") - F.col("most.w"))
    small = (F.col("c") <= CHUNK) & (F.col("w") <= CHUNK_SHINGLES)
    sizes = sizes.select("key", F.col("most.component").alias("main"), F.when(small, 1).otherwise(half(*main)).alias("m"), F.when(small, 1).otherwise(half(*rest)).alias("r"))
    m = members.join(sizes, "key").withColumn("h", F.xxhash64("sid"))
    main = m.filter("component = main").select("key", "sid", "component", F.lit("main").alias("kind"), F.expr("pmod(h, m)").alias("i"), F.explode(F.expr("sequence(0L, r - 1)")).alias("j"))
    rest = m.filter("component <> main").withColumn("b", F.expr("pmod(h, r)"))
    to_main = rest.select("key", "sid", "component", F.lit("main").alias("kind"), F.explode(F.expr("sequence(0L, m - 1)")).alias("i"), F.col("b").alias("j"))
    other = rest.filter("r > 1").select("key", "sid", "component", "b", F.explode(F.expr("sequence(0L, r - 1)")).alias("o")).filter("o <> b")
    to_rest = other.select("key", "sid", "component", F.lit("rest").alias("kind"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    return main.unionByName(to_main).unionByName(to_rest).select("key", F.concat_ws("-", "kind", "i", "j").alias("chunk"), "sid", "component")


def _tree_joined(placed: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) within each (key, chunk) of placed."""
    placed = broadcastable(scratch.written(placed, "placed"))
    return sets.select("sid", "n", "tokens").join(placed, "sid").repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(_tree, "u long, v long")


def _closing(sets: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """All links between different components of `known` (sets without one are their own) that are needed to join them."""
    known = broadcastable(scratch.written(known, "known"))
    named = sets.join(known, sets["sid"] == known["node"], "left").select("sid", "n", "tokens", F.coalesce("component", "sid").alias("component"))
    t = named.select("sid", "n", "component", F.explode("tokens").alias("token"))
    across = t.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("df")).filter("a <> b").select("token", "df")
    open_ = t.join(across, "token").groupBy("sid", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).filter(f"size(t) >= {LEAST}")
    open_ = scratch.written(open_.select("sid", "n", "component", F.col("t.token").alias("tokens"), F.expr(f"slice(t.token, 1, cast(size(t) - {LEAST} + 1 as int))").alias("rare")), "open")
    met = open_.select("sid", F.explode("rare").alias("token"))
    pivots = met.groupBy("token").agg(F.min("sid").alias("pivot"), F.count("*").alias("c")).filter("c > 1").select("token", "pivot")
    families = components(met.join(pivots, "token").select(F.col("sid").alias("u"), F.col("pivot").alias("v")), scratch)
    whole = families.groupBy("component").count().filter(F.col("count") <= WHOLE).select(F.col("component").alias("family"))
    of_family = families.select(F.col("node").alias("sid"), F.col("component").alias("family"))
    member = open_.select("sid", "n", "component", "rare").join(of_family, "sid")
    members = member.join(whole, "family", "left_semi").select(F.col("family").alias("key"), "sid", "n", "component")
    members = members.unionByName(member.join(whole, "family", "left_anti").select(F.explode("rare").alias("key"), "sid", "n", "component"))
    return _tree_joined(_blocks(members), open_, scratch)


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Null and empty texts have no shingles and link with nothing; equal texts link unless empty; rows that repeat an id are each
    reported (an id's rows may lie in different components); rows without an id take part in links but
    don't lend their id (component_id is null where no member has one); texts of any length are judged whole; columns beside doc_id and text are left behind; an empty table gives no rows.
    """
    keys, named = _connected(byte_texts(docs))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_set = named.join(least, "c").select("sid", "component_id")
    linked_ = keys.filter("sid is not null").join(of_set, "sid")
    out = linked_.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(keys.filter("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _connected(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid, row) of each row of `byte_texts`, row null if base has none; and (sid, rep, c): the smallest id and the component of each set."""
    spark = base.sparkSession
    short_batches(spark)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // GROUP_BYTES))
    spread = F.coalesce("shard", F.pmod(F.xxhash64("sid", "doc_id", "row"), F.lit(shards)))
    found = base.mapInArrow(_postings(shards), POSTINGS).repartition(shards, spread).sortWithinPartitions("shard").mapInArrow(_credits, FOUND)
    found = written(found, "sets")
    keys = found.filter("holds is null").select("doc_id", "n", "sid", "row")
    reps = keys.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    with Scratch(spark) as scratch:
        credit = found.filter("holds is not null").groupBy("sid").agg(F.max("n").alias("n"), F.sum("credit").alias("credit"), F.sum("holds").alias("holds"))
        live = credit.filter(F.col("credit") >= least_shared() * F.col("holds")).select("sid")
        chosen = scratch.written(reps.join(live, "sid").select(F.col("rep").alias("doc_id"), "sid"), "chosen")
        # an id may be repeated with another text: the key worked out again tells which row was meant
        texts = base.join(broadcastable(chosen.filter("doc_id is not null")), "doc_id").select("sid", "text")
        # a set that only rows without an id hold is found by its key among those rows, equal ones reduced before they are joined
        loose = base.filter("doc_id is null").select("text").mapInArrow(_whole_sets, WHOLE_SET).dropDuplicates(["sid"]).join(chosen.filter("doc_id is null").select("sid"), "sid", "left_semi")
        sets = scratch.written(texts.mapInArrow(_whole_sets, WHOLE_SET).unionByName(loose), "live")
        if sets.groupBy("sid").count().filter("count > 1").limit(1).count():  # only where rows are repeated whole
            sets = scratch.written(sets.dropDuplicates(["sid"]), "live")
        known = written(_known(sets, scratch), "components")
    named = reps.join(known, reps["sid"] == known["node"], "left").select("sid", "rep", F.coalesce("component", "sid").alias("c"))
    return keys, named


def _known(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all sets that link with another."""
    # the first shingles by their hashes' order as unsigned numbers, in which they are stored
    heads = sets.select("sid", "n", F.explode(F.slice("tokens", 1, HEADS)).alias("key"))
    counted = heads.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min("sid").alias("pivot")).filter("c > 1").withColumn("chunks", _chunks("c", "w").cast("int"))
    own = heads.join(counted, "key").select("key", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int").alias("chunk"), "sid")
    pivots = counted.filter("chunks > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("pivot").alias("sid"))
    placed = own.unionByName(pivots).withColumn("component", F.lit(None).cast("long"))
    links = scratch.written(_tree_joined(placed, sets, scratch), "links")
    known = components(links, scratch)
    closing = scratch.written(_closing(sets, known, scratch), "closing")
    return components(links.unionByName(closing), scratch) if closing.limit(1).count() else known


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (with the smallest doc_id, if one has an id) and every row that links with nothing, with all their columns.

    Rows repeated whole are copies like others, and an id repeated with another text is judged text by text; rows without words (null and empty texts too) link with nothing.
    Of rows repeated with the smallest id any one stays; other columns pass through whatever their names; texts of any length are judged whole; an empty table gives no rows.
    """
    held, row, restored = carried(docs, "doc_id", "text")
    keys, named = _connected(byte_texts(held, row=row))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    # the set's own first row, then its component's: a set that very many rows share is reduced before it is joined
    of_set = keys.filter("sid is not null").groupBy("sid").agg(F.min(order).alias("first"))
    of_class = of_set.join(named.select("sid", "c"), "sid").groupBy("c").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_keep"))
    keep = of_class.unionByName(keys.filter("sid is null").select(F.col("row").alias("_keep")))
    return restored(held.join(keep, held[row] == keep["_keep"], "left_semi"))
