"""Suffix-array dedup (5): a common-prefix-aware distributed merge sort of sampled suffixes.

Every window of WINDOW bytes has one anchor: the leftmost of its GRAM-byte substrings with the least hash. Windows that
are equal have equal anchors at equal places, so it is enough to sort the suffixes that start at
anchors, each with what its windows hold to the left. Anchors whose substring occurs once in the corpus can't
belong to a repeated window and are left out first. Each home group sorts the rest into runs, one for each shard
of anchors, merges its own equal entries, and front-codes the runs; shards receive runs and combine them with a
loser tree that compares two suffixes only beyond the prefix both are known to share with the last one out. The
common prefixes that come with the merge, and those of the reversed left sides, tell which windows of an anchor are equal.

The entries of one anchor meet in one shard, so this is for anchors that occur up to HOT times. Of the others (a passage that very many documents
share, each in a context of its own) each home merges its equal entries too, and sends each distinct window once, dealt by a 128-bit hash of
its bytes instead of by anchor; where a hash comes from two homes, or twice from one, the window is repeated. No anchor, however common, makes a large group.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, short_batches, signed, with_home

WINDOW, GRAM = 200, 64
#: Bytes of text whose anchors are found in one go (a longer document is read in pieces of that size), and of one block of a run.
CHUNK, BLOCK = 1 << 20, 1 << 16
#: Bits of a place within a chunk: no text has as many bytes.
PLACE_BITS = np.uint64(32)
#: Groups of entries up to this size are compared in pairs, larger ones by classes.
PAIRS = 20
#: Anchors that occur more often are dealt by windows; the entries of others (under half a kB each) stay below GROUP_BYTES.
HOT = 20_000
#: In place of a run's number: the row is a window of a hot anchor, its hash the payload, its count (2: twice or more) in `past`.
HOT_RUN = -1
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each place, by doubling."""
    h, k = BYTES[data], 1
    while k < GRAM:
        h = h[:-k] * np.uint64(0xD6E8FEB86659FD93 + 2 * k) + h[k:]
        k *= 2
    return mixed(h)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, hash) of each stretch of windows with one anchor; places within the document.

    Documents of more than CHUNK bytes are read in pieces, each with the bytes that its last window needs; a stretch that a piece's end has cut is made whole again.
    """
    if all(len(t) <= CHUNK for t in texts):
        return _anchors(texts)
    found = []
    for k, t in enumerate(texts):
        for a in range(0, len(t), CHUNK) if len(t) > CHUNK else (0,):
            _, place, first, last, h = _anchors([t[a : a + CHUNK + WINDOW - 1]] if len(t) > CHUNK else [t])
            found.append((np.full(len(place), k, np.int64), place + a, first + a, last + a, h))
    doc, place, first, last, h = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(doc):
        return doc, place, first, last, h
    cut = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]) & (first[1:] == last[:-1] + 1)
    starts = np.flatnonzero(np.concatenate([[True], ~cut]))
    ends = np.concatenate([starts[1:] - 1, [len(doc) - 1]])
    return doc[starts], place[starts], first[starts], last[ends], h[starts]


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    lens = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    if len(data) < WINDOW or lens.max() < WINDOW:
        return none
    h = gram_hashes(data)
    w = WINDOW - GRAM + 1
    n = len(data) - WINDOW + 1
    # the least of w neighbours, by minima from both ends of blocks of w; the place is in the low bits, so that the leftmost wins. As many bits of the
    # hash count in every chunk, however long, or equal windows might have different anchors
    ranked = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = ranked
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    doc = np.repeat(np.arange(len(texts)), lens)[:n]
    valid = np.arange(n) + WINDOW <= starts[doc + 1]
    where = np.flatnonzero(valid)
    if not len(where):
        return none
    change = np.flatnonzero((np.diff(where) != 1) | (np.diff(at[where]) != 0) | (np.diff(doc[where]) != 0))
    first, last = where[np.concatenate([[0], change + 1])], where[np.concatenate([change, [len(where) - 1]])]
    d, p = doc[first], at[first]
    return d, p - starts[d], first - starts[d], last - starts[d], h[p]


def chunks(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    keys, texts, held = [], [], 0
    for key, text in rows:
        if held and held + len(text) > CHUNK:
            yield keys, texts
            keys, texts, held = [], [], 0
        keys.append(key)
        texts.append(text)
        held += len(text)
    if keys:
        yield keys, texts


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each home's distinct anchor hashes, and how often each occurs there."""
    found: dict[int, list] = {}
    def rows():
        for batch in batches:
            texts = batch.column("text")
            yield from zip(batch.column("home").to_pylist(), (t.as_py() for t in texts), strict=True)
    for homes, texts in chunks(rows()):
        doc, _, _, _, h = anchors(texts)
        own = np.array(homes)[doc]
        for home in np.unique(own).tolist():
            found.setdefault(home, []).append(h[own == home])
    for home, parts in found.items():
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        for a in range(0, len(keys), 200_000):
            k = keys[a : a + 200_000]
            yield pa.RecordBatch.from_pydict({"key": pa.array(signed(k)), "home": pa.array(np.full(len(k), home, np.int32)), "n": pa.array(n[a : a + 200_000].astype(np.int32))})


RUNS = "shard int, run int, seq int, payload binary, home int, rk long, first long, past long"
NAMES = [c.split()[0] for c in RUNS.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
#: Of an entry: bytes shared with the entry before and new ones, of the suffix and of the left side; the row's key, the anchor's place, whether it is known as repeated.
HEAD = struct.Struct("<HHHHqI?")


def shared(a: bytes, b: bytes, h: int = 0) -> int:
    """The length of the common prefix, given that it is h at least."""
    n = min(len(a), len(b))
    while h < n:
        x, y = a[h : h + 32], b[h : h + 32]
        if x != y:
            m = min(len(x), len(y))
            diff = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return h + (m if not diff else m - (diff.bit_length() + 7) // 8)
        h += 32
    return n


def coded(entries: list[tuple]) -> Iterator[bytes]:
    """Front-coded blocks of a sorted run of (suffix, reversed left side, row key, place, repeated)."""
    out, held = [], 0
    right = left = b""
    for r, l, rk, p, many in entries:
        a, b = shared(right, r), shared(left, l)
        out.append(HEAD.pack(a, len(r) - a, b, len(l) - b, rk, p, many) + r[a:] + l[b:])
        held += len(out[-1])
        right, left = r, l
        if held > BLOCK:
            yield b"".join(out)
            out, held = [], 0
    if out:
        yield b"".join(out)


def decoded(run: int, blocks: list[bytes]) -> Iterator[tuple]:
    """(suffix, prefix shared with the one before, left side, run, row key, place, repeated) of a run."""
    right = left = b""
    for block in blocks:
        i, n = 0, len(block)
        while i < n:
            a, new, b, more, rk, p, many = HEAD.unpack_from(block, i)
            i += HEAD.size
            right = right[:a] + block[i : i + new]
            i += new
            left = left[:b] + block[i : i + more]
            i += more
            yield right, a, left, run, rk, p, many


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple[tuple, int]]:
    """Entries of sorted runs in order, each with the prefix that it shares with the one before: a loser tree over common prefixes.

    lcp[i] is what run i's head shares with the last entry that came out. Of two heads the one that shares more comes
    first and nothing is compared; if they share as much, comparing starts beyond that.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0 if h else -1 for h in heads]
    losers = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's lcp becomes what it shares with the winner where that was compared."""
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        x, y = heads[a][0], heads[b][0]
        n = shared(x, y, lcp[a])
        if x[n : n + 1] <= y[n : n + 1]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    best = list(range(k))
    size = k
    while size > 1:
        size //= 2
        pairs = [match(best[2 * i], best[2 * i + 1]) for i in range(size)]
        for i, (_, lost) in enumerate(pairs):
            losers[size + i] = lost
        best = [won for won, _ in pairs]
    top = best[0]
    while heads[top] is not None:
        yield heads[top], lcp[top]
        heads[top] = new = next(runs[top], None)
        lcp[top] = new[1] if new else -1
        i = (top + k) // 2
        while i:
            top, losers[i] = match(top, losers[i])
            i //= 2


def repeats(group: list[tuple], lcps: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(home, row key, first, past) of bytes in repeated windows, for entries of one anchor sorted by suffix; lcps[i]: shared with the entry before."""
    kept, shares = [], []  # equal entries become one that is known as repeated
    for e, n in zip(group, lcps, strict=True):
        right, _, left, home, rk, p, many = e
        if kept and n == len(right) == len(kept[-1][0]) and left == kept[-1][2]:
            old = kept[-1]
            for x in (e, old):
                if not x[6]:
                    yield x[3], x[4], x[5] - len(left), x[5] + len(right)
            kept[-1] = (*old[:6], True)
        else:
            kept.append(e)
            shares.append(n)
    if len(kept) < 2:
        return
    if len(kept) <= PAIRS:
        for i, a in enumerate(kept):
            n = 1 << 30
            for j in range(i + 1, len(kept)):
                n = min(n, shares[j])
                b = kept[j]
                if a[6] and b[6] or n + min(len(a[2]), len(b[2])) < WINDOW:
                    continue
                m = shared(a[2], b[2])
                if m + n >= WINDOW:
                    for x in (a, b):
                        if not x[6]:
                            yield x[3], x[4], x[5] - m, x[5] + n
        return
    # classes of suffixes by their first bytes, and of left sides by their last: equal windows are in the same class of both
    n = len(kept)
    lens = np.array([len(e[0]) for e in kept])
    lefts = np.array([len(e[2]) for e in kept])
    order = sorted(range(n), key=lambda i: kept[i][2])
    share_l = np.array([0] + [shared(kept[a][2], kept[b][2]) for a, b in zip(order, order[1:], strict=False)])
    share_r, order = np.array(shares), np.array(order)
    share_r[0] = 0
    cls = np.empty(n, np.int64)
    for o in range(max(0, WINDOW - int(lens.max())), int(lefts.max()) + 1):
        ok = np.flatnonzero((lens >= WINDOW - o) & (lefts >= o))
        if len(ok) < 2:
            continue
        cls[order] = np.cumsum(share_l < o)
        pair = np.cumsum(share_r < WINDOW - o)[ok] * (n + 1) + cls[ok]
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        for i in ok[count[back] > 1].tolist():
            e = kept[i]
            if not e[6]:
                yield e[3], e[4], e[5] - o, e[5] - o + WINDOW


def _joined(ranges: Iterator[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[list] = []
    for home, rk, a, b in sorted(ranges):
        if out and out[-1][0] == home and out[-1][1] == rk and a <= out[-1][3]:
            out[-1][3] = max(out[-1][3], b)
        else:
            out.append([home, rk, a, b])
    return out


def _ranges(found: list) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [()] * 4
    n = len(found)
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) for k in KINDS[:4]] + [pa.array(c, k) for c, k in zip(cols, KINDS[4:], strict=True)], NAMES)


def distinct(entries: list[tuple], home: int, found: list[tuple]) -> list[tuple]:
    """A home's entries (suffix, reversed left side, row key, place, repeated) sorted, equal ones as one that is repeated; their ranges are added to found."""
    entries.sort()
    run: list[tuple] = []
    for e in entries:
        if run and e[0] == run[-1][0] and e[1] == run[-1][1]:
            for x in (e, run[-1]):
                if not x[4]:
                    found.append((home, x[2], x[3] - len(x[1]), x[3] + len(x[0])))
            run[-1] = (*run[-1][:4], True)
        else:
            run.append(e)
    return run


def hot_windows(run: list[tuple], home: int, shards: int, found: list[tuple]) -> pa.RecordBatch:
    """One row for each distinct window of a home's distinct entries of one hot anchor; ranges of those that occur twice there are added to found."""
    seen: dict[bytes, tuple | None] = {}
    for right, left, rk, p, many in run:
        text, start = left[::-1] + right, p - len(left)
        for i in range(len(text) - WINDOW + 1):
            key = xxhash.xxh3_128_digest(text[i : i + WINDOW])
            here = None if many else (home, rk, start + i, start + i + WINDOW)
            if key in seen:
                found += [x for x in (seen[key], here) if x]
                here = None
            seen[key] = here
    n = len(seen)
    shard = (np.frombuffer(b"".join(seen), ">u8")[::2] % np.uint64(shards)).astype(np.int32)
    one = [(x[1], x[2], 1) if x else (None, None, 2) for x in seen.values()]
    cols = [shard, np.full(n, HOT_RUN, np.int32), np.zeros(n, np.int32), list(seen), np.full(n, home, np.int32), *zip(*one, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)], NAMES)


def run_maker(shards: int):
    def make(key: tuple[pa.Scalar, ...], docs: pa.Table, keys: pa.Table) -> pa.Table:
        home = key[0].as_py()
        order = np.argsort(keys.column("key").to_numpy())
        wanted, often = keys.column("key").to_numpy()[order], keys.column("hot").to_numpy()[order]
        out: list[pa.RecordBatch] = []
        by: dict[int, list] = {}
        hot: dict[int, list] = {}
        texts_of = zip(docs.column("rk").to_pylist(), (t.as_py() for t in docs.column("text")), strict=True)
        for rks, texts in chunks(texts_of) if len(wanted) else ():
            doc, p, first, last, h = anchors(texts)
            at = np.minimum(np.searchsorted(wanted, signed(h)), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == signed(h))
            shard = (h[hit] % np.uint64(shards)).astype(int).tolist()
            for d, q, a, b, s, k in zip(doc[hit].tolist(), p[hit].tolist(), first[hit].tolist(), last[hit].tolist(), shard, at[hit].tolist(), strict=True):
                t = texts[d]
                group = hot.setdefault(k, []) if often[k] else by.setdefault(s, [])
                group.append((t[q : b + WINDOW], t[a:q][::-1], rks[d], q, False))
        found: list[tuple] = []
        while hot:
            out.append(hot_windows(distinct(hot.popitem()[1], home, found), home, shards, found))
        for s, entries in by.items():
            run = distinct(entries, home, found)
            entries.clear()
            for seq, block in enumerate(coded(run)):
                out.append(pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((s, home, seq, block, None, None, None, None), KINDS, strict=True)], NAMES))
        out.append(_ranges(_joined(found)))
        return pa.Table.from_batches(out)

    return make


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each shard's runs (rows sorted by shard, run, seq, payload); ranges that are known already pass through. A shard's windows of hot
    anchors come before its runs, equal ones one after the other, and are told apart as they stream by."""

    def finish(runs: dict[int, list[bytes]]) -> pa.RecordBatch:
        found: list[tuple] = []
        group: list[tuple] = []
        lcps: list[int] = []
        for e, n in merged([decoded(run, blocks) for run, blocks in runs.items()]):
            if n < GRAM and group:
                if len(group) > 1:
                    found += repeats(group, lcps)
                group, lcps = [], []
            group.append(e)
            lcps.append(n)
        if len(group) > 1:
            found += repeats(group, lcps)
        return _ranges(_joined(found))

    def again(windows: pa.RecordBatch) -> pa.RecordBatch:
        """Ranges of windows that other homes have too; the last window of a batch is kept for the next."""
        nonlocal last
        found = []
        for key, *here, n in zip(*(windows.column(c).to_pylist() for c in ("payload", "home", "rk", "first", "past")), strict=True):
            here = here if n == 1 else None
            if last and last[0] == key:
                found += [(*x, x[2] + WINDOW) for x in (last[1], here) if x]
                here = None
            last = (key, here)
        return _ranges(_joined(found))

    shard, runs, last = None, {}, None
    for batch in batches:
        known = batch.filter(batch.column("payload").is_null())
        if known.num_rows:
            yield known
        batch = batch.filter(batch.column("payload").is_valid())
        is_window = pc.equal(batch.column("run"), HOT_RUN)
        windows, batch = batch.filter(is_window), batch.filter(pc.invert(is_window))
        if windows.num_rows:
            yield again(windows)
        for s, run, block in zip(*(batch.column(c).to_pylist() for c in NAMES[:2]), (x.as_py() for x in batch.column("payload")), strict=True):
            if s != shard and runs:
                yield finish(runs)
                runs = {}
            shard = s
            runs.setdefault(run, []).append(block)
    if runs:
        yield finish(runs)


FINAL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary"


def finisher(with_text: bool):
    def finish(key: tuple[pa.Scalar, ...], docs: pa.Table, ranges: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for rk, a, b in zip(*(ranges.column(c).to_pylist() for c in ("rk", "first", "past")), strict=True):
            by.setdefault(rk, []).append((0, 0, a, b))
        out = []
        for doc_id, rk, text in zip(docs.column("doc_id").to_pylist(), docs.column("rk").to_pylist(), (t.as_py() for t in docs.column("text")), strict=True):
            spans = [s[2:] for s in _joined(by.get(rk, []))]
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            out.append((doc_id, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), spans if with_text else None, rest if with_text else None))
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in FINAL.split(", ")])

    return finish


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and, if with_text, spans (pairs of byte places) and kept.

    A byte goes if a WINDOW-byte string that covers it also starts anywhere else in the corpus, the same document
    included. A null text is empty; texts shorter than WINDOW lose nothing; repeated rows lose all that is WINDOW bytes long; rows without an id and rows that share one are
    judged each by its text; there are no ties, as every occurrence goes; kept may
    cut a character of several bytes, so it is binary; columns beside doc_id and text are left behind; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    dealt, homes = with_home(docs)
    hashes = dealt.select("text", "home").mapInArrow(_hashes, "key long, home int, n int")
    repeated = hashes.withColumn("all", F.sum("n").over(Window.partitionBy("key"))).filter("all > 1").select("home", "key", (F.col("all") > HOT).alias("hot"))
    runs = dealt.groupBy("home").cogroup(repeated.groupBy("home")).applyInArrow(run_maker(homes), RUNS)
    # ranges that are known already travel with their home's number as shard
    spread = F.coalesce("shard", F.pmod("home", F.lit(homes)))
    ranges = runs.repartition(homes, spread).sortWithinPartitions("shard", "run", "seq", "payload").mapInArrow(_merge, RUNS).select("home", "rk", "first", "past")
    final = dealt.groupBy("home").cogroup(ranges.groupBy("home")).applyInArrow(finisher(with_text), FINAL)
    return final if with_text else final.drop("spans", "kept")
