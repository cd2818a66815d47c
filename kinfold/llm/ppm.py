"""LM scoring (2): prediction by partial matching over bytes, pretrained on the corpus.

The model is a byte-context trie of depth ORDER, held as a table: each context of ORDER bytes with each byte (or the
end) that follows it, and how often in the training texts; shorter contexts are sums of it. The probability of a
symbol is PPM's: from the longest context on, a symbol with count c of n in a context with d distinct symbols has (2c - 1) / 2n; a
symbol not seen there costs an escape of d / 2n, and the symbols of longer contexts are excluded from shorter ones; at
last what is left of the 257 symbols is equally likely. It depends on the last ORDER bytes alone, so it is worked out once per distinct context
and symbol of the whole corpus, where all contexts that end in the same three bytes meet with the counts after the last two, and comes back to the homes whose
documents hold it. Words and their counts, for the base score, travel the same way. Nothing is broadcast but
the counts after single bytes (at most 256 * 257 numbers).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, with_home, written

ORDER, END, SYMBOLS = 5, 256, 257
#: Bytes of text that are packed in one go, and counts of grams that a home holds before it adds up equal ones.
CHUNK, UNMERGED = 1 << 20, 1 << 21
#: Bytes of short texts that are scored in one go.
SCORED = 1 << 16
#: Homes that one row of the table of keys names at most; a key of more homes has several rows.
HOMES = 4096
#: The end of a document in the table of words: no word holds white space.
END_WORD = b" "
SPACE = re.compile(rb"[ \t-\r]")


def packed(texts: list[bytes]) -> np.ndarray:
    """Of each place of the texts, and of the end of each: the ORDER bytes before (0 before the start) in the high bits, the symbol in the low 9."""
    gap = bytes(1 + ORDER)  # a place for the end, and what comes before the next text
    data = np.frombuffer(bytes(ORDER) + gap.join(texts) + b"\0", np.uint8).astype(np.int64)
    key = data.copy()
    ends = ORDER + np.cumsum([len(t) + 1 + ORDER for t in texts]) - 1 - ORDER
    key[ends] = END
    for back in range(1, ORDER + 1):
        key[back:] |= data[:-back] << (9 + 8 * (back - 1))
    keep = np.ones(len(key), bool)
    keep[:ORDER] = False
    for skip in range(1, ORDER + 1):
        keep[ends[:-1] + skip] = False
    return key[keep]


def packed_pieces(text: bytes) -> Iterator[np.ndarray]:
    """`packed` of one lower-cased text, CHUNK bytes at a time, each piece with the ORDER bytes before it."""
    for a in range(0, max(1, len(text)), CHUNK):
        before = min(a, ORDER)
        keys = packed([text[a - before : a + CHUNK].lower()])
        yield keys[before : None if a + CHUNK >= len(text) else -1]


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, some CHUNK bytes of it at a time; cuts are made at white space only."""
    a = 0
    while a < len(text):
        space = SPACE.search(text, a + CHUNK)
        b = space.start() if space else len(text)
        yield text[a:b].lower().split()
        a = b


def summed(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of grams with equal ones added up."""
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, back = np.unique(np.concatenate([k for k, _ in grams]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in grams]), len(keys)).astype(np.int64)


class Lookup:
    """A table from keys to values that answers whole arrays at once (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.values[slot[mine]] = values[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, all of which are in the table."""
        slot = self._slot(keys)
        out = self.values[slot]
        left = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot] == keys[left]
            out[left[found]] = self.values[slot[found]]
            left, slot = left[~found], slot[~found]
        return out


def trains(doc_id, by: int | None = 7, out: int = 2):
    """Whether a document is learnt from: crc32 of its id as text modulo `by` isn't `out`."""
    import zlib

    return by is None or zlib.crc32(str(doc_id).encode()) % by != out if doc_id is not None else True


COUNTS = "home int, word binary, gram long, n long"


def counter(by: int | None, out: int):
    def count(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        home = key[0].as_py()
        words: Counter = Counter()
        seen: set[bytes] = set()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        held: dict[bool, list[bytes]] = {True: [], False: []}

        def add(keys: np.ndarray, train: bool) -> None:
            k, n = np.unique(keys, return_counts=True)
            grams.append((k, n if train else np.zeros_like(n)))
            # what is added up counts as new only once: a home of many distinct grams isn't summed again for each piece
            if len(grams) > 1 and sum(len(k) for k, _ in grams[1:]) > max(UNMERGED, len(grams[0][0])):
                grams[:] = [summed(grams)]

        def flush(train: bool) -> None:
            if held[train]:
                add(packed(held[train]), train)
                held[train] = []

        size = {True: 0, False: 0}
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), (t.as_py() for t in docs.column("text")), strict=True):
            train = trains(doc_id, by, out)
            for split in word_pieces(text):
                words.update(split) if train else seen.update(split)
            words[END_WORD] += train
            if len(text) > CHUNK:
                for keys in packed_pieces(text):
                    add(keys, train)
                continue
            held[train].append(text.lower())
            size[train] += len(text)
            if size[train] > CHUNK:
                flush(train)
                size[train] = 0
        flush(True)
        flush(False)
        for w in (*seen, END_WORD):
            words[w] += 0
        keys, total = summed(grams)
        a, b = len(words), len(keys)
        return pa.table(
            {
                "home": pa.array(np.full(a + b, home, np.int32)),
                "word": pa.concat_arrays([pa.array(list(words), pa.binary()), pa.nulls(b, pa.binary())]),
                "gram": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(keys)]),
                "n": pa.concat_arrays([pa.array(list(words.values()), pa.int64()), pa.array(total)]),
            }
        )

    return count


def chances(grams: np.ndarray, counts: np.ndarray, two: dict[int, int], low: dict[int, dict[int, int]], zero: dict[int, int]) -> np.ndarray:
    """log10 of the probability of each (context, symbol); grams are all those whose contexts end in the same three bytes, two the counts of
    symbols after the last two of these, low those after each single byte, zero those of symbols."""
    tables: dict[int, dict[int, int]] = {}
    mask = [(1 << (8 * k)) - 1 for k in range(ORDER + 1)]
    contexts, symbols = (grams >> 9).tolist(), (grams & 511).tolist()
    for ctx, sym, n in zip(contexts, symbols, counts.tolist(), strict=True):
        if n:
            for k in range(3, ORDER + 1):
                t = tables.setdefault((k << 60) | (ctx & mask[k]), {})
                t[sym] = t.get(sym, 0) + n
    #: per chain of contexts: (symbols' chances so far as log10, escape so far)
    memo: dict[int, tuple[dict[int, float], float]] = {}

    def chain(ctx: int) -> tuple[dict[int, float], float]:
        """The log10 chances of all symbols seen after ctx or its endings, and of each other symbol."""
        if ctx in memo:
            return memo[ctx]
        found: dict[int, float] = {}
        cost = 0.0
        for k in range(ORDER, -1, -1):
            t = tables.get((k << 60) | (ctx & mask[k])) if k > 2 else two if k == 2 else low.get(ctx & 255) if k == 1 else zero
            if not t:
                continue
            rest = {s: c for s, c in t.items() if s not in found} if found else t
            if not rest:
                continue
            n = 2 * sum(rest.values())
            # when nothing but these is left, there is no escape to pay for
            whole = len(found) + len(rest) == SYMBOLS
            n -= whole * len(rest)
            for s, c in rest.items():
                found[s] = cost + math.log10((2 * c - 1) / n)
            if whole:
                break
            cost += math.log10(len(rest) / n)
        left = SYMBOLS - len(found)
        memo[ctx] = found, cost - math.log10(left) if left else -math.inf
        return memo[ctx]

    out = np.empty(len(grams))
    last = None
    for i, (ctx, sym) in enumerate(zip(contexts, symbols, strict=True)):
        if ctx != last:
            memo.clear()
            found, other = chain(ctx)
            last = ctx
        out[i] = found.get(sym, other)
    return out


def scorer(low: dict[int, dict[int, int]], zero: dict[int, int]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (ending, gram, n, homes) sorted by ending and gram; rows without homes are the counts after the last two bytes."""

        def finish(parts: list) -> Iterator[pa.RecordBatch]:
            grams, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            homes = pa.concat_arrays([p[2] for p in parts])
            own = homes.is_valid().to_numpy(zero_copy_only=False)
            two = dict(zip((grams[~own] & 511).tolist(), counts[~own].tolist(), strict=True))
            if not own.any():
                return
            grams, counts, homes = grams[own], counts[own], homes.filter(pa.array(own))
            distinct, back = np.unique(grams, return_inverse=True)
            logs = chances(distinct, np.bincount(back, counts, len(distinct)).astype(np.int64), two, low, zero)[back]
            where = np.repeat(np.arange(len(grams)), homes.value_lengths().to_numpy())
            flat = homes.flatten()
            for a in range(0, len(flat), 100_000):
                w = where[a : a + 100_000]
                yield pa.RecordBatch.from_pydict({"home": flat.slice(a, 100_000), "gram": pa.array(grams[w]), "value": pa.array(logs[w])})

        held: list = []
        ending = None
        for batch in batches:
            ends = batch.column("ending").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ends)) + 1, [len(ends)]]).tolist()
            grams, n, homes = batch.column("gram").to_numpy(), batch.column("n").to_numpy(), batch.column("homes")
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and ends[a] != ending:
                    yield from finish(held)
                    held = []
                ending = ends[a]
                held.append((grams[a:b], n[a:b], homes.slice(a, b - a)))
        if held:
            yield from finish(held)

    return score


FINAL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finisher(tokens: int, distinct: int, by: int | None, out: int):
    def finish(key: tuple[pa.Scalar, ...], docs: pa.Table, model: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        is_word = model.column("word").is_valid()
        words = model.filter(is_word)
        log_all = math.log10(tokens + distinct + 1)
        logs = np.log10(words.column("value").to_numpy() + 1) - log_all
        value = dict(zip(words.column("word").to_pylist(), logs.tolist(), strict=True))
        new = -log_all + 1e-9  # no more than a word gets that wasn't learnt
        end = value.pop(END_WORD, -log_all)
        rest = model.filter(pc.invert(is_word))
        table = Lookup(rest.column("gram").to_numpy(), rest.column("value").to_numpy())
        result, scores = [], []
        held: list[bytes] = []

        def score_held() -> None:
            if held:
                starts = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
                scores.extend(np.add.reduceat(table.of(packed(held)), starts).tolist())
                held.clear()

        size = 0
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), (t.as_py() for t in docs.column("text")), strict=True):
            n, known, base = 1, int(end > new), 0.0
            for split in word_pieces(text):
                own = np.fromiter(map(value.__getitem__, split), np.float64, len(split))
                n, known, base = n + len(split), known + int((own > new).sum()), base + float(own.sum())
            result.append((doc_id, not trains(doc_id, by, out), n, known, tokens, base + end))
            if len(text) > SCORED:
                score_held()
                scores.append(sum(float(table.of(keys).sum()) for keys in packed_pieces(text)))
                continue
            held.append(text.lower())
            size += len(text)
            if size > SCORED:
                score_held()
                size = 0
        score_held()
        cols = [*zip(*result, strict=True), scores] if result else [()] * 7
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in FINAL.split(", ")])

    return finish


def scored(docs: DataFrame, by: int | None = 7, out: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the probability of the lower-cased text and its end).

    Learns from the documents whose crc32(doc_id) modulo `by` isn't `out` (by None: from all); rows without an id are learnt from. A null text
    is empty: its score is that of the end alone. Without any training text all symbols are equally likely; an empty table gives no rows. Rows repeated whole
    are learnt from as often as they stand there and have a row each; texts of any length are
    counted and scored whole, a piece of CHUNK bytes at a time (a task holds the text itself and the distinct grams of its home); columns beside doc_id and text are left behind.
    """
    spark = docs.sparkSession
    short_batches(spark)
    dealt, homes = with_home(docs)
    counts = dealt.select("doc_id", "text", "home").groupBy("home").applyInArrow(counter(by, out), COUNTS)
    # a home asks once for each of its words and grams, so no key has more rows than there are homes
    # (dealt before they are grouped: the keys of a home are distinct, so there is nothing to add up in its task)
    dealt_keys = counts.withColumn("part", F.floor(F.col("home") / HOMES).cast("int")).repartition("word", "gram", "part")
    keys = written(dealt_keys.groupBy("word", "gram", "part").agg(F.sum("n").alias("n"), F.collect_list("home").alias("homes")), "keys")
    words = keys.filter("word is not null").select("word", "n", "homes", "part")
    if homes > HOMES:
        words = words.withColumn("n", F.sum("n").over(Window.partitionBy("word")))
    ending = lambda mask: F.shiftright("gram", 9).bitwiseAND(F.lit(mask)).cast("int")
    grams = keys.filter("gram is not null").select("gram", "n", "homes", ending(0xFFFFFF).alias("ending"))
    every = words.groupBy("word").agg(F.max("n").alias("n")) if homes > HOMES else words
    tokens, distinct = every.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    # counts after single bytes: 256 * 257 numbers at most
    low: dict[int, dict[int, int]] = {}
    zero: dict[int, int] = {}
    for r in grams.filter("n > 0").groupBy(F.col("ending").bitwiseAND(F.lit(255)).alias("c"), F.col("gram").bitwiseAND(F.lit(511)).alias("s")).agg(F.sum("n").alias("n")).collect():
        low.setdefault(r["c"], {})[r["s"]] = r["n"]
        zero[r["s"]] = zero.get(r["s"], 0) + r["n"]
    # counts after two bytes go to each ending that has them: endings and symbols are some thousands each, whatever the corpus
    two = grams.filter("n > 0").groupBy(F.col("ending").bitwiseAND(F.lit(0xFFFF)).alias("last"), F.col("gram").bitwiseAND(F.lit(511)).alias("gram")).agg(F.sum("n").alias("n"))
    endings = grams.select("ending").distinct().withColumn("last", F.col("ending").bitwiseAND(F.lit(0xFFFF)))
    after_two = endings.join(two, "last").select("ending", "gram", "n", F.lit(None).cast("array<int>").alias("homes"))
    both = grams.select("ending", "gram", "n", "homes").unionByName(after_two)
    by_gram = both.repartition("ending").sortWithinPartitions("ending", "gram").mapInArrow(scorer(low, zero), "home int, gram long, value double")
    by_word = words.select(F.explode("homes").alias("home"), "word", F.col("n").cast("double").alias("value"))
    model = by_gram.withColumn("word", F.lit(None).cast("binary")).unionByName(by_word.withColumn("gram", F.lit(None).cast("long"))).select("home", "word", "gram", "value")
    return dealt.groupBy("home").cogroup(model.groupBy("home")).applyInArrow(finisher(int(tokens), int(distinct), by, out), FINAL)
