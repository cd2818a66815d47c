"""Exact dedup (7): a cuckoo-filter index of live digests, one shard per task.

Texts are equal when identical after lower-casing A-Z. Each input partition runs its rows through a
local index and sends one row per distinct text (digest, largest id, count, ids): a group of copies,
however large, reaches a shard as one row per partition. Shards are dealt by digest; there a cuckoo
filter answers whether a digest is live, every hit is verified against the full 256-bit digest kept in
the bucket (a false positive is a miss), and overflow rebuilds the filter, twice as large, from the stored keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, carried, rows, short_batches, written

SLOTS, KICKS = 4, 200
#: Distinct texts, and ids, of one local index before it is flushed; the shards merge what several flushes send.
LOCAL_TEXTS, LOCAL_IDS = 200_000, 500_000
#: Texts that one shard's index holds, about: more texts are dealt to more shards.
SHARD_TEXTS = 1_000_000


class CuckooIndex:
    """Live digests (bytes of at least 16) with an integer payload each; supports insertion, lookup, deletion.

    `table` holds 16-bit fingerprints (0: free), SLOTS to a bucket; `content[bucket]` holds the
    (digest, entry) pairs whose fingerprints are in that bucket, which hits are verified against.
    """

    def __init__(self, buckets: int = 64):
        self._size(buckets)
        self.n = 0

    def _size(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.content: list[list] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[:2], "little") or 1
        a = int.from_bytes(digest[2:8], "little") & self.mask
        return print_, a, self._other(a, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def get(self, digest: bytes) -> list | None:
        """The digest's own [digest, payload] entry, or None."""
        print_, a, b = self._places(digest)
        for bucket in (a, b) if a != b else (a,):
            if print_ in self.table[bucket].tolist():  # the filter says: maybe
                for entry in self.content[bucket]:
                    if entry[0] == digest:
                        return entry
        return None

    def insert(self, digest: bytes, payload) -> None:
        """Inserts a digest that isn't live yet."""
        self.n += 1
        if not self._put([digest, payload]):
            self._grow()

    def _put(self, entry: list) -> bool:
        print_, a, b = self._places(entry[0])
        for bucket in (a, b):
            if len(self.content[bucket]) < SLOTS:
                self._store(bucket, entry, print_)
                return True
        bucket = a
        for kick in range(KICKS):  # move a stored entry to its other bucket; a full round of kicks is an overflow
            slot = kick % SLOTS
            old = self.content[bucket][slot]
            self.content[bucket][slot], self.table[bucket, slot] = entry, print_
            entry, (print_, a, b) = old, self._places(old[0])
            bucket = b if bucket == a else a
            if len(self.content[bucket]) < SLOTS:
                self._store(bucket, entry, print_)
                return True
        self.spare = entry
        return False

    def _store(self, bucket: int, entry: list, print_: int) -> None:
        self.table[bucket, len(self.content[bucket])] = print_
        self.content[bucket].append(entry)

    def _grow(self) -> None:
        stored = [*self.entries(), self.spare]
        buckets = 2 * (self.mask + 1)
        while True:
            self._size(buckets)
            if all(self._put(e) for e in stored):
                return
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        """Removes a live digest; False if it isn't live."""
        print_, a, b = self._places(digest)
        for bucket in (a, b):
            for slot, entry in enumerate(self.content[bucket]):
                if entry[0] == digest:
                    last = len(self.content[bucket]) - 1
                    self.content[bucket][slot] = self.content[bucket][last]
                    self.table[bucket, slot] = self.table[bucket, last]
                    self.table[bucket, last] = 0
                    self.content[bucket].pop()
                    self.n -= 1
                    return True
        return False

    def entries(self) -> list[list]:
        return [e for bucket in self.content for e in bucket]


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text.lower()).digest()  # bytes.lower() changes A-Z only


def _dealt(found: DataFrame, texts: int) -> DataFrame:
    """Rows by digest in as many shards as `texts` need, Spark's own number at least."""
    shards = -(-texts // SHARD_TEXTS)
    return found.repartition(shards, "digest") if shards > int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")) else found.repartition("digest")


LOCAL = "digest binary, top long, n long, ids array<long>"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, held = CuckooIndex(), 0

    def flushed() -> pa.RecordBatch:
        es = index.entries()
        ids = pa.array([e[1] for e in es], pa.list_(pa.int64()))
        top = pa.array([max((x for x in e[1] if x is not None), default=None) for e in es], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in es], pa.binary()), top, pa.array([len(e[1]) for e in es], pa.int64()), ids], ["digest", "top", "n", "ids"])

    for doc_id, text in rows(batches):
        d = digest(text)
        if (entry := index.get(d)) is None:
            index.insert(d, [doc_id])
        else:
            entry[1].append(doc_id)
        held += 1
        if index.n >= LOCAL_TEXTS or held >= LOCAL_IDS:
            yield flushed()
            index, held = CuckooIndex(), 0
    yield flushed()


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for d, top, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "top", "n")), strict=True):
            if (entry := index.get(d)) is None:
                index.insert(d, [top, n])
            else:
                entry[1][1] += n
                if top is not None and (entry[1][0] is None or top > entry[1][0]):
                    entry[1][0] = top
    es = index.entries()
    for i in range(0, len(es), 10_000):
        part = es[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.binary()), pa.array([e[1][0] for e in part], pa.int64()), pa.array([e[1][1] for e in part], pa.int64())], ["digest", "keep_id", "group_size"])


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of equal texts stays; a null text counts as empty; rows without
    an id are members (counted) and stay only in a group without any id; an empty table gives no rows;
    if an id is repeated with equal texts, each of its rows counts and is reported; texts of any length are compared whole; columns beside doc_id and text are left behind.
    """
    short_batches(docs.sparkSession)
    local = written(byte_texts(docs).mapInArrow(_local, LOCAL), "digests")
    live = _dealt(local.select("digest", "top", "n"), local.count()).mapInArrow(_shard, "digest binary, keep_id long, group_size long")
    per_text = local.select("digest", "ids").join(live, "digest")
    return per_text.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


TOP = "digest binary, top long, row long"


def _tops(found: Iterator[tuple[bytes, int | None, int]], flush: int | None = None) -> Iterator[pa.RecordBatch]:
    """The largest (id, row) of each digest, rows without an id last; every `flush` digests if given."""

    def out() -> Iterator[pa.RecordBatch]:
        es = index.entries()
        for i in range(0, len(es), 10_000):
            part = es[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.binary()), pa.array([e[1][1] for e in part], pa.int64()), pa.array([e[1][2] for e in part], pa.int64())], ["digest", "top", "row"])

    index = CuckooIndex()
    for d, doc_id, row in found:
        own = (doc_id is not None, doc_id, row)
        if (entry := index.get(d)) is None:
            index.insert(d, own)
        elif own > entry[1]:
            entry[1] = own
        if flush and index.n >= flush:
            yield from out()
            index = CuckooIndex()
    yield from out()


def _local_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tops(((digest(text), i, row) for b in batches for (i, text), row in zip(rows([b]), b.column("row").to_pylist(), strict=True)), LOCAL_TEXTS)


def _shard_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tops(x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("digest", "top", "row")), strict=True))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts, of those with its largest doc_id if it has any.

    Rows repeated whole are copies like others, and an id repeated with another text is judged text by text. Null and empty texts are one group; of ties any one row stays; other columns
    pass through whatever their names; texts of any length are compared whole, by a 256-bit digest; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    held, row, restored = carried(docs, "doc_id", "text")
    keep = _dealt(byte_texts(held, row=row).mapInArrow(_local_tops, TOP), held.count()).mapInArrow(_shard_tops, TOP).select(F.col("row").alias("_keep"))
    return restored(held.join(keep, held[row] == keep["_keep"], "left_semi"))


#: Shards of an index, at least; each row of its table says how many there are.
SHARDS = 64
INDEX = "shards int, shard int, digest binary, keep_id long, group_size long"


def _shard_of(digest_column: str, shards: int):
    return F.pmod(F.xxhash64(digest_column), F.lit(shards)).cast("int")


def live_index(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The index as a table (shards, shard, digest, keep_id, group_size), to be stored and changed by `changed_index`. There are as many shards as the documents need unless `shards` says so.

    A row a distinct text: a null text is the empty one, repeated rows count each, keep_id is the largest id (null where no row has one);
    columns beside doc_id and text are left behind; an empty table gives an index without rows.
    """
    short_batches(docs.sparkSession)
    n = docs.count()
    shards = shards or max(SHARDS, -(-n // SHARD_TEXTS))
    live = _dealt(byte_texts(docs).mapInArrow(_local, LOCAL).select("digest", "top", "n"), n).mapInArrow(_shard, "digest binary, keep_id long, group_size long")
    return live.select(F.lit(shards).alias("shards"), _shard_of("digest", shards).alias("shard"), "digest", "keep_id", "group_size")


def changed_index(index: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """A new index table after deleting the digests of `removed` (texts) and inserting those of `added` (doc_id, text).

    Each shard rebuilds its filter from the stored keys, deletes, then inserts; texts that are live
    already keep their keep_id unless an added id is larger, and count the added rows. Deleting a text that isn't live does nothing, and one
    deletion takes the text out however many rows it counted. An index without rows gets SHARDS shards.
    """
    known = index.select("shards").first()
    shards = known[0] if known else SHARDS

    def changes(docs: DataFrame, kind: int) -> DataFrame:
        d = byte_texts(docs) if "doc_id" in docs.columns else byte_texts(docs.withColumn("doc_id", F.lit(None).cast("long")))
        low = d.mapInArrow(_local, LOCAL)
        return low.select(_shard_of("digest", shards).alias("shard"), "digest", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.lit(kind).alias("kind"))

    todo = index.select("shard", "digest", "keep_id", "group_size").withColumn("kind", F.lit(0))
    for docs, kind in ((removed, 1), (added, 2)):
        if docs is not None:
            todo = todo.unionByName(changes(docs, kind))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard and kind: one filter at a time."""

        def out() -> Iterator[pa.RecordBatch]:
            es = ix.entries()
            for i in range(0, len(es), 10_000):
                part = es[i : i + 10_000]
                columns = [[shards] * len(part), [last] * len(part), [e[0] for e in part], [e[1][0] for e in part], [e[1][1] for e in part]]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])

        last, ix = None, CuckooIndex()
        for batch in batches:
            for shard, d, top, n, kind in zip(*(batch.column(c).to_pylist() for c in ("shard", "digest", "keep_id", "group_size", "kind")), strict=True):
                if shard != last:
                    yield from out()
                    last, ix = shard, CuckooIndex()
                entry = ix.get(d)
                if kind == 1:
                    ix.delete(d)
                elif entry is None:
                    ix.insert(d, [top, n])
                else:
                    entry[1] = [max((x for x in (entry[1][0], top) if x is not None), default=None), entry[1][1] + n]
        yield from out()

    return todo.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(applied, INDEX)
