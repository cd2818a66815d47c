"""Pictures of any number of rows: tasks compress their own rows, the driver only joins checksums and the pieces.

The compressed stream of a PNG may be cut where a compressor was flushed in full, as nothing behind it refers to what is before. So each task sorts its range of rows, compresses
them into chunks of the file with their own CRC-32, and tells the Adler-32 and the length of its raw rows. The driver computes the Adler-32 of
the whole from these, counts the rows, and copies chunk after chunk, one of a MB at a time, behind the header.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import checkpointer

#: The modulus of Adler-32, and compressed bytes of one chunk.
BASE, CHUNK = 65521, 1 << 20


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def adler_of_both(first: int, second: int, length: int) -> int:
    """The Adler-32 of two stretches one after the other, from that of each and the length of the second: the low half sums bytes, the high half sums the low one after each byte."""
    low = (first % 65536 + second % 65536 - 1) % BASE
    high = ((first >> 16) + (second >> 16) + length % BASE * (first % 65536 - 1)) % BASE
    return high << 16 | low


def compressed(rows: Iterator[bytes]) -> Iterator[tuple[bytes, int, int, int]]:
    """(chunk of the file, Adler-32, bytes, rows) of picture rows; the checksum and counts are of all rows up to that chunk."""
    z = zlib.compressobj(wbits=-15)
    held, adler, size, n = [], 1, 0, 0
    waiting = 0
    for row in rows:
        row = b"\0" + row  # no filter
        adler, size, n = zlib.adler32(row, adler), size + len(row), n + 1
        made = z.compress(row)
        held.append(made)
        waiting += len(made)
        if waiting > CHUNK:
            yield chunk(b"IDAT", b"".join(held)), adler, size, n
            held, waiting = [], 0
    held.append(z.flush(zlib.Z_FULL_FLUSH))
    yield chunk(b"IDAT", b"".join(held)), adler, size, n


def write(rows: DataFrame, order: list[str], source: str, line: Callable, width: int, head: list[bytes], path: str) -> None:
    """Writes an RGB picture to path (any file system that Spark knows): the rows of `head`, then line(source) of each row, 3 * width bytes, sorted by `order`.

    An empty table gives the head alone. Rows that are equal in `order` stand beside each other in any order. Pieces are kept in Spark's shared folder, so a lost executor or a repeated task does no harm.
    """
    spark = rows.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        lines = (line(x) for batch in batches for x in batch.column(source).to_pylist())
        for k, (data, adler, size, n) in enumerate(compressed(lines)):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, k, data, adler, size, n), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "k", "data", "adler", "size", "n"])

    made = checkpointer(spark)(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task, "part int, k int, data binary, adler long, size long, n long"))
    ends = made.groupBy("part").agg(*[F.max_by(c, "k").alias(c) for c in ("adler", "size", "n")]).orderBy("part").collect()  # three numbers a task
    (first, adler, _, height), *_ = compressed(iter(head))
    for e in ends:
        adler, height = adler_of_both(adler, e["adler"], e["size"]), height + e["n"]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    try:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c") + first)
        for r in made.select("part", "k", "data").orderBy("part", "k").toLocalIterator():
            out.write(bytes(r["data"]))
        # an empty last block ends the stream
        out.write(chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + chunk(b"IEND", b""))
    finally:
        out.close()
