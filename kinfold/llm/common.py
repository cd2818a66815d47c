"""Helpers that the operators share: reading tables, shared folders, cutting lineage, byte texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python: documents may be long, so batches are short.
ROWS_PER_BATCH = 2000
#: Text bytes of one home group (see `with_home`): what one task holds in memory at once.
GROUP_BYTES = 10 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder (or `folder`) and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/kinfold-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder under the shared one for tables of which nothing is read after the block ends; it is removed then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/kinfold-scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        return written(df, label, self.folder)


#: The most rows (of a few numbers each) of a table that is broadcast.
BROADCAST_ROWS = 500_000


def broadcastable(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most BROADCAST_ROWS rows: a larger one is joined by shuffling both sides."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def plainly_named(docs: DataFrame, *used: str) -> DataFrame:
    """docs with all columns but the used ones under names of ours, by their places: so no name, dotted or equal to another but for its case, is ever looked up."""
    return docs.toDF(*[c if c in used else f"_{k}_column" for k, c in enumerate(docs.columns)])


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, and that column's name, which differs from all others in more than case. Written, so that every reading finds the same numbers."""
    name, others = "_row", {c.casefold() for c in docs.columns}
    while name in others:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def carried(docs: DataFrame, *used: str) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """`keyed` for a result that has the columns of docs: only the used ones keep their names meanwhile (see `plainly_named`); the last is what gives a table made from it those columns back."""
    plain = plainly_named(docs, *used)
    held, row = keyed(plain)
    return held, row, lambda df: df.select(*plain.columns).toDF(*docs.columns)


def byte_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id long, text binary), and the numbers of `keyed` as row if named, nothing else; a null text becomes the empty one. Extra or clashing columns are left behind here."""
    docs = plainly_named(docs, id_col, text_col, *([row] if row else []))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *([F.col(row).alias("row")] if row else []))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, text) of each row of Arrow batches made by `byte_texts`."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for i in range(batch.num_rows):
            yield ids[i].as_py(), texts[i].as_py()


def with_home(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, rk, home) dealt by `home`, and the number of homes.

    A home is a group of about GROUP_BYTES of text by a hash of id and text, so that rows that share an id, or have none, don't meet in one; rk tells rows of one home apart (rows equal in
    id and text share it, and share every result). Keys gathered over the whole corpus come back to the
    homes that asked for them, so nothing is broadcast and no task holds more than a home. Documents are
    dealt once; Spark reuses the exchange wherever the same frame is read again.
    """
    base = byte_texts(docs)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = max(1, -(-total // GROUP_BYTES))
    return base.withColumn("rk", F.xxhash64("doc_id", "text")).withColumn("home", F.pmod("rk", F.lit(homes)).cast("int")).repartition(homes, "home"), homes


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
