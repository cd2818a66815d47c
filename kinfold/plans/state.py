"""Frames that cut lineage between the rounds of an iterative plan."""

from __future__ import annotations

import tempfile
import uuid
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a temporary folder in local mode, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Checkpoints:
    """Calling it writes a frame into the shared folder and reads it back; `forget` removes such tables when nothing is read from them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.where = spark, shared_dir(spark)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.where}/state-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.saved_at = path
        return out

    def forget(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "saved_at", None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def checkpointer(spark: SparkSession) -> Checkpoints:
    return Checkpoints(spark)
