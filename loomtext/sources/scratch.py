"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (in tests, where it is unset) a folder of our own; that is no choice on a cluster, whose machines could not read it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtext-"))
        folder = sc.getCheckpointDir()
    return folder


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a read, not the whole history."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.schemas: dict[str, StructType] = {}

    def cut(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}")
        self.schemas[table] = df.schema
        return self.read(table)

    def read(self, table: str) -> DataFrame:
        """A table already cut, with columns of its own (so it can be joined with what came from an earlier read)."""
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/{table}")

    def drop(self, table: str) -> None:
        """Deletes a table that no plan still to be run reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
