"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests), a local one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="hopweave-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Tables written once and read back: they cut lineage and survive the loss of an executor.

    ``drop`` removes a table that no later plan reads; the tables behind a returned DataFrame stay until the caller
    clears the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, partition_by: str | None = None) -> str:
        self.count += 1
        path = f"{self.root}/{self.count}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.write(df)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished plans now rather than at the driver's next collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df_or_path: DataFrame | str) -> None:
        """Removes a table that ``keep`` returned, or a path that ``write`` did."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = df_or_path if isinstance(df_or_path, str) else df_or_path.scratch_path
        if not path.split(":", 1)[-1].lstrip("/").startswith(self.root.split(":", 1)[-1].lstrip("/")):
            raise ValueError(f"{path} is not a table of this run")
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
