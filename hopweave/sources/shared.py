"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where a local session has none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hopweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def forget(df: DataFrame) -> None:
    """Removes a table that ``keep`` wrote and that no later plan reads; other frames are left alone."""
    if path := getattr(df, "kept_path", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Has the driver collect garbage: Spark then removes the shuffle files of plans that nothing refers to any more. Left
    alone it does so half an hour apart, and an iteration's files of all rounds stay on the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


TASK_ROWS = 500_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """The rows of df by a hash of keys, over as many tasks as an exchange has, and more where ``rows`` would be over
    TASK_ROWS a task: small files and large ones are both read in few tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // TASK_ROWS)), *keys)


def bucketed(df: DataFrame, column: str, exchange: bool = True, buckets: int = 0) -> DataFrame:
    """The rows of df, written in buckets of a column, as many as an exchange has partitions unless ``buckets`` says another
    number, and read back until drop_bucketed. Without exchange where rows lie so already. Numbers of iterations hardly
    repeat, so neither dictionaries nor compression are tried."""
    spark = df.sparkSession
    n, name = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), f"hopweave_{uuid.uuid4().hex}"
    placed = df.repartition(n, column) if exchange else df
    placed.write.format("parquet").option("parquet.enable.dictionary", "false").option("compression", "none").bucketBy(n, column).option("path", f"{shared_root(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.bucketed_name = name
    return table


def drop_bucketed(df: DataFrame) -> None:
    """Removes a table that ``bucketed`` wrote, with its files."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE {df.bucketed_name}")
    _delete(spark, f"{shared_root(spark)}/{df.bucketed_name}")


@contextlib.contextmanager
def kept_by(df: DataFrame, *columns: str) -> Iterator[DataFrame]:
    """df written in buckets of columns, as many as an exchange has partitions: joins on them then move only the other side.
    The table leaves the catalog at the end; its files stay in the shared folder."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"hopweave_{uuid.uuid4().hex}"
    df.repartition(n, *columns).write.format("parquet").bucketBy(n, *columns).sortBy(*columns).option("path", f"{shared_root(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
