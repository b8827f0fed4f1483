"""Session settings and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LISTING_TASKS = 64  # tasks that list the folders of a table; by default there is one for each folder


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on: UTC timestamps, and one state store for every stream. Folders are listed many to a task."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir``, else a test folder.

    A machine-local folder is only acceptable when the whole "cluster" is this machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return current


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    Used where a plan must be evaluated exactly once: iteration, and range boundaries that Spark samples anew on
    every evaluation. Readers prune columns, and the files outlive any executor.
    """
    folder = fresh_dir(df.sparkSession, "stage")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that grows with the input: the join is not planned as a broadcast.

    Before anything ran, Spark takes the size of files for that of rows. Packed columns, and texts and arrays made of a few of them, are
    many times as large in the driver, which would build the table.
    """
    return df.hint("merge")
