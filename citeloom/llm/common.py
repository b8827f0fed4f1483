"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.runtime import configure, fresh_dir

BATCH_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: UTC, and Arrow batches bounded by bytes, since one text
    may be as long as thousands of others."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    Like a checkpoint it is computed once and survives a lost executor; unlike one it can be read by column.
    """
    folder = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments, so that reruns agree."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; one that ``df`` already has under that name is replaced."""
    return df.withColumns(columns)
