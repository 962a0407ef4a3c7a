"""Access to the input tables: one parquet file (or folder) per table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table; naming columns prunes the scan (ReadSchema shows only them)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


PIECE = 8 << 20     # bytes of a table, as stored, that a task takes on


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A scan of few files dealt over all cores by ``key`` before costly work in the row (a file of one row
    group is one task), about PIECE bytes a task, so that tasks grow in number and not in size; a scan of as
    many files as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(2 * cores, -(-size // PIECE))
    files = len(df.inputFiles())
    return df if files >= max(cores, -(-size // PIECE)) else df.repartition(wanted, key)
