"""Reading tables of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df's rows over all cores if it has fewer files than there are cores, since a file of one row group is one task's, however large. Large tables have many files, and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path))
