"""Sinks: one CSV file for a result table, Parquet for stages, dense rows for residuals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, **renamed: str) -> None:
    """A gene-sized table as one CSV file with a header; renamed: column -> name in the file."""
    df.withColumnsRenamed(renamed).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a stage's folder has its success marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at ``path``; made and written first if it is not finished."""
    if again or not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dense_rows(residuals: DataFrame, value: str) -> DataFrame:
    """cell_id, values: one array for each cell, in the order of gene_id."""
    pairs = F.array_sort(F.collect_list(F.struct("gene_id", value)))
    return residuals.groupBy("cell_id").agg(F.transform(pairs, lambda p: p[value]).alias("values"))
