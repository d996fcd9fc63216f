"""Totals and detection counts over a stream of entries.

They are sums, so a stream can keep them; dispersions cannot be kept that way
(the total of a cell changes what its earlier entries meant).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.guarded import whole


def streaming_gene_stats(entries: DataFrame) -> DataFrame:
    """gene_id, tj, detected, xx; entries: a stream of cell_id, gene_id, x. Write in update or complete mode."""
    x = whole(F.col("x"))
    return entries.groupBy("gene_id").agg(F.sum(x).alias("tj"), F.count("*").alias("detected"), F.sum(x * x).alias("xx"))


def streaming_cell_stats(entries: DataFrame) -> DataFrame:
    """cell_id, ti, detected."""
    return entries.groupBy("cell_id").agg(F.sum(whole(F.col("x"))).alias("ti"), F.count("*").alias("detected"))
