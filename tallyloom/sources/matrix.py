"""The count matrix: stored entries beside two dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CountMatrix:
    """counts: cell_id, gene_id, x (one row for each stored entry, zeros too);
    cells: cell_id and other columns (all cells, also those without an entry);
    genes: gene_id and other columns.

    A pair (cell_id, gene_id) must occur once; ``summed`` makes it so. known: tables that
    were made of it before (``operators.fitted``).
    """

    counts: DataFrame
    cells: DataFrame
    genes: DataFrame
    known: dict[str, DataFrame] = field(default_factory=dict, compare=False)

    def knowing(self, **tables: DataFrame) -> CountMatrix:
        return CountMatrix(self.counts, self.cells, self.genes, self.known | tables)

    def labelled(self, table: DataFrame) -> DataFrame:
        """``table`` with the labels (columns ``gene``, ``cell``) of its ids in front, where the matrix has them."""
        for kind, own in (("cell", self.cells), ("gene", self.genes)):
            if f"{kind}_id" in table.columns and kind in own.columns:
                table = table.join(own.select(f"{kind}_id", kind), f"{kind}_id", "left")
                table = table.select(kind, *[c for c in table.columns if c != kind])
        return table

    def summed(self) -> CountMatrix:
        return CountMatrix(self.counts.groupBy("cell_id", "gene_id").agg(F.sum("x").alias("x")), self.cells, self.genes)

    def without_zeros(self) -> CountMatrix:
        """Stored zeros left out, so that they no longer count as detected."""
        return CountMatrix(self.counts.filter(F.col("x") != 0), self.cells, self.genes)

    def write(self, path: str) -> None:
        for name in ("counts", "cells", "genes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_matrix(spark: SparkSession, path: str) -> CountMatrix:
    """A matrix written by ``CountMatrix.write``; a missing path raises Spark's PATH_NOT_FOUND."""
    return CountMatrix(*(spark.read.parquet(f"{path}/{name}") for name in ("counts", "cells", "genes")))


def read_coo(spark: SparkSession, counts_path: str, cells_path: str | None = None, genes_path: str | None = None) -> CountMatrix:
    """Coordinate entries in Parquet (cell_id, gene_id, x); missing dimension tables are taken from the entries."""
    counts = spark.read.parquet(counts_path).select("cell_id", "gene_id", F.col("x").cast("double").alias("x"))
    cells = spark.read.parquet(cells_path) if cells_path else counts.select("cell_id").distinct()
    genes = spark.read.parquet(genes_path) if genes_path else counts.select("gene_id").distinct()
    return CountMatrix(counts, cells, genes)
