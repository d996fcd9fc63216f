"""Kept genes, totals and detection counts of cells and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.guarded import whole
from tallyloom.sources.matrix import CountMatrix


def gene_mask(counts: DataFrame) -> DataFrame:
    """gene_id of every gene with a stored entry (a stored zero counts); reads one column."""
    return counts.select("gene_id").distinct()


def masked(matrix: CountMatrix, kept: DataFrame) -> CountMatrix:
    """Only the genes in ``kept`` (gene_id)."""
    return CountMatrix(matrix.counts.join(kept, "gene_id", "left_semi"), matrix.cells, matrix.genes.join(kept, "gene_id", "left_semi"))


def _cell_sums(matrix: CountMatrix) -> DataFrame:
    return matrix.counts.groupBy("cell_id").agg(F.sum(whole(F.col("x"))).alias("s"), F.count("*").alias("n"))


def _gene_sums(matrix: CountMatrix) -> DataFrame:
    return matrix.counts.groupBy("gene_id").agg(F.sum(whole(F.col("x"))).alias("tj"), F.count("*").alias("detected"))


def totals(matrix: CountMatrix) -> DataFrame:
    """One row: total, nc (all cells), ng (kept genes)."""
    sums = _gene_sums(matrix).agg(F.coalesce(F.sum("tj"), F.lit(0.0)).alias("total"), F.count("*").alias("ng"))
    cells = matrix.cells.agg(F.count("*").alias("nc"))
    return sums.crossJoin(F.broadcast(cells)).select("total", "nc", "ng")


def cell_stats(matrix: CountMatrix) -> DataFrame:
    """cell_id, ti, di for every cell: its total and the kept genes that it lacks."""
    if "cells" in matrix.known:
        return matrix.known["cells"]
    genes = _gene_sums(matrix).agg(F.count("*").alias("ng"))
    joined = matrix.cells.select("cell_id").join(_cell_sums(matrix), "cell_id", "left").crossJoin(F.broadcast(genes))
    return joined.select("cell_id", F.coalesce("s", F.lit(0.0)).alias("ti"), (F.col("ng") - F.coalesce("n", F.lit(0))).alias("di"))


def gene_stats(matrix: CountMatrix) -> DataFrame:
    """gene_id, tj, dj for every kept gene: its total and the cells that lack it."""
    cells = matrix.cells.agg(F.count("*").alias("nc"))
    return _gene_sums(matrix).crossJoin(F.broadcast(cells)).select("gene_id", "tj", (F.col("nc") - F.col("detected")).alias("dj"))


def size_factors(cells: DataFrame) -> DataFrame:
    """cells: cell_id, ti -> cell_id, size_factor: ti over the median of positive totals; 1 for empty cells."""
    median = cells.agg(F.median(F.when(F.col("ti") > 0, F.col("ti"))).alias("median"))
    factor = F.when(F.col("ti") > 0, F.col("ti") / F.col("median")).otherwise(1.0)
    return cells.crossJoin(F.broadcast(median)).select("cell_id", factor.alias("size_factor"))


def normalized(matrix: CountMatrix, scale: float = 10_000.0) -> DataFrame:
    """cell_id, gene_id, value for the stored entries: the count's share of its cell's total, times ``scale``; 0 in cells without counts."""
    x = whole(F.col("x"))
    joined = matrix.counts.join(cell_stats(matrix).select("cell_id", "ti"), "cell_id")
    return joined.select("cell_id", "gene_id", F.when(F.col("ti") > 0, x / F.col("ti") * F.lit(scale)).otherwise(0.0).alias("value"))
