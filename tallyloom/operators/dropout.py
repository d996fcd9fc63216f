"""Expected dropout under the model, the test against what was observed, and its comparison.

The chance that a cell lacks a gene depends on the cell only through its total,
and on the gene through its total and size, so cells and genes are first counted by these; what
meets is different totals, not cells and genes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.guarded import INF, NAN, dropout
from tallyloom.functions.normal import normal_tail
from tallyloom.operators.corrections import adjusted
from tallyloom.operators.dispersion import fit_basic, fit_dispersion, fit_trend, smoothed
from tallyloom.operators.depth import cell_stats
from tallyloom.sources.matrix import CountMatrix

#: A gene table of up to so many rows goes to all tasks; a larger one meets the totals by a shuffle.
SMALL_GENES = 500_000


def depths(cells: DataFrame) -> DataFrame:
    """ti, cells: how many cells have each total."""
    return cells.groupBy("ti").agg(F.count("*").alias("cells"))


def _total(cells: DataFrame) -> DataFrame:
    return cells.agg(F.sum("ti").alias("total"), F.count("*").alias("nc"))


def few_genes(matrix: CountMatrix, most: int = SMALL_GENES) -> bool:
    """Whether the gene table, which bounds all tables of kept genes, is small enough to go to all tasks."""
    return matrix.genes.count() <= most


def _kinds(genes: DataFrame) -> DataFrame:
    """tj, exp_size, genes: how many genes have each total and size. A smoothed size follows from the total, and
    different totals of cells times those of genes are at most twice the sum of all counts."""
    return genes.groupBy("tj", "exp_size").agg(F.count("*").alias("genes"))


def _pairs(cells: DataFrame, genes: DataFrame, few: bool) -> DataFrame:
    """Each different total of cells against each kind of genes, with p, which is missing without a size."""
    spread, kinds = depths(cells).crossJoin(F.broadcast(_total(cells))), _kinds(genes)
    if few or kinds.count() <= SMALL_GENES:
        # a small table of totals must still use all cores
        spread = spread.repartition(spread.sparkSession.sparkContext.defaultParallelism)
        kinds = F.broadcast(kinds)
    p = dropout(F.col("tj"), F.col("ti"), F.col("total"), F.col("exp_size"))
    return spread.crossJoin(kinds).withColumn("p", F.when(F.col("exp_size").isNotNull(), p))


def expected_by_gene(cells: DataFrame, genes: DataFrame, few: bool) -> DataFrame:
    """gene_id, p_sum, pq_sum: sums over all cells of p and of p (1 - p), made once for each kind. cells: cell_id, ti."""
    p, k = F.col("p"), F.col("cells")
    by_kind = _pairs(cells, genes, few).groupBy(F.col("tj").alias("_tj"), F.col("exp_size").alias("_size")).agg(F.sum(k * p).alias("p_sum"), F.sum(k * (p - p * p)).alias("pq_sum"))
    same = (F.col("tj") == F.col("_tj")) & F.col("exp_size").eqNullSafe(F.col("_size"))
    return genes.select("gene_id", "tj", "exp_size").join(by_kind, same).select("gene_id", "p_sum", "pq_sum")


def expected_by_cell(cells: DataFrame, genes: DataFrame, few: bool) -> DataFrame:
    """cell_id, p_sum: the sum over all genes, made once for each different total."""
    by_depth = _pairs(cells, genes, few).groupBy("ti").agg(F.sum(F.col("genes") * F.col("p")).alias("p_sum"))
    return cells.select("cell_id", "ti").join(by_depth, "ti").select("cell_id", "p_sum")


def expected_dropout(matrix: CountMatrix, fit: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(gene_id, p_sum, pq_sum; cell_id, p_sum) under the smoothed sizes.

    Here and below, strict: without a trend reading fails; else what is expected is missing.
    """
    fit = fit_dispersion(matrix) if fit is None else fit
    genes, cells = smoothed(fit, fit_trend(fit), 0.0, strict), cell_stats(matrix)
    few = few_genes(matrix)
    return expected_by_gene(cells, genes, few), expected_by_cell(cells, genes, few)


def dropout_z(matrix: CountMatrix, fit: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """gene_id, observed, expected, effect_size, z: observed against expected dropout of each gene."""
    fit = fit_dispersion(matrix) if fit is None else fit
    cells = cell_stats(matrix)
    genes = smoothed(fit, fit_trend(fit), None, strict)
    sums = expected_by_gene(cells, genes, few_genes(matrix)).crossJoin(F.broadcast(_total(cells).select("nc")))
    t = fit.select("gene_id", "dj").join(sums, "gene_id")
    nc = F.col("nc").cast("double")
    t = t.select("gene_id", (F.col("dj") / nc).alias("observed"), (F.col("p_sum") / nc).alias("expected"), (F.col("pq_sum") / (nc * nc)).alias("var_expected"), nc.alias("nc"))
    diff = F.col("observed") - F.col("expected")
    t = t.withColumn("effect_size", diff).withColumn("err", F.sqrt(F.col("var_expected") + F.col("observed") * (F.lit(1.0) - F.col("observed")) / F.col("nc")))
    return t.select("gene_id", "observed", "expected", "effect_size", z_score(F.col("effect_size"), F.col("err")).alias("z"))


def z_score(diff: Column, err: Column) -> Column:
    """diff / err; without an error plus or minus infinity, or NaN if there is no difference either."""
    return F.when(err > 0, diff / err).when(diff > 0, INF).when(diff < 0, -INF).otherwise(NAN)


def dropout_test(matrix: CountMatrix, fit: DataFrame | None = None, method: str = "fdr_bh", strict: bool = True) -> DataFrame:
    """gene_id, effect_size, z, p_value, q_value of every gene; a NaN p counts as 1 in the correction."""
    tested = dropout_z(matrix, fit, strict).withColumn("p_value", normal_tail("z"))
    return adjusted(tested, method).select("gene_id", "effect_size", "z", "p_value", "q_value")


def select_dropout(matrix: CountMatrix, fit: DataFrame | None = None, method: str = "fdr_bh", threshold: float = 0.05, strict: bool = True) -> DataFrame:
    """gene_id, effect_size, p_value, q_value with q_value < threshold, smallest p first."""
    t = dropout_test(matrix, fit, method, strict).filter(F.col("q_value") < threshold)
    return t.select("gene_id", "effect_size", "p_value", "q_value").orderBy(F.col("p_value").asc_nulls_last(), "gene_id")


def compare_models(matrix: CountMatrix, fit: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """gene_id, mean_expr, observed, adj_fit, bas_fit: dropout as observed and under both models.

    Without depth every cell has the same total, so that model needs one term for each gene.
    """
    fit = fit_dispersion(matrix) if fit is None else fit
    cells = cell_stats(matrix)
    whole = _total(cells)
    adjusted_sums = expected_by_gene(cells, smoothed(fit, fit_trend(fit), 0.0, strict), few_genes(matrix)).select("gene_id", "p_sum")
    basic = fit_basic(matrix)
    flat = smoothed(basic, fit_trend(basic), 0.0, strict).crossJoin(F.broadcast(whole))
    p = dropout(F.col("tj"), F.col("total") / F.col("nc"), F.col("total"), F.col("exp_size"))
    flat = flat.select("gene_id", F.when(F.col("exp_size").isNotNull(), p).alias("bas_fit"))
    t = fit.select("gene_id", "dj", "mean").join(adjusted_sums, "gene_id").join(flat, "gene_id").crossJoin(F.broadcast(whole.select("nc")))
    return t.select("gene_id", F.col("mean").alias("mean_expr"), (F.col("dj") / F.col("nc")).alias("observed"), (F.col("p_sum") / F.col("nc")).alias("adj_fit"), "bas_fit")


def model_errors(comparison: DataFrame) -> DataFrame:
    """One row: the sums of absolute errors of both models."""
    return comparison.agg(F.sum(F.abs(F.col("adj_fit") - F.col("observed"))).alias("depth_adjusted"), F.sum(F.abs(F.col("bas_fit") - F.col("observed"))).alias("basic"))
