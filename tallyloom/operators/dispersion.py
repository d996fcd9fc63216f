"""Dispersion of genes around the depth-adjusted mean, its trend, and the model without depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.guarded import INF, log_or, whole
from tallyloom.operators.depth import cell_stats, gene_stats, size_factors
from tallyloom.sources.matrix import CountMatrix

#: What a gene without over-dispersion gets, and the rules of the trend.
UNDISPERSED, BASIC_UNDISPERSED, STABLE = 10000.0, 1000.0, 1e-6
TREND_SIZE, TREND_MEAN, HIGH_LOG2_MEAN, HIGH_GENES = 9999.0, 1e-3, 4.0, 2000


def fit_dispersion(matrix: CountMatrix) -> DataFrame:
    """gene_id, tj, dj, mean, var_obs, size for every kept gene.

    The gene's total is a factor of all its expected counts, so the entries meet only the cells' totals;
    one aggregation gives the sums of x^2 and x * ti.
    """
    if "fit" in matrix.known:
        return matrix.known["fit"]
    cells = cell_stats(matrix)
    x = whole(F.col("x"))
    sums = matrix.counts.join(cells.select("cell_id", "ti"), "cell_id").groupBy("gene_id").agg(F.sum(x).alias("tj"), F.count("*").alias("detected"), F.sum(x * x).alias("xx"), F.sum(x * F.col("ti")).alias("xt"))
    whole_table = cells.agg(F.sum("ti").alias("total"), F.sum(F.col("ti") * F.col("ti")).alias("s2"), F.count("*").alias("nc"))
    t = sums.crossJoin(F.broadcast(whole_table))
    tj, total = F.col("tj"), F.col("total")
    square = F.when(total > 0, tj / total * (tj / total) * F.col("s2")).otherwise(0.0)
    cross = F.when(total > 0, F.lit(2.0) * (tj / total) * F.col("xt")).otherwise(0.0)
    t = t.withColumn("square", square).withColumn("dev", F.col("xx") - cross + F.col("square"))
    over = F.col("dev") - tj
    size = F.when(over > STABLE, F.col("square") / over).otherwise(UNDISPERSED)
    t = t.withColumn("size", size)
    nc = F.col("nc")
    return t.select("gene_id", "tj", (nc - F.col("detected")).alias("dj"), (tj / nc).alias("mean"), F.when(nc > 1, F.col("dev") / (nc - 1)).otherwise(F.lit(float("nan"))).alias("var_obs"), F.when(F.col("size") <= 0, UNDISPERSED).otherwise(F.col("size")).alias("size"))


def fit_trend(fit: DataFrame) -> DataFrame:
    """One row: intercept, slope, n: least squares of ln(size) on ln(mean) over eligible genes.

    With more than 2000 eligible genes of high mean only those count. Both fits come from one
    aggregation. Without two different means there is no line; ``require_trend`` tells.
    """
    size, mean = F.col("size"), F.col("mean")
    good = fit.filter((size > 0) & (size < TREND_SIZE) & (mean > TREND_MEAN)).select(F.ln(size).alias("y"), F.ln(mean).alias("x"), (F.log2(mean) > HIGH_LOG2_MEAN).alias("high"))
    y, x = F.when(F.col("high"), F.col("y")), F.when(F.col("high"), F.col("x"))
    both = good.agg(F.regr_intercept("y", "x").alias("a"), F.regr_slope("y", "x").alias("b"), F.count("*").alias("n"), F.regr_intercept(y, x).alias("ha"), F.regr_slope(y, x).alias("hb"), F.count_if(F.col("high")).alias("hn"))
    use = F.col("hn") > HIGH_GENES
    return both.select(F.when(use, F.col("ha")).otherwise(F.col("a")).alias("intercept"), F.when(use, F.col("hb")).otherwise(F.col("b")).alias("slope"), F.when(use, F.col("hn")).otherwise(F.col("n")).alias("n"))


def require_trend(trend: DataFrame) -> DataFrame:
    """``trend``; reading it fails with a clear message if there was nothing to fit."""
    wrong = F.raise_error(F.lit("no trend: the eligible genes have no two different means")).cast("double")
    return trend.select(F.when(F.col("intercept").isNull(), wrong).otherwise(F.col("intercept")).alias("intercept"), F.when(F.col("slope").isNull(), wrong).otherwise(F.col("slope")).alias("slope"), "n")


def smoothed(fit: DataFrame, trend: DataFrame, zero_mean: float | None, strict: bool = True) -> DataFrame:
    """``fit`` with exp_size, the size that the trend gives a gene's mean.

    zero_mean: what stands for ln(mean) of a gene without counts; None keeps minus infinity.
    strict: without a trend reading fails; else exp_size is missing.
    """
    a, b = F.col("intercept"), F.col("slope")
    at_zero = F.when(b > 0, 0.0).when(b < 0, INF).otherwise(F.exp(a)) if zero_mean is None else F.exp(a + b * zero_mean)
    exp_size = F.when(F.col("mean") > 0, F.exp(a + b * log_or(F.col("mean")))).otherwise(at_zero)
    return fit.crossJoin(F.broadcast(require_trend(trend) if strict else trend)).withColumn("exp_size", exp_size).drop("intercept", "slope", "n")


def select_high_variance(fit: DataFrame, trend: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """gene_id, residual, most variable first: ln(size) against the trend, ascending."""
    s = smoothed(fit, fit_trend(fit) if trend is None else trend, 0.0, strict)
    return s.select("gene_id", (log_or(F.col("size")) - log_or(F.col("exp_size"))).alias("residual")).orderBy("residual", "gene_id")


def fit_basic(matrix: CountMatrix) -> DataFrame:
    """gene_id, tj, dj, mean, var_obs, size of the model without depth.

    Raw values (not their ceilings) over the cell's size factor, rounded half to even.
    """
    factors = size_factors(cell_stats(matrix))
    y = F.rint(F.col("x") / F.col("size_factor"))
    sums = matrix.counts.join(factors, "cell_id").groupBy("gene_id").agg(F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    nc = matrix.cells.agg(F.count("*").alias("nc"))
    m = F.col("s") / F.col("nc")
    t = sums.crossJoin(F.broadcast(nc)).select("gene_id", m.alias("m"), (F.col("ss") / F.col("nc") - m * m).alias("var_obs"))
    over = F.col("var_obs") - F.col("m")
    t = t.withColumn("raw", F.when(over > STABLE, F.col("m") * F.col("m") / over).otherwise(BASIC_UNDISPERSED))
    largest = t.agg((F.max(F.when(~F.isnan("raw") & (F.col("raw") < 1e6), F.col("raw"))) * 10).alias("largest"))
    default = F.when(F.col("largest").isNull() | (F.col("largest") == 0), BASIC_UNDISPERSED).otherwise(F.col("largest"))
    size = F.greatest(F.when(F.isnan("raw") | (F.col("raw") <= 0), default).otherwise(F.col("raw")), F.lit(1e-10))
    sized = t.crossJoin(F.broadcast(largest)).select("gene_id", "var_obs", size.alias("size"))
    genes = gene_stats(matrix).crossJoin(F.broadcast(nc))
    return genes.join(sized, "gene_id").select("gene_id", "tj", "dj", (F.col("tj") / F.col("nc")).alias("mean"), "var_obs", "size")


