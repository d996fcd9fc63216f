"""The tables behind the diagnostic plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.guarded import log_or
from tallyloom.operators.dispersion import TREND_SIZE, fit_trend, require_trend

Q, EFFECT, NAMED = 0.05, 0.25, 10
CURVE_POINTS, THIN_GENES = 100, 20_000


def volcano(tests: DataFrame, q_threshold: float = Q, effect_threshold: float = EFFECT) -> DataFrame:
    """gene_id, effect_size, p_value, q_value, neg_log10_q, colour.

    Zeros among q become the smallest positive q (missing if there is none).
    """
    # over the gene table, so that the tests are made once
    least = F.min(F.when(F.col("q_value") > 0, F.col("q_value"))).over(Window.partitionBy())
    t = tests.withColumn("q_value", F.when(F.col("q_value") == 0, least).otherwise(F.col("q_value")))
    q, effect = F.col("q_value"), F.col("effect_size")
    colour = F.when((q < q_threshold) & (effect > effect_threshold), "red").when((q < q_threshold) & (effect < -effect_threshold), "blue").otherwise("grey")
    return t.select("gene_id", "effect_size", "p_value", "q_value", (-F.log10(q)).alias("neg_log10_q"), colour.alias("colour"))


def volcano_labels(points: DataFrame, top_n: int = NAMED) -> DataFrame:
    """The top_n genes by q, and of equal q (corrections make many) by p."""
    return points.orderBy(F.col("q_value").asc_nulls_last(), F.col("p_value").asc_nulls_last(), "gene_id").limit(top_n)


def dispersion_points(fit: DataFrame) -> DataFrame:
    """gene_id, mean, size of the genes that have a size of their own."""
    return fit.filter((F.col("size") < TREND_SIZE) & (F.col("size") > 0)).select("gene_id", "mean", "size")


def dispersion_curve(fit: DataFrame, trend: DataFrame | None = None, points: int = CURVE_POINTS, strict: bool = True) -> DataFrame:
    """point, mean, size along the trend, evenly spaced in ln(mean) over the positive means."""
    mean = F.col("mean")
    ends = fit.agg(F.min(F.when(mean > 0, log_or(mean))).alias("low"), F.max(log_or(mean)).alias("high"))
    trend = fit_trend(fit) if trend is None else trend
    line = ends.crossJoin(F.broadcast(require_trend(trend) if strict else trend))
    grid = fit.sparkSession.range(points).select(F.col("id").alias("point"))
    at = F.col("low") + F.col("point") * (F.col("high") - F.col("low")) / F.lit(float(points - 1))
    return grid.crossJoin(F.broadcast(line)).select("point", F.exp(at).alias("mean"), F.exp(F.col("intercept") + F.col("slope") * at).alias("size"))


def comparison_points(comparison: DataFrame, most: int = THIN_GENES) -> DataFrame:
    """The rows to plot by mean: all, or every second one of more than ``most``."""
    order = Window.partitionBy().orderBy("mean_expr", "gene_id")
    t = comparison.withColumn("_at", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return t.filter((F.col("_n") <= most) | (F.col("_at") % 2 == 1)).drop("_at", "_n")
