"""The whole flow over one matrix, from mask to plot tables, in stages that are kept.

Every stage is a table below one folder with a success marker of its own; a run
takes finished stages as they are and makes the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators import depth, diagnostics, dispersion, dropout, residuals
from tallyloom.sources.matrix import CountMatrix
from tallyloom.sources.sinks import stage, write_csv


def run(spark: SparkSession, matrix: CountMatrix, folder: str, method: str = "fdr_bh", q_threshold: float = 0.05, again: bool = False) -> dict[str, DataFrame]:
    """name -> table of each stage; the selections are CSV files too, with the genes' labels."""
    out: dict[str, DataFrame] = {}

    def kept(name: str, make) -> DataFrame:
        out[name] = stage(spark, f"{folder}/{name}", make, again)
        return out[name]

    mask = kept("mask", lambda: depth.gene_mask(matrix.counts))
    own = depth.masked(matrix, mask)
    cells = kept("cell_stats", lambda: depth.cell_stats(own))
    own = own.knowing(cells=cells)
    kept("gene_stats", lambda: own.labelled(depth.gene_stats(own)))
    fit = kept("fit", lambda: dispersion.fit_dispersion(own))
    own = own.knowing(fit=fit)
    high = kept("high_variance", lambda: own.labelled(dispersion.select_high_variance(fit)))
    tests = kept("dropout_test", lambda: own.labelled(dropout.dropout_test(own, method=method)))
    picked = kept("dropout", lambda: tests.filter(tests["q_value"] < q_threshold))
    for name, table in (("high_variance", high), ("dropout", picked)):
        write_csv(table, f"{folder}/{name}.csv", gene="Gene", residual="Residual", p_value="p.value", q_value="q.value")
    points = kept("volcano", lambda: diagnostics.volcano(tests))
    kept("volcano_labels", lambda: own.labelled(diagnostics.volcano_labels(points)))
    kept("dispersion_points", lambda: diagnostics.dispersion_points(fit))
    kept("dispersion_curve", lambda: diagnostics.dispersion_curve(fit))
    models = kept("model_comparison", lambda: dropout.compare_models(own))
    kept("comparison_points", lambda: diagnostics.comparison_points(models))
    kept("model_errors", lambda: dropout.model_errors(models))
    kept("residuals", lambda: residuals.stored_residuals(own))
    kept("residual_moments", lambda: residuals.residual_moments(own))
    return out
