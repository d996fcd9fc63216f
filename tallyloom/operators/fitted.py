"""A matrix that carries its cell totals and its fit, each made once.

Every operator after the fit needs both. Without them each operator derives them
again from the entries, and a comparison or a test does so several times over.
"""

from __future__ import annotations

from tallyloom.operators import depth, dispersion
from tallyloom.sources.matrix import CountMatrix
from tallyloom.sources.work import written


def fitted(matrix: CountMatrix, write_counts: bool = False) -> CountMatrix:
    """``matrix`` with written tables of its cells and its fit, which all operators then take.

    write_counts: the entries too; for entries that are a query themselves, not a stored table.
    """
    counts = written(matrix.counts.select("cell_id", "gene_id", "x"), "counts") if write_counts else matrix.counts
    plain = CountMatrix(counts, matrix.cells, matrix.genes)
    cells = written(depth.cell_stats(plain), "cell-stats")
    fit = written(dispersion.fit_dispersion(plain.knowing(cells=cells)), "fit")
    return plain.knowing(cells=cells, fit=fit)
