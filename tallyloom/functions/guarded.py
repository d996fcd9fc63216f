"""Column helpers that state what a division or logarithm gives outside its domain.

ANSI mode stays on, so every such case is an explicit branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def whole(x: Column) -> Column:
    """The ceiling, as a double (Spark's ceil gives a bigint)."""
    return F.ceil(x).cast("double")


def ratio(a: Column, b: Column, otherwise=None) -> Column:
    """a / b; ``otherwise`` (null by default) where b is 0."""
    return F.when(b != 0.0, a / b).otherwise(F.lit(otherwise))


def log_or(x: Column, otherwise: float | None = None) -> Column:
    return F.when(x > 0.0, F.ln(x)).otherwise(F.lit(otherwise))


def probability(p: Column) -> Column:
    """Missing and NaN count as 0, +inf as 1, -inf as 0."""
    return F.when(p.isNull() | F.isnan(p), 0.0).when(p == INF, 1.0).when(p == -INF, 0.0).otherwise(p)


def dropout(tj: Column, ti: Column, total: Column, size: Column) -> Column:
    """The chance of no count for a gene of total tj in a cell of total ti.

    (mu / size + 1) ** -size with mu = tj * ti / total. An infinite size gives 1; a size that is
    missing, NaN or 0 gives 0 (or 1 if nothing is expected and the size is not missing).
    """
    mu = F.when(total > 0.0, tj * ti / total).otherwise(0.0)
    p = F.when(size.isNull() | F.isnan(size), 0.0).when(size == INF, 1.0).when(size == 0.0, 0.0)
    return p.otherwise(probability(F.pow(F.greatest(F.when((size != 0.0), mu / size).otherwise(0.0) + 1.0, F.lit(1e-12)), -size)))
