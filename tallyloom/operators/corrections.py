"""Corrections for multiple tests over a table of genes.

The tests are ranked by windows without a partition: the table has one row for
each gene, never one for each cell. A NaN or missing p counts as 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05
METHODS = ("fdr_bh", "fdr_by", "bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "hommel", "fdr_tsbh", "fdr_tsbky")


def _simes_bounds(p: np.ndarray) -> np.ndarray:
    """c_m = min over k of m p_(n-m+k) / k for m = 1 .. n, p ascending.

    The place of a minimum never goes back as m falls, so the places of two m bound those of all m between:
    halving takes n log n steps, a whole level at a time.
    """
    n = len(p)
    start = np.arange(n)  # the m largest begin at n - m
    place = np.full(n + 2, n - 1)
    place[0] = 0
    bound = np.empty(n)
    step = 1 << max(n.bit_length() - 1, 0)
    while step:
        at = start[step - 1 :: 2 * step]
        low = np.maximum(place[at + 1 - step], at)
        high = np.maximum(place[np.minimum(at + 1 + step, n + 1)], low)
        for some in np.array_split(np.arange(len(at)), 1 + (n + len(at)) // 4_000_000):
            if not len(some):
                continue
            sizes = high[some] - low[some] + 1
            ends = np.cumsum(sizes)
            j = np.arange(ends[-1]) + np.repeat(low[some] - (ends - sizes), sizes)
            begin = np.repeat(at[some], sizes)
            values = (n - begin) * p[j] / (j - begin + 1)
            least = np.minimum.reduceat(values, ends - sizes)
            first = np.flatnonzero(values == np.repeat(least, sizes))
            bound[at[some]] = least
            place[at[some] + 1] = j[first[np.searchsorted(first, ends - sizes)]]
        step //= 2
    return bound[::-1]


def hommel(p: np.ndarray) -> np.ndarray:
    """Adjusted values for ascending p.

    For each size m the m largest p have a Simes bound c_m = min over k of m p_(n-m+k) / k, and p_i is at least
    the lesser of c_m and m p_i (which is c_m if it is one of the m largest). As m p_i grows with m, the largest
    of these lies where m p_i crosses the largest bound of m and more.
    """
    n = len(p)
    if n == 0:
        return p.copy()
    m = np.arange(1, n + 1)
    bound = np.maximum.accumulate(_simes_bounds(p)[::-1])[::-1]
    crossing = np.searchsorted(-(bound / m), -p, side="right")
    out = p.copy()
    for near in (-2, -1, 0, 1):
        at = np.clip(crossing + near, 0, n - 1)
        np.maximum(out, np.minimum(bound[at], (at + 1) * p), out=out)
    return np.minimum(out, 1.0)


def _hommel_table(t: pd.DataFrame) -> pd.DataFrame:
    p = t["_p"].to_numpy(float)
    order = np.argsort(p, kind="stable")
    q = np.empty(len(p))
    q[order] = hommel(p[order])
    return pd.DataFrame({"_id": t["_id"], "q_value": q})


def adjusted(df: DataFrame, method: str = "fdr_bh", p_col: str = "p_value", id_col: str = "gene_id", alpha: float = ALPHA) -> DataFrame:
    """``df`` with q_value. id_col breaks ties and must be unique; alpha serves the two-stage methods."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    raw = F.col(p_col)
    t = df.withColumn("_p", F.when(raw.isNull() | F.isnan(raw), 1.0).otherwise(raw))
    p, one = F.col("_p"), F.lit(1.0)
    if method == "hommel":
        q = t.select(F.col(id_col).alias("_id"), "_p", F.lit(True).alias("_all")).groupBy("_all").applyInPandas(_hommel_table, f"_id {df.schema[id_col].dataType.simpleString()}, q_value double")
        return df.join(q, df[id_col] == q["_id"]).drop("_id")
    everything = Window.partitionBy()
    up = Window.partitionBy().orderBy("_p", id_col)
    t = t.withColumn("_n", F.count("*").over(everything).cast("double")).withColumn("_rank", F.row_number().over(up).cast("double"))
    n, rank = F.col("_n"), F.col("_rank")
    # from the largest p down: a frame that only grows takes one pass, one that shrinks would start anew for each row
    from_top = Window.partitionBy().orderBy(F.desc("_p"), F.desc(id_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = n - rank + 1
    step = F.least(one, F.min(p * n / rank).over(from_top))
    if method == "fdr_bh":
        q = step
    elif method == "fdr_by":
        harmonic = F.sum(one / rank).over(everything)
        q = F.least(one, F.min(p * n / rank).over(from_top) * harmonic)
    elif method == "bonferroni":
        q = F.least(one, p * n)
    elif method == "sidak":
        q = F.when(p < 1.0, -F.expm1(n * F.log1p(-p))).otherwise(one)
    elif method == "holm":
        q = F.least(one, F.max(p * left).over(so_far))
    elif method == "holm-sidak":
        q = F.least(one, F.max(F.when(p < 1.0, -F.expm1(left * F.log1p(-p))).otherwise(one)).over(so_far))
    elif method == "simes-hochberg":
        q = F.least(one, F.min(p * left).over(from_top))
    else:
        factor = 1.0 + alpha if method == "fdr_tsbky" else 1.0
        t = t.withColumn("_bh", step)
        rejected = F.count_if(F.col("_bh") <= alpha / factor).over(everything)
        nulls = F.when((rejected > 0) & (rejected < n), n - rejected).otherwise(n)
        q = F.least(one, F.col("_bh") * nulls / n * factor)
    return t.withColumn("q_value", q).select(*df.columns, "q_value")
