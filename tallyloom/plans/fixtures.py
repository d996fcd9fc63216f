"""Count matrices made from relational tables, for queries and tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.matrix import CountMatrix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_supplier(spark: SparkSession, sf_dir: str, gene, x, genes: DataFrame | None = None) -> CountMatrix:
    counts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), gene.alias("gene_id")).agg(x.cast("double").alias("x"))
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"))
    return CountMatrix(counts, _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id")), parts if genes is None else genes)


def _by_customer(spark: SparkSession, sf_dir: str, x, where=None) -> CountMatrix:
    lines = _table(spark, sf_dir, "lineitem")
    lines = lines if where is None else lines.filter(where)
    joined = lines.join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = joined.groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(x.cast("double").alias("x"))
    cells = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"))
    return CountMatrix(counts, cells, _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene")))


def supplier_parts(spark, sf_dir):
    """Quantities of parts by supplier: small and dense."""
    return _by_supplier(spark, sf_dir, F.col("l_partkey"), F.sum("l_quantity"))


def supplier_part_lines(spark, sf_dir):
    """Numbers of lines: close to Poisson, so many genes are not over-dispersed."""
    return _by_supplier(spark, sf_dir, F.col("l_partkey"), F.count("*"))


def supplier_part_flags(spark, sf_dir):
    """Ten times the quantities by part and return flag: many genes of high mean."""
    gene = F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_returnflag"))
    return _by_supplier(spark, sf_dir, gene, F.sum("l_quantity") * 10, _table(spark, sf_dir, "lineitem").select(gene.alias("gene_id")).distinct())


def customer_parts(spark, sf_dir):
    """Quantities of parts by customer."""
    return _by_customer(spark, sf_dir, F.sum("l_quantity"))


def customer_parts_planted(spark, sf_dir):
    """One for each line, but the quantity for every tenth part: those are over-dispersed."""
    return _by_customer(spark, sf_dir, F.sum(F.when(F.col("l_partkey") % 10 == 0, F.col("l_quantity")).otherwise(1.0)))


def customer_parts_sparse(spark, sf_dir):
    """Large returned lines only: many customers have none."""
    return _by_customer(spark, sf_dir, F.sum("l_quantity"), (F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R"))


def user_events(spark, sf_dir):
    """Sums of event values (fractional) by user and type."""
    events = _table(spark, sf_dir, "events")
    counts = events.groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id")).agg(F.round(F.sum(F.round("value", 2).cast("decimal(18,2)")), 2).cast("double").alias("x"))
    return CountMatrix(counts, events.select(F.col("user_id").alias("cell_id")).distinct(), counts.select("gene_id").distinct())


_SUPPLIER = "SELECT s_suppkey AS cell_id FROM supplier"
_CUSTOMER = "SELECT c_custkey AS cell_id FROM customer"
_JOINED = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
#: The same matrices in SQL: (counts, cells).
SQL: dict[Callable, tuple[str, str]] = {
    supplier_parts: ("SELECT l_suppkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2", _SUPPLIER),
    supplier_part_lines: ("SELECT l_suppkey AS cell_id, l_partkey AS gene_id, CAST(count(*) AS DOUBLE) AS x FROM lineitem GROUP BY 1, 2", _SUPPLIER),
    supplier_part_flags: ("SELECT l_suppkey AS cell_id, l_partkey || '-' || l_returnflag AS gene_id, sum(l_quantity) * 10 AS x FROM lineitem GROUP BY 1, 2", _SUPPLIER),
    customer_parts: (f"SELECT o_custkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS x {_JOINED} GROUP BY 1, 2", _CUSTOMER),
    customer_parts_planted: (f"SELECT o_custkey AS cell_id, l_partkey AS gene_id, CAST(sum(CASE WHEN l_partkey % 10 = 0 THEN l_quantity ELSE 1 END) AS DOUBLE) AS x {_JOINED} GROUP BY 1, 2", _CUSTOMER),
    customer_parts_sparse: (f"SELECT o_custkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS x {_JOINED} WHERE l_quantity >= 45 AND l_returnflag = 'R' GROUP BY 1, 2", _CUSTOMER),
    user_events: ("SELECT user_id AS cell_id, event_type AS gene_id, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS x FROM events GROUP BY 1, 2", "SELECT DISTINCT user_id AS cell_id FROM events"),
}
