"""What the corpus operators share: tables in the shared folder, row packing and key helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.work import shared_folder, shared_path  # noqa: F401  the operators take them from here
from tallyloom.sources.work import written as saved  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(left: Column, right: Column) -> Column:
    """Null-safe equality, which Spark still plans as an equi-join."""
    return left.eqNullSafe(right)


def given_back() -> None:
    """Memory that a task has freed goes back to the system: workers live on, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a worker keeps between tasks of one kind.
KEPT: dict = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task runs over its batches, with its memory given back at the end; only tasks that say so leave ``KEPT`` as it is."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            KEPT.clear()
        yield from run(batches)
        given_back()

    return whole


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that a worker never has Python objects for all texts of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and one struct ``_rest`` of all others, whatever their names.

    The others are r0, r1, ... in it, so that no name has to pass through a schema's text.
    """
    rest = [F.col(quoted(c)).alias(f"r{i}") for i, c in enumerate(c for c in docs.columns if c not in own)]
    return docs.select(*[F.col(quoted(c)) for c in own], F.struct(*(rest or [F.lit(None).cast("int").alias("none")])).alias("_rest"))


def rest_of(like: DataFrame, *own: str) -> list[Column]:
    """The columns of ``like`` but ``own``, taken from ``_rest``."""
    return [F.col(f"_rest.r{i}").alias(c) for i, c in enumerate(c for c in like.columns if c not in own)]


def unpacked(df: DataFrame, like: DataFrame, *own: str, **changed: Column) -> DataFrame:
    """The columns of ``like`` in their order, from a frame that was packed with the same ``own``.

    Only ``own`` and ``changed`` come from the frame's other columns; whatever those
    are called, all others keep their values.
    """
    rest = {c: F.col(f"_rest.r{i}") for i, c in enumerate(c for c in like.columns if c not in own)}
    return df.select(*[changed[c].alias(c) if c in changed else (F.col(quoted(c)) if c in own else rest[c].alias(c)) for c in like.columns])
