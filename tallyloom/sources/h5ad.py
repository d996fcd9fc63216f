"""A Spark data source over the CSR group of an ``.h5ad`` file.

Partitions are ranges of cells with about equally many stored entries, cut from
the row pointers, so every task reads its own slice of the file. h5py is imported
only when the source is used; the file must be reachable by all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyloom.sources.matrix import CountMatrix

PART_ENTRIES = 4_000_000


class CellRange(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def balanced_ranges(indptr: np.ndarray, most: int = PART_ENTRIES) -> list[tuple[int, int]]:
    """Row ranges that hold about ``most`` entries each and cover all rows."""
    rows = len(indptr) - 1
    marks = np.searchsorted(indptr, np.arange(most, int(indptr[-1]), most), side="left")
    cuts = sorted({0, *(int(m) for m in marks if 0 < m < rows), rows})
    return list(zip(cuts, cuts[1:], strict=False))


def _group(handle):
    x = handle["X"]
    if not hasattr(x, "keys") or "indptr" not in x:
        raise ValueError("X must be sparse (CSR): it is dense")
    kind = x.attrs.get("encoding-type", x.attrs.get("h5sparse_format", "csr_matrix"))
    if "csr" not in (kind.decode() if isinstance(kind, bytes) else str(kind)):
        raise ValueError(f"X must be sparse (CSR): it is {kind}")
    return x


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[CellRange]:
        import h5py

        with h5py.File(self.path, "r") as f:
            return [CellRange(a, b) for a, b in balanced_ranges(_group(f)["indptr"][:], self.most)]

    def read(self, partition: CellRange) -> Iterator[tuple]:
        import h5py
        import pyarrow as pa

        with h5py.File(self.path, "r") as f:
            x = _group(f)
            indptr = x["indptr"][partition.start : partition.stop + 1]
            a, b = int(indptr[0]), int(indptr[-1])
            cells = np.repeat(np.arange(partition.start, partition.stop, dtype=np.int64), np.diff(indptr))
            for at in range(a, b, 1_000_000):
                stop = min(b, at + 1_000_000)
                yield pa.RecordBatch.from_arrays([pa.array(cells[at - a : stop - a]), pa.array(x["indices"][at:stop].astype(np.int64)), pa.array(x["data"][at:stop].astype(np.float64))], ["cell_id", "gene_id", "x"])


class H5adSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "h5ad_counts"

    def schema(self) -> str:
        return "cell_id long, gene_id long, x double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("part_entries", PART_ENTRIES)))


def _labels(path: str, group: str) -> list[str]:
    import h5py

    with h5py.File(path, "r") as f:
        index = f[group].attrs.get("_index", "_index")
        return [v.decode() if isinstance(v, bytes) else str(v) for v in f[group][index][:]]


def read_h5ad(spark: SparkSession, path: str) -> CountMatrix:
    """counts by the data source; cells and genes with their labels."""
    spark.dataSource.register(H5adSource)
    counts = spark.read.format("h5ad_counts").option("path", path).load()
    dims = []
    for group, kind in (("obs", "cell"), ("var", "gene")):
        labels = _labels(path, group)
        dims.append(spark.createDataFrame(list(enumerate(labels)), f"{kind}_id long, {kind} string") if labels else spark.range(0).select(F.col("id").alias(f"{kind}_id"), F.lit("").alias(kind)))
    return CountMatrix(counts, *dims)
