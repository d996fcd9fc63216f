"""Exact dedup over a cuckoo-filter index of live digests.

The index is cut into shards by digest. A shard holds a cuckoo filter over its
live digests and the stored keys themselves, in buckets. A digest that the
filter does not know is new for certain and is inserted without a look at the
keys; a hit is looked up in its one bucket, which tells a copy from a false
positive. Deleting a digest takes its fingerprint out of the filter again. When
an insertion finds no place, the filter is built anew, twice as large, from the
stored keys.

Documents reach the shards as digests, already combined for each map task, so a
group of copies of any size sends one row from each task. Shards hold about
``SHARD_KEYS`` digests whatever the size of the corpus, and a task holds one
shard at a time.

Texts are equal when they agree after lower-casing A-Z only; null counts as
empty. Of equal texts the row with the largest doc_id stays (a null doc_id is
below all others; rows that share the largest doc_id all stay, as nothing tells
them apart). Very long texts are hashed whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.base import saved, sliced, tidy

SHARD_KEYS = 50_000
FLUSH_KEYS = 50_000
STORED, UPSERT, RETIRE = 0, 1, 2


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, partial-key cuckoo hashing."""

    SLOTS, KICKS = 4, 200

    def __init__(self, keys: int = 64):
        self.buckets = 1 << max(2, (keys * 5 // 4 // self.SLOTS).bit_length())
        self.table: list[list[int]] = [[] for _ in range(self.buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & (self.buckets - 1)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & (self.buckets - 1)

    def __contains__(self, digest: bytes) -> bool:
        print_, a, b = self._places(digest)
        return print_ in self.table[a] or print_ in self.table[b]

    def insert(self, digest: bytes) -> bool:
        """False if the filter overflows; it must then be built anew from the keys."""
        print_, a, b = self._places(digest)
        for bucket in (a, b):
            if len(self.table[bucket]) < self.SLOTS:
                self.table[bucket].append(print_)
                return True
        bucket = a
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            print_, self.table[bucket][slot] = self.table[bucket][slot], print_
            bucket = self._other(bucket, print_)
            if len(self.table[bucket]) < self.SLOTS:
                self.table[bucket].append(print_)
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only digests that were inserted may be deleted."""
        print_, a, b = self._places(digest)
        for bucket in (a, b):
            if print_ in self.table[bucket]:
                self.table[bucket].remove(print_)
                return True
        return False


class LiveIndex:
    """One shard: the filter, and digest -> [largest doc_id, rows] in buckets."""

    def __init__(self, keys: int = 64):
        self.filter = CuckooFilter(keys)
        self.content: dict[bytes, dict[bytes, list]] = {}
        self.resizes = self.false_hits = 0

    def upsert(self, digest: bytes, doc_id: int | None, rows: int) -> None:
        bucket = self.content.get(digest[10:12])
        if digest in self.filter:
            entry = bucket.get(digest) if bucket else None
            if entry:
                if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                    entry[0] = doc_id
                entry[1] += rows
                return
            self.false_hits += 1
        if bucket is None:
            bucket = self.content[digest[10:12]] = {}
        bucket[digest] = [doc_id, rows]
        if not self.filter.insert(digest):
            self._resize()

    def retire(self, digest: bytes) -> bool:
        bucket = self.content.get(digest[10:12], {})
        if digest not in self.filter or digest not in bucket:
            return False
        del bucket[digest]
        self.filter.delete(digest)
        return True

    def _resize(self) -> None:
        size = self.filter.buckets * CuckooFilter.SLOTS
        while True:
            self.resizes += 1
            size *= 2
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(k) for b in self.content.values() for k in b):
                return

    def entries(self) -> Iterator[tuple[bytes, int | None, int]]:
        for bucket in self.content.values():
            for digest, (doc_id, rows) in bucket.items():
                yield digest, doc_id, rows


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    for batch in sliced(batches):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        digests = [sha((t or b"").lower()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest: SHA-256 of the whole normalised text (bytes.lower() touches A-Z only)."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidy(_digest_batches), "doc_id long, digest binary")


def _combine(shards: int):
    names = ["shard", "kind", "digest", "doc_id", "rows"]

    def batch_of(groups: dict) -> pa.RecordBatch:
        keys = list(groups)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int.from_bytes(k[12:20], "little") % shards for k in keys], pa.int64()),
                pa.array([UPSERT] * len(keys), pa.int32()),
                pa.array(keys, pa.binary()),
                pa.array([groups[k][0] for k in keys], pa.int64()),
                pa.array([groups[k][1] for k in keys], pa.int64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, list] = {}
        for batch in batches:
            for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                entry = groups.get(digest)
                if entry is None:
                    groups[digest] = [doc_id, 1]
                else:
                    if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                        entry[0] = doc_id
                    entry[1] += 1
            if len(groups) >= FLUSH_KEYS:
                yield batch_of(groups)
                groups = {}
        if groups:
            yield batch_of(groups)

    return run


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and kind: stored keys, then insertions, then deletions."""
    names = ["shard", "digest", "keep_id", "group_size"]

    def batches_of(shard: int, index: LiveIndex) -> Iterator[pa.RecordBatch]:
        rows = list(index.entries())
        for i in range(0, len(rows), 10_000):
            part = rows[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int64()), pa.array([r[0] for r in part], pa.binary()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], names)

    current, index = None, None
    for batch in batches:
        for shard, kind, digest, doc_id, rows in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if shard != current:
                if index is not None:
                    yield from batches_of(current, index)
                current, index = shard, LiveIndex()
            if kind == RETIRE:
                index.retire(digest)
            else:
                index.upsert(digest, doc_id, rows)
    if index is not None:
        yield from batches_of(current, index)


def shard_count(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def update_index(new: DataFrame, shards: int, stored: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """The index after inserting ``new`` (doc_id, digest) and deleting ``gone`` (digest).

    stored: the index before, whatever its number of shards: every digest is dealt anew.
    Returns shard, digest, keep_id, group_size: the live digests.
    """
    changes = new.mapInArrow(tidy(_combine(shards)), "shard long, kind int, digest binary, doc_id long, rows long")
    if stored is not None:
        dealt = stored.select("digest", "keep_id", "group_size").mapInArrow(tidy(_dealt(shards)), "shard long, digest binary, keep_id long, group_size long")
        changes = changes.unionByName(dealt.select("shard", F.lit(STORED).alias("kind"), "digest", F.col("keep_id").alias("doc_id"), F.col("group_size").alias("rows")))
    if gone is not None:
        shard = gone.select("digest").mapInArrow(tidy(_dealt(shards)), "shard long, digest binary")
        changes = changes.unionByName(shard.select("shard", F.lit(RETIRE).alias("kind"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("rows")))
    return changes.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(tidy(_replay), "shard long, digest binary, keep_id long, group_size long")


def _dealt(shards: int):
    """The shard of each row's digest, before its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("digest").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(k[12:20], "little") % shards for k in keys], pa.int64()), *batch.columns], ["shard", *batch.schema.names])

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, keep_id, group_size for every row of ``docs``.

    Texts are read once; after that only digests move. A digest with very many
    rows meets its one index row in a join whose large side Spark splits.
    """
    named = saved(digests(docs, id_col, text_col), "exact-digests")
    index = update_index(named, shard_count(named.count())).select("digest", "keep_id", "group_size")
    return named.join(index, "digest").select("doc_id", "digest", "keep_id", "group_size")
