"""Line dedup by a sharded minimal perfect hash over line hashes.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at both
ends, with A-Z lower-cased, kept as a 128-bit hash: the first half places it, the
second half is its fingerprint. Keys are counted over all documents (combined
for each batch and each map task first), and every distinct key is indexed: each
shard is one minimal perfect hash with arrays of fingerprints, document counts and
keepers (the largest doc_id that holds the key). The count in the array decides
whether a line is repeated.

Documents then probe the arrays: they send (hash, doc_id) to the shard, where
whole batches are answered at once, and get back the keys that they must drop.
A task holds one shard of about ``SHARD_KEYS`` keys and one batch, however many
documents share a line; shards that hold a very common line are copied and their
probes spread over the copies. Probes move, as an index of all lines fits no task;
a probe is a hash and the names of its row, never a line.

Defined results: null or empty texts have one empty line; a line that occurs
several times in a document counts once; a null doc_id is below all others; rows
with one doc_id count each but keep or drop alike; very long texts are read whole;
an empty table gives an empty result; no other column is read. Keys of fewer than ``min_chars`` code points
always stay.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.llm.base import same, saved, sliced, tidy
from tallyloom.llm.mph import PerfectHash

SPACE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 65_536
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that a task counts before it hands them on.
COUNTED_KEYS = 50_000
#: A shard with more than so many times the mean of lines is copied (so few are, whatever their number),
HOT_SHARE = 64
#: ... and in no case one with fewer lines.
HOT_LINES = 100_000


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """For each line its 128-bit key, or None if the key is too short to count."""
    out: list[bytes | None] = []
    digest = xxhash.xxh3_128_digest
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE)
        n = len(key)
        if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            out.append(digest(key.lower()))
    return out


def _halves(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _count(min_chars: int):
    def row(seen: dict[bytes, list]) -> pa.RecordBatch:
        h1, h2 = _halves(list(seen))
        return pa.RecordBatch.from_arrays([h1, h2, pa.array([e[0] for e in seen.values()], pa.int64()), pa.array([e[1] for e in seen.values()], pa.int64())], ["h1", "h2", "docs", "keeper"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for key in set(line_keys(text, min_chars)):
                    if key is None:
                        continue
                    entry = seen.get(key)
                    if entry is None:
                        seen[key] = [1, doc_id]
                    else:
                        entry[0] += 1
                        if doc_id is not None and (entry[1] is None or doc_id > entry[1]):
                            entry[1] = doc_id
            if len(seen) >= COUNTED_KEYS:
                yield row(seen)
                seen = {}
        if seen:
            yield row(seen)

    return run


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1.view(np.uint64) >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _with_shard(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1 = batch.column("h1").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(h1, shards)), *batch.columns], ["shard", *batch.schema.names])

    return run


INDEX = "shard long, keys long, lines long, hash binary, prints binary, counts binary, keepers binary, unowned binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard; each shard becomes one row of arrays."""

    def row(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        h1, h2, docs = (t.column(c).to_numpy() for c in ("h1", "h2", "docs"))
        missing = t.column("keeper").is_null().to_numpy()
        keeper = t.column("keeper").fill_null(0).to_numpy()
        # two keys may be placed alike (about never): then all are placed by another seed
        seed, keys = 0, _placing(h1, h2, 0)
        while len(np.unique(keys)) < len(keys):
            seed += 1
            keys = _placing(h1, h2, seed)
        found = PerfectHash.build(keys)
        order = np.argsort(found.slots(keys))
        arrays = [h2[order].tobytes(), np.minimum(docs[order], 2**32 - 1).astype(np.uint32).tobytes(), keeper[order].tobytes(), np.packbits(missing[order]).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(h1)]), pa.array([int(docs.sum())]), pa.array([struct.pack("<q", seed) + found.to_bytes()], pa.binary()), *[pa.array([a], pa.binary()) for a in arrays]], [c.split()[0] for c in INDEX.split(", ")])

    current, parts = None, []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            if a == b:
                continue
            if shards[a] != current:
                if parts:
                    yield row(current, parts)
                current, parts = int(shards[a]), []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield row(current, parts)


def _placing(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h1.view(np.uint64) ^ (h2.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15 + 2 * seed) % 2**64))


class Shard:
    """The arrays of one shard, asked for a whole batch of lines."""

    def __init__(self, row: dict):
        (self.seed,) = struct.unpack_from("<q", row["hash"])
        self.hash = PerfectHash.from_bytes(row["hash"][8:])
        self.prints = np.frombuffer(row["prints"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.keepers = np.frombuffer(row["keepers"], np.int64)
        self.unowned = np.unpackbits(np.frombuffer(row["unowned"], np.uint8), count=len(self.prints)).astype(bool)

    def drops(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, no_doc: np.ndarray, min_docs: int) -> np.ndarray:
        """Which of the lines must go."""
        slots = self.hash.slots(_placing(h1, h2, self.seed))
        at = np.maximum(slots, 0)
        held = (slots >= 0) & (self.prints[at] == h2) & (self.counts[at] >= min_docs)
        owner = np.where(self.unowned[at], no_doc, (self.keepers[at] == doc) & ~no_doc)
        return held & ~owner


def counted_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, docs, keeper of every distinct key; docs: doc_id, text."""
    counted = docs.select("doc_id", "text").mapInArrow(tidy(_count(min_chars)), "h1 long, h2 long, docs long, keeper long")
    return counted.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row of arrays for each shard that has keys."""
    return lines.mapInArrow(tidy(_with_shard(shards)), "shard long, h1 long, h2 long, docs long, keeper long").repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(_build), INDEX)


PROBE = "shard long, salt int, kind int, doc_id long, row long, h1 long, h2 long"
_ARRAYS = ["hash", "prints", "counts", "keepers", "unowned"]


def _probes(min_chars: int, shards: int, copies: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, rows, keys = [], [], []
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = set(line_keys(text, min_chars)) - {None}
                keys += own
                ids += [doc_id] * len(own)
                rows += [row] * len(own)
            if not keys:
                continue
            h1, h2 = _halves(keys)
            shard = _shard_of(h1.to_numpy(), shards)
            salt = np.zeros(len(keys), np.int32)
            for hot, n in copies.items():
                at = np.flatnonzero(shard == hot)
                salt[at] = (h2.to_numpy()[at].view(np.uint64) + np.array([((ids[i] or 0) + rows[i]) % n for i in at], np.uint64)) % np.uint64(n)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(salt), pa.array(np.ones(len(keys), np.int32)), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), h1, h2], [c.split()[0] for c in PROBE.split(", ")])

    return run


def _answer(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard and copy, the arrays before the probes."""
        at, shard = None, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("shard", "salt", "kind")], 1).astype(np.int64)
            cuts = np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if place[a, 2] == 0:
                    at, shard = tuple(place[a, :2]), Shard({c: part.column(c)[0].as_py() for c in _ARRAYS})
                elif at == tuple(place[a, :2]):
                    ids = part.column("doc_id")
                    h1, h2 = part.column("h1").to_numpy(), part.column("h2").to_numpy()
                    go = np.flatnonzero(shard.drops(h1, h2, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), min_docs))
                    if len(go):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(go)), part.column("row").take(pa.array(go)), pa.array(h1[go])], ["doc_id", "row", "h1"])

    return run


def _strip(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept, before, gone = [], [], []
            for text, drops in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_drops").to_pylist(), strict=True):
                text = text or b""
                if not drops:
                    kept.append(text)
                    before.append(text.count(b"\n") + 1)
                    gone.append(0)
                    continue
                drops = set(drops)
                keys = line_keys(text, min_chars)
                stay = [x for x, k in zip(text.split(b"\n"), keys, strict=True) if k is None or int.from_bytes(k[:8], "little", signed=True) not in drops]
                kept.append(b"\n".join(stay))
                before.append(len(keys))
                gone.append(len(keys) - len(stay))
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "_drops")]
            names = [c for c in batch.schema.names if c not in ("text", "_drops")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*names, "text", "_lines", "_dropped"])

    return run


def row_key() -> Column:
    """What tells rows with one doc_id apart: only the lines of their own texts are theirs."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
    """doc_id, row, h1: the keys that each document loses."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("row"))
    lines = saved(counted_lines(docs, min_chars), "lines")
    keys, total = lines.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    shards = max(1, -(-keys // SHARD_KEYS))
    index = saved(build_index(lines, shards), "line-index")
    most = max(hot_lines, HOT_SHARE * total // shards)
    copies = {r["shard"]: -(-r["lines"] // most) for r in index.filter(F.col("lines") > most).select("shard", "lines").collect()}
    salts = F.lit(1)
    if copies:
        salts = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in copies.items() for x in kv]), F.col("shard").cast("int")), F.lit(1))
    nothing = [F.lit(None).cast("long").alias("doc_id"), *[F.lit(0).cast("long").alias(c) for c in ("row", "h1", "h2")]]
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), *nothing, *_ARRAYS)
    probes = docs.mapInArrow(tidy(_probes(min_chars, shards, copies)), PROBE).select("*", *[F.lit(None).cast("binary").alias(c) for c in _ARRAYS])
    both = arrays.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(tidy(_answer(min_docs)), "doc_id long, row long, h1 long")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs: doc_id, text and at most one struct ``_rest`` -> the same with the
    text that stays, and _lines (before) and _dropped."""
    drops = dropped_keys(docs, min_chars, min_docs).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("h1").alias("_drops"))
    joined = docs.join(drops, same(docs["doc_id"], F.col("_id")) & (row_key() == F.col("_row")), "left").drop("_id", "_row")
    others = [f for f in joined.schema.fields if f.name not in ("text", "_drops")]
    schema = StructType([*others, StructField("text", StringType()), StructField("_lines", LongType()), StructField("_dropped", LongType())])
    return joined.select(*[f.name for f in others], F.col("text").cast("string"), "_drops").mapInArrow(tidy(_strip(min_chars)), schema)
