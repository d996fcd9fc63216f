"""SimHash near-dedup with pivot distance tables.

A fingerprint holds, for each of 64 bits, whether it is set in over half of the
hashes of a text's shingles. Texts link when their fingerprints differ in at
most ``max_bits`` bits; groups are the connected components of all links.

Copies share a fingerprint and are one node. For each distinct fingerprint the
distances to ``PIVOTS`` reference fingerprints are its row of the pivot table.
By the triangle inequality two fingerprints within ``max_bits`` differ by at most
that in every coordinate, so a pair with a larger difference in any coordinate
is discarded unseen; the survivors are verified bit by bit.

Random references tell far fingerprints apart only by about half each, so the
table alone would compare all pairs. Pairs are therefore met in cells: the bits
fall into m blocks, two fingerprints within ``max_bits`` agree on at least
m - max_bits of them, and each choice of that many blocks is a cell key. That
loses no pair. m grows with the number of fingerprints, which keeps the pairs in
a cell about constant. In a cell the rows are sorted by the first coordinate and
compared in a window of max_bits on either side. A cell with more than
``CELL_ROWS`` rows, whatever the size of the corpus, is cut into parts, and each
pair of parts goes to a task of its own. From a cell only a spanning forest of its
links leaves, never all its pairs. What moves is a fingerprint and its cell's
number; the key is made again where it arrives.

``near_copies`` (a module of its own) groups by the likeness of whole texts instead.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer
words than a shingle has: the whole sequence; no word or null: fingerprint zero,
linked like any other. component_id is the smallest doc_id of the component (null
doc_ids only if it has no other). Rows that repeat are nodes of one group; an
empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.base import saved, sliced, tidy
from tallyloom.llm.cells import PLACE_BITS, divided
from tallyloom.llm.components import components

SHINGLE, MAX_BITS, SEED, PIVOTS = 3, 3, 42, 8
#: Sampled cells bring a pair that differs in KEY_BITS bits together with chance RECALL.
KEY_BITS, RECALL = 10, 0.95
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: A cell with more rows is cut into parts of at most half as many.
CELL_ROWS = 20_000
#: Pairs that a task looks at at once.
PAIRS_AT_ONCE = 500_000


def shingle_hashes(text: bytes | None, words: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle; bytes.lower() and bytes.split() know exactly A-Z and the six white spaces."""
    found = (text or b"").lower().split()
    if not found:
        return []
    h = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [h(b" ".join(found), seed)]
    if words == 3:
        return [h(b"%b %b %b" % w, seed) for w in zip(found, found[1:], found[2:], strict=False)]
    return [h(b" ".join(w), seed) for w in zip(*(found[i:] for i in range(words)), strict=False)]


def fingerprints_of(texts: list[bytes | None], words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One uint64 a text. Bits are summed over runs of shingles, so memory does not follow a text's length."""
    counts = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    held: list[int] = []
    owner: list[int] = []
    sizes: list[int] = []

    def settle() -> None:
        if not held:
            return
        bits = np.unpackbits(np.array(held, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64)
        starts = np.cumsum([0, *sizes[:-1]])
        np.add.at(counts, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        held.clear(), owner.clear(), sizes.clear()

    for i, text in enumerate(texts):
        found = shingle_hashes(text, words, seed)
        totals[i] = len(found)
        for a in range(0, len(found), CHUNK):
            part = found[a : a + CHUNK]
            held.extend(part), owner.append(i), sizes.append(len(part))
            if len(held) >= CHUNK:
                settle()
    settle()
    return np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_batches(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints = fingerprints_of(batch.column(1).cast(pa.binary()).to_pylist(), words, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, print (the 64 bits as a long)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_fingerprint_batches(words, seed)), "doc_id long, print long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed, seeded."""
    return np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)


def pivot_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each reference."""
    return np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int8)


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """For each choice of blocks - max_bits blocks, the mask of their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def block_count(n: int, max_bits: int) -> int:
    """The blocks with the least work: rows in all cells, and pairs if bits were even."""

    def work(m: int) -> float:
        bits = 64 * (m - max_bits) / m
        return comb(m, max_bits) * (20 * n + n * n / 2 ** (bits + 1))

    return min(range(max_bits + 1, max_bits + 7), key=work)


def sampled_masks(n: int, key_bits: int = KEY_BITS, recall: float = RECALL) -> list[int]:
    """Masks of k random bits each: k by the least work, as many masks as the recall asks for."""

    def tables(k: int) -> int:
        return ceil(log(1 - recall) / log(1 - comb(64 - key_bits, k) / comb(64, k)))

    k = min(range(4, 41), key=lambda k: tables(k) * (20 * n + n * n / 2 ** (k + 1)))
    rng = np.random.default_rng(65)
    return [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in range(tables(k))]


def _forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0..n-1 with links a-b (added to those behind ``label``), the smallest node of each component."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _closest(n: int, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indexes of links a-b that span what all span, the nearest first (a minimum spanning forest)."""
    label = np.arange(n)
    taken = [np.empty(0, np.int64)]
    for d in np.unique(bits):
        at = np.flatnonzero(bits == d)
        while True:
            la, lb = label[a[at]], label[b[at]]
            apart = la != lb
            at = at[apart]
            if not len(at):
                break
            # each component takes one link to one with a smaller label, so no circle can close
            high, pick = np.unique(np.maximum(la, lb)[apart], return_index=True)
            hook = np.arange(n)
            hook[high] = np.minimum(la, lb)[apart][pick]
            while (hook[hook] != hook).any():
                hook = hook[hook]
            label = hook[label]
            taken.append(at[pick])
    return np.concatenate(taken)


def near(prints: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs a, b link: the pivot table first, the bits of the survivors after."""
    live = np.arange(len(a))
    for k in range(table.shape[1]):
        live = live[np.abs(table[a[live], k] - table[b[live], k]) <= max_bits]
    return live[np.bitwise_count(prints[a[live]] ^ prints[b[live]]) <= max_bits]


def _links(
    prints: np.ndarray, roots: np.ndarray, sketches: np.ndarray, group: np.ndarray, side: np.ndarray, refs: np.ndarray, max_bits: int, give: str
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within all whole groups in the arrays, as ``give`` says (see ``near_links``).

    side: 0, 1 for a pair of parts of one cell (only 0-1 pairs meet), 2 for a whole.
    """
    table = pivot_table(prints, refs)
    order = np.lexsort((table[:, 0], group))
    prints, roots, sketches, group, side, table = (x[order] for x in (prints, roots, sketches, group, side, table))
    n = len(prints)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    first = table[:, 0].astype(np.int64)
    # the end of each row's window: within its group, and within max_bits of its first coordinate
    ends = np.repeat(starts + sizes, sizes)
    rank = np.repeat(np.arange(len(starts)), sizes) * 1024 + first
    ends = np.minimum(ends, np.searchsorted(rank, rank + max_bits, side="right"))
    label = np.arange(n)
    span_a = span_b = np.empty(0, np.int64)
    # rows of one root in one group are one node of the spanning forest
    node = np.unique(group * n + np.unique(roots, return_inverse=True)[1], return_inverse=True)[1] if give == "closest" else label
    at = 0
    width = ends - np.arange(n) - 1
    budget = np.cumsum(width)
    while at < n:
        # so many rows that about PAIRS_AT_ONCE pairs are looked at at once
        stop = max(at + 1, int(np.searchsorted(budget, (budget[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        w = width[at:stop]
        a = np.repeat(np.arange(at, stop), w)
        b = a + 1 + (np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w))
        meet = (side[a] != side[b]) | (side[a] == 2)
        if give == "closest":
            meet &= roots[a] != roots[b]
        a, b = a[meet], b[meet]
        hit = near(prints, table, a, b, max_bits)
        if give == "closest":
            span_a, span_b = np.r_[span_a, a[hit]], np.r_[span_b, b[hit]]
            span = _closest(n, node[span_a], node[span_b], np.bitwise_count(sketches[span_a] ^ sketches[span_b]).sum(1, dtype=np.int64))
            span_a, span_b = span_a[span], span_b[span]
        else:
            label = _forest(n, a[hit], b[hit], label)
        at = stop
    if give == "closest":
        yield prints[span_a], prints[span_b]
    else:
        moved = np.flatnonzero(label != np.arange(n))
        yield prints[moved], prints[label[moved]]


def _link_batches(max_bits: int, refs: np.ndarray, give: str):
    """Rows come by cell; whole cells are taken together until there is enough to do at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            for a, b in _links(*(np.concatenate(x) for x in zip(*parts, strict=True)), refs, max_bits, give):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple] = []
        last, number, rows = None, 0, 0
        for batch in batches:
            w, key, bits = (batch.column(c).to_numpy() for c in ("w", "key", "print"))
            place = w >> 2
            roots, sketches = bits, bits.view(np.uint64)[:, None]
            if "root" in batch.schema.names:
                roots = batch.column("root").to_numpy()
                sketches = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(len(bits), -1)
            new = np.r_[False, (np.diff(key) != 0) | (np.diff(place) != 0)]
            new[0] = (place[0], key[0]) != last
            last = (place[-1], key[-1])
            group = number + np.cumsum(new)
            number = int(group[-1])
            side = w & 3
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            values = (bits.view(np.uint64), roots, sketches, group, side)
            if cut or new[0]:
                held.append(tuple(x[:cut] for x in values))
                rows += cut
                if rows > 50_000 and any(len(h[0]) for h in held):
                    yield from out(held)
                    held, rows = [], 0
                held.append(tuple(x[cut:] for x in values))
            else:
                held.append(values)
            rows += len(bits) - cut
        if held:
            yield from out(held)

    return run


def near_links(
    prints: DataFrame, max_bits: int = MAX_BITS, refs: np.ndarray | None = None, cell_rows: int = CELL_ROWS, masks: list[int] | None = None, give: str = "star"
) -> DataFrame:
    """a, b: links that join the distinct fingerprints (``print``, a written table) as all links would.

    The cells are those of ``masks``, by default those that lose no pair. A cell
    gives, by ``give``, "star": from each print to the smallest it is joined with;
    "closest": a spanning forest of its links, nearest first. If there are columns
    ``root`` and ``sketch`` (array<long>), rows of one root are joined already, and
    the sketches tell which links are nearest.
    """
    refs = pivots() if refs is None else refs
    n = prints.count()
    masks = block_masks(block_count(n, max_bits), max_bits) if masks is None else masks
    table = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    own = [c for c in ("root", "sketch") if c in prints.columns]
    cells = prints.select("print", *own, F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"))
    cells = divided(cells.withColumn("key", F.col("print").bitwiseAND(F.element_at(table, F.col("t") + 1))), ["t", "key"], "print", cell_rows)
    # only the place and the print move; the key follows from them
    moved = cells.select((F.shiftleft(F.col("t").cast("long"), PLACE_BITS) + F.col("w")).alias("w"), "print", *own)
    t = F.shiftright("w", PLACE_BITS).cast("int")
    key = F.col("print").bitwiseAND(F.element_at(table, t + 1))
    met = moved.repartition(F.shiftright("w", 2), key).select("w", key.alias("key"), "print", *own).sortWithinPartitions(F.shiftright("w", 2), "key")
    return met.mapInArrow(tidy(_link_batches(max_bits, refs, give)), "a long, b long")


def _grouped(named: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, print, component_id for every row of ``named``."""
    rooted = saved(_rooted(classes, links), "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.join(ids, "root").select("print", "component_id")
    return named.join(members, "print").select("doc_id", "print", "component_id")


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    stars = components(links)
    return classes.join(stars, classes["print"] == stars["node"], "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))


def _classes(docs: DataFrame, words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    named = saved(fingerprints(docs, words, seed), "simhashes")
    return named, saved(named.groupBy("print").agg(F.min("doc_id").alias("first_id")), "simhash-classes")


def simhash_groups(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, print, component_id for every row of ``docs`` (doc_id, text)."""
    named, classes = _classes(docs, words, seed)
    return _grouped(named, classes, near_links(classes.select("print"), max_bits))
