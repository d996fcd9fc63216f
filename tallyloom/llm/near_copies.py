"""Near copies: texts grouped by the likeness of their five-word shingles.

Texts link when their sets of five-word shingles overlap (Jaccard) in 0.8 or more;
groups are the components of all links, and no link is missed. Texts of the same
words are one node (by 128 bits over the words).

Two passes join most copies at little cost: SimHash cells are keys of some bits
chosen at random, pairs within ``CANDIDATE_BITS`` (past the pivot table) give
spanning forests, nearest first, by fingerprints and then between groups not
joined so far by sketches (wider fingerprints over the set of five-word shingles),
and each edge is verified on the shingles of both whole texts.

What these passes miss or refuse is then looked at in full: all pairs of texts
under different roots go through a prefix join, none left out. First, texts that
can overlap enough with no other are told by lists. A text's list is the first
``LIST`` * (size - ceil(0.8 size) + 1) of its shingles in the order of their hashes; two
texts that overlap enough have a number of list entries in common that follows from
their sizes (``list_overlap``), so a text stays only if the lists of other texts hold
as many of its entries. Of the texts that stay, all shingles are counted; those that
no other of them has are dropped, and then texts with less than 0.8 of theirs left.
What is left is put in order by the number of texts that hold it, the rarest first,
and only the first of each text (those before the last ceil(0.8 size) - 1) are cells in
which texts meet, so a passage that many texts share brings them together only if
it is nearly all that they have. Lengths, places and the parities of both sets
discard only pairs that cannot overlap enough, and every pair left is verified like
the others. As a crowd of copies that
the fingerprints left apart would meet in all its pairs, ``CHAINS`` rounds come
first in which a text meets only the next one in each of its cells; the last round
takes all pairs that are under different roots still.

What moves is kept small: a list entry is a hash and the name of its text, and moves
once; texts are not moved to be compared unless they are in a candidate pair: the
names of those texts go to all tasks up to ``FEW_TEXTS`` of them, and meet the texts
by a shuffle beyond. Large cells are cut as ``cells`` says.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer
words than a shingle has: the whole sequence; null, empty and blank texts have no
words and are copies of each other. component_id is the smallest doc_id of the group
(null only if it has no other). Rows that repeat, and rows that share a doc_id,
are each a row of the result; very long texts are taken whole; an empty table
gives an empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.base import same, saved, sliced, tidy
from tallyloom.llm.cells import divided, large_cells
from tallyloom.llm.components import components
from tallyloom.llm.simhash import CELL_ROWS, CHUNK, PAIRS_AT_ONCE, SEED, SHINGLE, fingerprints_of, near_links, sampled_masks, shingle_hashes

#: Words of a shingle, least similarity, most differing bits of a candidate pair.
NEAR_WORDS, SIMILARITY, CANDIDATE_BITS = 5, 0.8, 12
#: 64-bit words of a sketch.
SKETCH_WORDS = 8
#: 64-bit words of a set's parities, and of the shorter ones that go along into cells.
MAP_WORDS, CELL_WORDS = 8, 2
#: How many times the shortest prefix that loses nothing is in a list.
LIST = 1.5
#: What an entry of a cut cell counts as when entries are put in order.
VERY_MANY = 1 << 30
#: Texts whose shingles are handed on at once.
GRAM_ROWS = 128
#: So many names of candidate texts go to all tasks.
FEW_TEXTS = 1_000_000
#: Rounds of the prefix join in which a cell gives chains, before the one in which it gives all pairs.
CHAINS = 1
#: Shingles of texts that a task keeps while it verifies pairs.
KEPT_GRAMS = 4_000_000


def sketch_of(grams: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS SimHashes of a set of hashes, each after a mixing of its own (splitmix64)."""
    out = np.zeros(SKETCH_WORDS, np.uint64)
    for w in range(SKETCH_WORDS):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(grams), CHUNK):
            x = grams[at : at + CHUNK].view(np.uint64) + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            counts += np.unpackbits(x.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out[w] = np.packbits(counts * 2 > len(grams), bitorder="little").view(np.uint64)[0]
    return out


def text_key(text: Column) -> Column:
    """128 bits for a text as it is; null for null."""
    return F.unhex(F.md5(text.cast("binary"))).alias("text_key")


def _words_digest(text: bytes | None) -> tuple[int, int]:
    """The 128 bits that stand for a text's words, as two longs."""
    d = np.frombuffer(xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split())), np.int64)
    return int(d[0]), int(d[1])


def _gram_set(text: bytes | None, words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))


def prefix_size(n: int, similarity: float) -> int:
    """Two sets that overlap in ``similarity`` share one of their first so many elements, in any one order."""
    return n - ceil(similarity * n - 1e-9) + 1 if n else 0


def parity(own: np.ndarray, words: int) -> np.ndarray:
    """For each of words * 64 places, whether an odd number of elements falls there."""
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) % (words * 64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def list_size(n: int, similarity: float) -> int:
    return min(n, ceil(LIST * prefix_size(n, similarity)))


def list_overlap(n: int, similarity: float) -> int:
    """The least number of entries that the list of a set of n elements shares with that of any set that overlaps in ``similarity``.

    Of their common elements, in the order of hashes, the j-th stands at most j - 1
    places behind the prefix of either, so the first list_size - prefix_size + 1
    are in a list; the other set has similarity * n elements at least.
    """
    m = ceil(similarity * n - 1e-9)
    return list_size(m, similarity) - prefix_size(m, similarity) + 1


_CELL_MAP = [f"m{i}" for i in range(CELL_WORDS)]
SETS = "doc_id long, text_key binary, high long, low long, print long, size int, need int, list array<long>, map array<long>, " + ", ".join(f"{c} long" for c in _CELL_MAP)


def _set_batches(words: int, similarity: float, print_words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, GRAM_ROWS):
                some = batch.column(1).cast(pa.binary()).slice(at, GRAM_ROWS).to_pylist()
                digests = np.array([_words_digest(t) for t in some], np.int64).reshape(-1, 2)
                sets = [_gram_set(t, words, seed) for t in some]
                sizes = [len(g) for g in sets]
                columns = {
                    "doc_id": batch.column(0).slice(at, GRAM_ROWS),
                    "text_key": batch.column(2).slice(at, GRAM_ROWS),
                    "high": pa.array(digests[:, 0]),
                    "low": pa.array(digests[:, 1]),
                    "print": pa.array(fingerprints_of(some, print_words, seed).view(np.int64)),
                    "size": pa.array(sizes, pa.int32()),
                    "need": pa.array([list_overlap(n, similarity) for n in sizes], pa.int32()),
                    "list": pa.array([g[: list_size(len(g), similarity)].view(np.int64) for g in sets], longs),
                    "map": pa.array([parity(g, MAP_WORDS) for g in sets], longs),
                }
                small = np.array([parity(g, CELL_WORDS) for g in sets], np.int64).reshape(-1, CELL_WORDS)
                columns |= {c: pa.array(small[:, i]) for i, c in enumerate(_CELL_MAP)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _named_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        digests = np.array([_words_digest(t) for t in texts], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), batch.column(0)], ["high", "low", "text"])


def texts_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, text: one text for each of the ``nodes`` (a written table)."""
    own = saved(classes.join(nodes, "node", "left_semi").select("node", "high", "low", "first_id"), "near-own")
    names = own.select(F.col("first_id").alias("_id")).distinct()
    names = F.broadcast(names) if own.count() <= FEW_TEXTS else names
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    found = texts.join(names, same(F.col("doc_id"), F.col("_id")), "left_semi").select("text").mapInArrow(tidy(_named_texts), "high long, low long, text string")
    # other texts under the same doc_id fall away here
    found = found.join(own.select("node", "high", "low"), ["high", "low"]).select("node", "text")
    return found.dropDuplicates(["node"])


def _sketch_batches(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sketches = [sketch_of(_gram_set(t, words, seed).view(np.int64)).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.list_(pa.int64()))], ["node", "sketch"])

    return run


def may_overlap(both, apart, similarity: float):
    """Whether two sets with ``both`` elements together that differ in ``apart`` of them or more may overlap in ``similarity``."""
    return (both - apart) / 2 * (1 + similarity) >= similarity * both - 1e-9


def _prefix_links(cell: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray, back: np.ndarray, side: np.ndarray, odd: np.ndarray, similarity: float, chain: bool) -> Iterator[np.ndarray]:
    """Pairs of nodes under different roots that meet in a cell (a shingle among the first of both) and may overlap enough.

    chain: only neighbours by size, ties in an order that each cell has of its own.
    """
    ties = (node * 0x9E3779B1 + cell * 0x85EBCA6B) & 0xFFFFFFFF
    order = np.lexsort((ties, size, cell))
    cell, node, root, size, at, back, side, odd = (x[order] for x in (cell, node, root, size, at, back, side, odd))
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    keep = np.repeat(mixed, np.diff(np.r_[starts, len(cell)]))
    cell, node, root, size, at, back, side, odd = (x[keep] for x in (cell, node, root, size, at, back, side, odd))
    if not len(cell):
        return
    # the length filter: sizes of one cell stand in order
    rank = (cell - cell[0]) * (1 << 32) + size
    most = np.minimum(np.floor(size / similarity + 1e-9).astype(np.int64), (1 << 32) - 1)
    width = np.searchsorted(rank, rank - size + most, side="right") - np.arange(len(cell)) - 1
    if chain:
        width = np.minimum(width, 1)
    budget = np.cumsum(width)
    done, found, waiting = 0, [], 0
    while done < len(cell):
        stop = max(done + 1, int(np.searchsorted(budget, (budget[done - 1] if done else 0) + PAIRS_AT_ONCE, side="right")))
        w = width[done:stop]
        a = np.repeat(np.arange(done, stop), w)
        b = a + 1 + (np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w))
        meet = (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] == 2))
        a, b = a[meet], b[meet]
        # no more can be shared before the shingle than the lesser place, nor from it on than what is left
        fits = np.minimum(at[a], at[b]) + np.minimum(back[a], back[b]) >= np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - 1e-9)
        a, b = a[fits], b[fits]
        both = size[a] + size[b]
        fits = may_overlap(both, np.bitwise_count(odd[a] ^ odd[b]).sum(1, dtype=np.int64), similarity)
        a, b = node[a[fits]], node[b[fits]]
        found.append(np.stack([np.maximum(a, b), np.minimum(a, b)], 1))
        waiting += len(a)
        if waiting > PAIRS_AT_ONCE:
            yield np.unique(np.concatenate(found), axis=0)
            found, waiting = [], 0
        done = stop
    if found:
        yield np.unique(np.concatenate(found), axis=0)


def _prefix_batches(similarity: float, chain: bool):
    """Rows come by cell; whole cells are taken together until there is enough to do at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            for pairs in _prefix_links(*(np.concatenate(x) for x in zip(*parts, strict=True)), similarity, chain):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[tuple] = []
        last, number, rows = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, w, node, root = (batch.column(c).to_numpy() for c in ("key", "w", "node", "root"))
            place = w >> 2
            new = np.r_[False, (np.diff(key) != 0) | (np.diff(place) != 0)]
            new[0] = (key[0], place[0]) != last
            last = (key[-1], place[-1])
            cell = number + np.cumsum(new)
            number = int(cell[-1])
            odd = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in _CELL_MAP], 1)
            values = (cell, node, root, *(batch.column(c).to_numpy().astype(np.int64) for c in ("size", "at", "back")), w & 3, odd)
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if new.any():
                held.append(tuple(x[:cut] for x in values))
                rows += cut
                if rows > 50_000:
                    yield from out(held)
                    held, rows = [], 0
            held.append(tuple(x[cut:] for x in values))
            rows += len(key) - cut
        if rows:
            yield from out(held)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task hands on the list of texts of the same words once."""
    seen = np.empty(0, np.int64)
    for batch in batches:
        high, first = np.unique(batch.column("high").to_numpy(), return_index=True)
        fresh = ~np.isin(high, seen)
        seen = np.union1d(seen, high)
        yield batch.take(pa.array(np.sort(first[fresh])))


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key and text; repeats go, and keys that a single text holds. A large cell's rows (parts > 0) all stay."""
    held: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        key, high, parts = (np.concatenate(x) for x in zip(*held, strict=True))
        new = np.r_[True, key[1:] != key[:-1]]
        own = new | np.r_[True, high[1:] != high[:-1]]
        group = np.cumsum(new) - 1
        keep = own & ((np.bincount(group, weights=own)[group] > 1) | (parts > 0))
        holders = np.where(parts > 0, VERY_MANY, np.bincount(group, weights=own)[group]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(high[keep]), pa.array(holders[keep])], ["key", "high", "holders"])

    for batch in batches:
        if not batch.num_rows:
            continue
        values = tuple(batch.column(c).to_numpy() for c in ("key", "high", "parts"))
        key = values[0]
        # whole keys are taken together; the last one may go on in the next batch
        cut = int(np.searchsorted(key, key[-1]))
        if held and key[0] != held[-1][0][-1]:
            yield from out()
            held = []
        if cut:
            held.append(tuple(x[:cut] for x in values))
            yield from out()
            held = []
        held.append(tuple(x[cut:] for x in values))
    if held:
        yield from out()


def shared_entries(lists: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """key, high, holders of the entries that several texts (high) have in their lists, without repeats. lists: high, list; it is read twice."""
    once = lists.select("high", "list").mapInArrow(tidy(_once), "high long, list array<long>")
    cells = once.select("high", F.explode("list").alias("key"))
    large = large_cells(cells, ["key"], cell_rows)
    if large is None:
        cells = cells.withColumn("parts", F.lit(0)).repartition("key")
    else:
        cells = cells.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
        cells = cells.repartition("key", F.when(F.col("parts") > 0, F.pmod("high", "parts")))
    return cells.select("key", "high", "parts").sortWithinPartitions("key", "high").mapInArrow(tidy(_shared_batches), "key long, high long, holders long")


def _full_batches(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GRAM_ROWS):
                part = batch.slice(at, GRAM_ROWS)
                lists = [_gram_set(t, words, seed).view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(lists, pa.list_(pa.int64()))], ["high", "list"])

    return run


def first_cells(entries: DataFrame, sizes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key, node, at, back: of the texts that can overlap with another the first of their shingles, the rarest first.

    entries: key, node, holders, without repeats: all that are not the node's alone; sizes: node, size. at: how many shared
    shingles of the text stand before this one, back: how many from it on.
    """
    text = Window.partitionBy("node")
    need = F.ceil(F.col("size") * similarity - F.lit(1e-9))
    rows = entries.join(sizes, "node").withColumn("shared", F.count("*").over(text)).filter(F.col("shared") >= need)
    rows = rows.withColumn("place", F.row_number().over(text.orderBy("holders", "key"))).filter(F.col("place") <= F.col("shared") - need + 1)
    return rows.select("key", "node", (F.col("place") - 1).alias("at"), (F.col("shared") - F.col("place") + 1).cast("int").alias("back"))


def prefix_pairs(cells: DataFrame, maps: DataFrame, similarity: float = SIMILARITY, chain: bool = False) -> DataFrame:
    """a, b: all pairs of different roots that may overlap in ``similarity``; no pair that does is missing.

    cells: key, w (see ``divided``), node, root, size, at, back (see ``first_cells``), m0, m1
    (parities of the whole set); maps: node, size, map (more of them); chain: of each cell
    only neighbours.
    """
    met = cells.select("key", "w", "node", "root", "size", "at", "back", *_CELL_MAP).repartition("key", F.shiftright("w", 2)).sortWithinPartitions("key", F.shiftright("w", 2))
    pairs = met.mapInArrow(tidy(_prefix_batches(similarity, chain)), "a long, b long").distinct()
    left = maps.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("map").alias("ma"))
    right = maps.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("map").alias("mb"))
    # sets differ in at least as many elements as their parities do
    apart = sum((F.bit_count(F.col("ma")[w].bitwiseXOR(F.col("mb")[w])) for w in range(MAP_WORDS)), F.lit(0))
    return pairs.join(left, "a").join(right, "b").filter(may_overlap(F.col("na") + F.col("nb"), apart, similarity)).select("a", "b")


def _verify_batches(similarity: float, words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        kept = 0
        for batch in batches:
            ends = [batch.column(c).to_pylist() for c in ("a", "b")]
            texts = [batch.column(c).cast(pa.binary()) for c in ("ta", "tb")]
            keep = np.zeros(batch.num_rows, bool)
            for row, pair in enumerate(zip(*ends, strict=True)):
                own = []
                for node, column in zip(pair, texts, strict=True):
                    grams = sets.get(node)
                    if grams is None:
                        if kept > KEPT_GRAMS:
                            sets, kept = {}, 0
                        grams = sets[node] = _gram_set(column[row].as_py(), words, seed)
                        kept += len(grams)
                    own.append(grams)
                na, nb = map(len, own)
                if min(na, nb) < similarity * max(na, nb):
                    continue
                both = len(np.intersect1d(*own, assume_unique=True))
                keep[row] = both >= similarity * max(na + nb - both, 1) - 1e-9
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles overlap in ``similarity`` or more. texts: node, text."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(tidy(_verify_batches(similarity, words, seed)), "a long, b long")


def near_copies(
    docs: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY, max_bits: int = CANDIDATE_BITS, print_words: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """doc_id, text_key, print, root, component_id for every row of ``docs`` (doc_id, text), linked by the likeness of their shingles.

    A group's rows have one ``root``; text_key is that of ``text_key()``.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), text, text_key(text))
    named = saved(texts.mapInArrow(tidy(_set_batches(words, similarity, print_words, seed)), SETS), "near-texts")
    # one node for each sequence of words
    own = [F.first(c).alias(c) for c in ("print", "size", "need", *_CELL_MAP)]
    classes = named.groupBy("high", "low").agg(F.min("doc_id").alias("first_id"), *own).withColumn("node", F.monotonically_increasing_id())
    classes = saved(classes, "near-classes")
    # the fingerprints join most copies at little cost; of the texts with one fingerprint, one stands in their cells
    met = saved(classes.groupBy("print").agg(F.min("node").alias("node")), "simhash-classes")
    masks = sampled_masks(met.count())

    def candidates(prints: DataFrame) -> DataFrame:
        pairs = near_links(prints, max_bits, masks=masks, give="closest")
        pairs = pairs.join(met.select(F.col("print").alias("a"), F.col("node").alias("_a")), "a").join(met.select(F.col("print").alias("b"), F.col("node").alias("_b")), "b")
        return pairs.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct()

    def rooted(links: DataFrame) -> DataFrame:
        stars = components(links)
        return classes.join(stars, "node", "left").select("node", "first_id", "high", "low", "size", F.coalesce("root", "node").alias("root"))

    def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return saved(verified(pairs, texts, similarity, words, seed), "near-verified")

    first = saved(candidates(met.select("print")), "simhash-pairs")
    ends = saved(texts_of(_both_ends(first), docs, classes), "near-ends")
    linked = checked(first, ends)
    sketches = ends.mapInArrow(tidy(_sketch_batches(words, seed)), "node long, sketch array<long>")
    apart = sketches.join(met, "node").join(rooted(linked).select("node", "root"), "node").select("print", "root", "sketch")
    second = saved(candidates(saved(apart, "simhash-apart")).join(first, ["a", "b"], "left_anti"), "simhash-pairs")
    linked = linked.unionByName(checked(second, ends))
    # all pairs that are not joined so far and can overlap enough, none left out
    live = shared_entries(named).groupBy("high").agg(F.count("*").alias("shared"))
    live = saved(classes.join(live, "high").filter(F.col("shared") >= F.col("need")).select("node", "high", "low", "first_id", "size", *_CELL_MAP), "near-live")
    texts = saved(texts_of(live.select("node"), docs, live), "near-ends")
    entries = shared_entries(texts.mapInArrow(tidy(_full_batches(words, seed)), "high long, list array<long>")).withColumnRenamed("high", "node")
    cells = first_cells(entries, live.select("node", "size"), similarity).join(live.select("node", "size", *_CELL_MAP), "node")
    cells = saved(divided(saved(cells, "near-cells"), ["key"], "node", CELL_ROWS), "near-cells")
    held = cells.select("node").distinct().join(live.select("node", "high", "low", "size"), "node")
    maps = saved(named.select("high", "low", "map").join(held, ["high", "low"]).dropDuplicates(["node"]).select("node", "size", "map"), "near-maps")
    tried = first
    for n in range(CHAINS + 1):
        met_now = cells.join(rooted(linked).select("node", "root"), "node")
        pairs = saved(prefix_pairs(met_now, maps, similarity, chain=n < CHAINS).join(tried, ["a", "b"], "left_anti"), "near-pairs")
        linked = linked.unionByName(checked(pairs, texts))
        tried = tried.unionByName(pairs)
    roots = saved(rooted(linked), "near-roots")
    ids = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = roots.join(ids, "root").select("high", "low", "root", "component_id")
    return named.join(members, ["high", "low"]).select("doc_id", "text_key", "print", "root", "component_id")
