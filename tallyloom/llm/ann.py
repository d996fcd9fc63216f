"""Approximate nearest neighbours: a hierarchical k-means tree, best bin first.

The tree has as many levels as the table needs. Its first is fitted on at most
``SAMPLE`` vectors drawn by a digest of vec_id; a leaf that then holds more than
``SPLIT`` rows gets a subtree, fitted on at most about ``SAMPLE`` of its own rows in
a task, and so on, so leaves stay below a fixed number of rows at any size of the
table. The rows of a leaf are packed into parts of about ``PART`` rows (only a leaf that does not
come apart, such as one vector a third of the table, has many), and each part has a
fine tree over its own rows down to about ``FINE`` rows a bin. All rows are indexed.

A search takes nodes from a priority queue by the distance of their centre, and so
meets leaves, and in a part its bins, in the order of promise. How many it takes at
each level is calibrated: the exact neighbours of ``CALIBRATION`` vectors, which no
first-level fit has seen, are found among all rows, and the numbers of visits are widened
together until their mean recall reaches ``RECALL``. Bins whose ball cannot hold a
nearer vector than the k found so far in the part are passed over, which loses nothing.

What moves: the rows once for each level and once as packed parts, and each query
once for each leaf (not bin) that it visits. A task holds one part at a time, answers
whole batches of queries, and sends on at most k rows for each; the parts' rows
meet by query. Distances are Euclidean, in double precision, by differences of the
original components; a matrix product only picks what is worth that. The tree sees
components over a common power of two and cut at ``LIMIT``, so its squares are finite;
a distance whose squares are not, or vanish, is made again over its largest difference.

Defined results: vectors that are null, zero, hold a null or non-finite component
or have another length than most (of equally common lengths the smaller) take no
part, as query or candidate. A query is a vec_id; of different vectors under one
vec_id the smallest is searched for, and all rows with the query's vec_id count as
its own. Repeated rows of other vec_ids are candidates each. Ties go to the
smaller vec_id; with fewer than k candidates all are returned; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.base import quoted, saved, tidy

K = 10
SAMPLE, BRANCHES, LEAF_SAMPLE, ROUNDS, SEED = 20_000, 12, 48, 8, 11
CALIBRATION, RECALL = 256, 0.97
#: Rows of a part and of a bin; a leaf with more rows than SPLIT gets a subtree.
PART, FINE, SPLIT = 8192, 48, 12_000
#: Levels of trees above the parts, and leaves of a tree at most (its numbers have so many bits).
LEVELS, LEAF_BITS = 5, 12
#: Components beyond are cut for the tree.
LIMIT = 1e100
#: Queries that are answered at once.
TOGETHER = 256


@dataclass
class Tree:
    """A node is a centre; a leaf has a number, an inner node its children."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf_of: list[int] = field(default_factory=list)  # leaf number of a node, -1 for inner nodes
    leaves: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: int, branches: int = BRANCHES, seed: int = SEED) -> Tree:
        rng = np.random.default_rng(seed)
        tree, centres = cls(np.zeros((0, 0))), []

        def node(points: np.ndarray, centre: np.ndarray) -> int:
            number = len(centres)
            centres.append(centre)
            tree.children.append([])
            tree.leaf_of.append(-1)
            full = tree.leaves >= (1 << LEAF_BITS) - 2 * branches
            # no more children than fill leaves
            parts = _kmeans(points, min(branches, -(-len(points) // leaf_rows)), rng) if len(points) > leaf_rows and not full else None
            if parts is None:
                tree.leaf_of[number] = tree.leaves
                tree.leaves += 1
            else:
                for c, mine in parts:
                    tree.children[number].append(node(points[mine], c))
            return number

        node(x, x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
        tree.centres = np.array(centres)
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf_of[node] >= 0:
                out[rows] = self.leaf_of[node]
                continue
            kids = np.array(self.children[node])
            near = _squares(x[rows], self.centres[kids]).argmin(axis=1)
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def visit(self, x: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves for each vector, best bin first."""
        out = []
        for near in _squares(x, self.centres).tolist():
            queue, found = [(0.0, 0)], []
            while queue and len(found) < most:
                _, node = heapq.heappop(queue)
                leaf = self.leaf_of[node]
                if leaf >= 0:
                    found.append(leaf)
                else:
                    for kid in self.children[node]:
                        heapq.heappush(queue, (near[kid], kid))
            out.append(found)
        return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)[None, :]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Centre and rows of at most k parts; None if the points do not come apart."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = _squares(x, centres).argmin(axis=1)
        used = np.unique(near)
        centres = np.array([x[near == i].mean(axis=0) for i in used])
    near = _squares(x, centres).argmin(axis=1)
    used = np.unique(near)
    if len(used) < 2:
        return None
    return [(centres[i], np.flatnonzero(near == i)) for i in used]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _seen(x: np.ndarray, scale: float) -> np.ndarray:
    """What a tree sees of vectors."""
    return np.clip(x * scale, -LIMIT, LIMIT)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to q."""
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(d) | (d < 1e-140))
        if len(odd):
            half = np.abs(x[odd] / 2 - q / 2)
            most = half.max(axis=1)
            own = np.where(most > 0, most, 1.0)
            d[odd] = 2 * (most * np.sqrt(((half / own[:, None]) ** 2).sum(axis=1)))
    return d


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part, whatever their length."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    # the null test comes first: nothing is asked of a null vector
    return vectors.filter(F.coalesce(finite & some, F.lit(False)) & F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), v.alias("vector"))


class Part:
    """Packed rows of a leaf, in the order of their bins, with the fine tree over them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: float, fine: int):
        seen = _seen(x, scale)
        self.tree = Tree.fit(seen, fine)
        bins = self.tree.assign(seen)
        order = np.argsort(bins, kind="stable")
        self.ids, self.x, self.scale = ids[order], x[order], scale
        self.starts = np.searchsorted(bins[order], np.arange(self.tree.leaves + 1))
        middle = np.zeros((self.tree.leaves, x.shape[1]))
        for node, leaf in enumerate(self.tree.leaf_of):
            if leaf >= 0:
                middle[leaf] = self.tree.centres[node]
        self.middle = middle
        far = np.sqrt(((seen[order] - middle[bins[order]]) ** 2).sum(axis=1))
        self.radius = np.zeros(self.tree.leaves)
        np.maximum.at(self.radius, bins[order], far)

    def ready(self) -> Part:
        self.seen = _seen(self.x, self.scale)
        self.squares = (self.seen * self.seen).sum(1)
        # a cut component would make a bound by the tree's vectors wrong
        self.whole = bool((np.abs(self.seen) < LIMIT).all())
        self.slack = 1e-9 * self.squares.max(initial=0.0)
        return self

    def _rows(self, bins: np.ndarray) -> np.ndarray:
        sizes = self.starts[bins + 1] - self.starts[bins]
        return np.repeat(self.starts[bins] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def nearest(self, q_id: int, q: np.ndarray, bins: list[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, distances and places of bins (in their order) of the k nearest in the given bins, ties to the smaller id."""
        bins = np.array(bins, np.int64)
        own = _seen(q, self.scale)
        bounded = self.whole and bool((np.abs(own) < LIMIT).all())
        square = float(own @ own)

        def rough(rows: np.ndarray) -> np.ndarray:
            return self.squares[rows] - 2.0 * (self.seen[rows] @ own) + square

        slack = self.slack + 1e-9 * square
        rows = self._rows(bins)
        rows = rows[self.ids[rows] != q_id]
        if bounded and len(rows) > 4 * k:
            # the first bins that hold enough rows give a bound, and bins beyond it are passed over
            ahead = np.cumsum(self.starts[bins + 1] - self.starts[bins])
            first = int(np.searchsorted(ahead, 4 * k)) + 1
            start = self._rows(bins[:first])
            start = start[self.ids[start] != q_id]
            if len(start) > k:
                bound = np.partition(rough(start), k - 1)[k - 1] + slack
                edge = np.sqrt(((self.middle[bins] - own) ** 2).sum(axis=1)) - self.radius[bins] * (1 + 1e-9)
                rows = self._rows(bins[(edge <= np.sqrt(max(bound, 0.0)) * (1 + 1e-9)) | (np.arange(len(bins)) < first)])
                rows = rows[self.ids[rows] != q_id]
            d = rough(rows)
            rows = rows[d <= np.partition(d, k - 1)[k - 1] + 2 * slack] if len(rows) > k else rows
        exact = distances(self.x[rows], q)
        best = np.lexsort((self.ids[rows], exact))[:k]
        place = np.zeros(self.tree.leaves, np.int64)
        place[bins] = np.arange(len(bins))
        bin_of = np.searchsorted(self.starts, rows[best], side="right") - 1
        return rows[best], exact[best], place[bin_of]


@dataclass
class Index:
    """rows: vec_id, vector (a written table); tree: the first level; subtrees: (leaf, tree) of each further level;
    parts: leaf, part, pack; counts: leaf, parts. visits: leaves taken at each level, and bins of a part."""

    rows: DataFrame
    tree: Tree
    subtrees: list[DataFrame]
    parts: DataFrame
    counts: DataFrame
    visits: list[int]
    recall: float
    dim: int
    scale: float


#: Trees (kind 0) come before the rows (kind 1) that go down them.
_DOWN = "leaf long, salt int, kind int, vec_id long, vector array<double>, ranks array<int>, tree binary"


def _first_batches(shared, dim: int, scale: float, most: int | None):
    """most: None for rows, which go to one leaf; else how many leaves a query takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _gone_down(shared.value, 0, batch, dim, scale, most)

    return run


def _gone_down(tree: Tree, parent: int, batch: pa.RecordBatch, dim: int, scale: float, most: int | None) -> pa.RecordBatch:
    x = _seen(_matrix(batch.column("vector"), dim), scale)
    found = [[int(a)] for a in tree.assign(x)] if most is None else tree.visit(x, most)
    sizes = [len(f) for f in found]
    at = pa.array(np.repeat(np.arange(len(found)), sizes))
    ranks = batch.column("ranks").to_pylist() if "ranks" in batch.schema.names else [[]] * len(found)
    leaf = pa.array([(parent << LEAF_BITS) + leaf for f in found for leaf in f], pa.int64())
    rank = pa.array([[*ranks[i], place] for i, f in enumerate(found) for place in range(len(f))], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([leaf, batch.column("vec_id").take(at), batch.column("vector").take(at), rank], ["leaf", "vec_id", "vector", "ranks"])


_PLACED = "leaf long, vec_id long, vector array<double>, ranks array<int>"


def _sub_batches(dim: int, scale: float, most: int | None):
    """Rows come by leaf and salt, the leaf's tree first; where there is none, a row stays where it is (as leaf 0 below it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            leaves, kinds = batch.column("leaf").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(leaves) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(leaves)], strict=True):
                if kinds[a] == 0:
                    at, tree = leaves[a], pickle.loads(batch.column("tree")[int(a)].as_py())
                    continue
                one = tree if at == leaves[a] else Tree(np.zeros((1, dim)), [[]], [0], 1)
                yield _gone_down(one, int(leaves[a]), batch.slice(a, b - a), dim, scale, most)

    return run


def _fit_batches(dim: int, scale: float, leaf_sample: int):
    """Sampled rows come by leaf; each leaf gives a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(leaf: int, held: list[np.ndarray]) -> pa.RecordBatch:
            x = np.unique(_seen(np.concatenate(held), scale), axis=0)
            return pa.RecordBatch.from_arrays([pa.array([leaf]), pa.array([pickle.dumps(Tree.fit(x, leaf_sample))], pa.binary())], ["leaf", "tree"])

        at, held = None, []
        for batch in batches:
            leaves, x = batch.column("leaf").to_numpy(), _matrix(batch.column("vector"), dim)
            cuts = np.flatnonzero(np.diff(leaves)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(leaves)], strict=True):
                if leaves[a] != at and held:
                    yield out(at, held)
                    held = []
                at = int(leaves[a])
                held.append(x[a:b])
        if held:
            yield out(at, held)

    return run


def _pack_batches(dim: int, scale: float, fine: int):
    """Rows come by leaf and part; each part is packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(place: tuple[int, int], held: list) -> pa.RecordBatch:
            part = Part(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), scale, fine)
            return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]], pa.int32()), pa.array([pickle.dumps(part)], pa.binary())], ["leaf", "part", "pack"])

        at, held = None, []
        for batch in batches:
            leaves, parts = batch.column("leaf").to_numpy(), batch.column("part").to_numpy()
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"), dim)
            cuts = np.flatnonzero((np.diff(leaves) != 0) | (np.diff(parts) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(leaves)], strict=True):
                place = (int(leaves[a]), int(parts[a]))
                if place != at and held:
                    yield out(at, held)
                    held = []
                at = place
                held.append((ids[a:b], x[a:b]))
        if held:
            yield out(at, held)

    return run


def _answer(k: int, dim: int, bins: int):
    """Packs (kind 0) come before the queries of their leaf and part."""
    names = ["query_id", "vec_id", "score", "ranks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, part = None, None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("leaf", "part", "kind")], 1)
            cuts = np.flatnonzero((np.diff(where, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(where)], strict=True):
                if a == b:
                    continue
                mine = tuple(where[a, :2])
                if where[a, 2] == 0:
                    place, part = mine, pickle.loads(batch.column("pack")[int(a)].as_py()).ready()
                    continue
                if mine != place:
                    continue
                for c in range(a, b, TOGETHER):
                    some = batch.slice(c, min(TOGETHER, b - c))
                    q = _matrix(some.column("vector"), dim)
                    q_ids, ranks = some.column("vec_id").to_numpy(), some.column("ranks").to_pylist()
                    found = [part.nearest(int(i), v, taken, k) for i, v, taken in zip(q_ids, q, part.tree.visit(_seen(q, part.scale), bins), strict=True)]
                    sizes = [len(f[0]) for f in found]
                    if not sum(sizes):
                        continue
                    rows = np.concatenate([f[0] for f in found])
                    ranked = [[*ranks[i], int(r)] for i, f in enumerate(found) for r in f[2]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(part.ids[rows]), pa.array(np.concatenate([f[1] for f in found])), pa.array(ranked, pa.list_(pa.int32()))], names)

    return run


def _down(rows: DataFrame, subtrees: DataFrame, dim: int, scale: float, most: int | None, salts: int = 1) -> DataFrame:
    """One level further down; a leaf's rows are dealt to ``salts`` tasks."""
    trees = subtrees.select("leaf", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("array<int>").alias("ranks"), "tree")
    own = rows.select("leaf", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "vec_id", "vector", "ranks", F.lit(None).cast("binary").alias("tree"))
    met = trees.unionByName(own).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind")
    return met.mapInArrow(tidy(_sub_batches(dim, scale, most)), _PLACED)


def _drawn(n: int | F.Column, sample: int) -> F.Column:
    draw = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 40))
    return draw < (F.lit(float(sample << 40)) / F.lit(n) if isinstance(n, int) else F.lit(float(sample << 40)) / n)


def build(vectors: DataFrame, k: int = K, sample: int = SAMPLE, calibration: int = CALIBRATION, recall: float = RECALL, part: int = PART, split: int = SPLIT) -> Index | None:
    """The index over all valid rows; None if there are none."""
    spark = vectors.sparkSession
    rows = saved(valid(vectors), "vectors")
    # as many rows as there are different lengths; ties to the smaller length
    middle = F.percentile_approx(F.array_max(F.transform("vector", F.abs)), 0.5)
    first = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("count"), middle.alias("middle")).orderBy(F.desc("count"), "dim").first()
    if first is None:
        return None
    dim, n = first["dim"], first["count"]
    scale = float(2.0 ** -np.clip(np.floor(np.log2(first["middle"])), -1000, 1000))
    rows = rows.filter(F.size("vector") == dim)
    drawn = (rows if n <= sample else rows.filter(_drawn(n, sample))).select("vec_id", "vector")
    # those with the least digests are kept for calibration, the others are fitted
    drawn = drawn.withColumn("draw", F.xxhash64(F.lit(SEED + 1), "vec_id")).toPandas().sort_values(["draw", "vec_id"], kind="stable")
    if drawn.empty:
        drawn = rows.limit(sample).toPandas()
    ids = drawn["vec_id"].to_numpy(np.int64)
    x = np.array(drawn["vector"].tolist(), np.float64).reshape(-1, dim)
    kept = min(calibration, max(1, len(ids) // 4))
    fitted = np.unique(_seen(x[kept:] if len(ids) > kept else x, scale), axis=0)
    # a leaf of the first level holds about half a part's rows, as far as the sample tells leaves apart
    tree = Tree.fit(fitted, max(LEAF_SAMPLE, int(len(fitted) * part / 2 / n)))

    shared = spark.sparkContext.broadcast(tree)
    placed = saved(rows.mapInArrow(tidy(_first_batches(shared, dim, scale, None)), _PLACED), "ann-leaves")
    subtrees: list[DataFrame] = []
    for _ in range(LEVELS - 1):
        large = placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > split)
        large = saved(large, "ann-large")
        if not large.count():
            break
        few = placed.join(large, "leaf").filter(_drawn(F.col("n"), sample)).select("leaf", "vector")
        trees = few.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(tidy(_fit_batches(dim, scale, LEAF_SAMPLE)), "leaf long, tree binary")
        trees = saved(trees, "ann-subtrees")
        below = saved(_down(placed, trees, dim, scale, None, salts=8), "ann-leaves")
        apart = below.select("leaf").distinct().count() > placed.select("leaf").distinct().count()
        if not apart:
            break
        placed = below
        subtrees.append(trees)

    counts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    counts = saved(counts, "ann-counts")
    own = placed.join(counts, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "vec_id", "vector")
    packs = own.repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(tidy(_pack_batches(dim, scale, FINE)), "leaf long, part int, pack binary")
    everywhere = [1 << LEAF_BITS] * (len(subtrees) + 2)
    index = Index(rows, tree, subtrees, saved(packs, "ann-parts"), counts, everywhere, 1.0, dim, scale)

    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids[:kept], x[:kept], strict=True)], "vec_id long, vector array<double>")
    ranks = _ranked(index, asked, k).select("ranks").toPandas()["ranks"]
    if len(ranks):
        index.visits, index.recall = widened(np.array(ranks.tolist()), recall)
    return index


def widened(ranks: np.ndarray, recall: float) -> tuple[list[int], float]:
    """The visits at each level that reach so many of the neighbours. ranks: for each neighbour the places of what holds it."""
    for share in np.r_[np.arange(0.5, 1.0, 0.005), 1.0]:
        visits = [int(np.quantile(r, share, method="higher")) + 1 for r in ranks.T]
        reached = float((ranks < visits).all(axis=1).mean())
        if reached >= recall:
            break
    return visits, reached


def _ranked(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, ranks (the places at which the search came to the row)."""
    q = queries.filter(F.size("vector") == index.dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    tree = queries.sparkSession.sparkContext.broadcast(index.tree)
    asked = q.mapInArrow(tidy(_first_batches(tree, index.dim, index.scale, index.visits[0])), _PLACED)
    for subtrees, most in zip(index.subtrees, index.visits[1:-1], strict=True):
        asked = _down(asked, subtrees, index.dim, index.scale, most)
    asked = asked.join(index.counts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "vec_id", "vector", "ranks", F.lit(None).cast("binary").alias("pack"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("vec_id", "long"), ("vector", "array<double>"), ("ranks", "array<int>"))]
    packs = index.parts.select("leaf", "part", F.lit(0).alias("kind"), *none, "pack")
    both = packs.unionByName(asked).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind")
    found = both.mapInArrow(tidy(_answer(k, index.dim, index.visits[-1])), "query_id long, vec_id long, score double, ranks array<int>")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """queries: vec_id, vector -> query_id, rank, vec_id, score."""
    return _ranked(index, queries, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 100, k: int = K, recall: float = RECALL) -> DataFrame:
    """The k nearest rows for each row whose vec_id is divisible by ``every``."""
    index = build(vectors, k=k, recall=recall)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.rows.filter(F.col("vec_id") % every == 0).select("vec_id", "vector"), k)
