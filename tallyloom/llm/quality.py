"""Quality classifier: Naive Bayes support vectors over byte n-grams.

A text's features are the indicators of its byte 1- to 3-grams, hashed into
2**``BITS`` places. Each indicator is scaled by the log-count ratio of its place:
the smoothed share of documents of class 1 against that of class 0 that have it.
On the scaled vectors (of unit length, so long texts weigh like short ones) a
linear model with the hinge loss is fitted by dual coordinate descent, and a
logistic curve through the margins of labelled rows that the fit has not seen
turns margins into scores.

``SAMPLE`` bounds the labelled documents that the model is fitted on: all if there
are fewer, else about so many drawn by a digest of the doc_id. Each is one text,
however many rows have its doc_id (the text of the smallest digest). Only they are
gathered (as sets of places) and only in one task. The model is two arrays of
2**BITS numbers; every text of the corpus is scored by it, whole.

The split: rows whose crc32(doc_id as text) mod 5 is 0 are held out and never
learnt from. The label is never an input of a score, nor are language, source
and doc_id.

Defined results: null and empty texts have no features and get the score of the
model's offset; a null doc_id has no label and is not held out; null labels are
ignored, of several labels for a doc_id the largest counts; very long texts are
read whole, in pieces; equal margins are equal scores; without labels of
both classes every score is the smoothed share of class 1; rows that repeat are
scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyloom.llm.base import saved, sliced, tidy

BITS, ORDERS = 18, (1, 2, 3)
#: The n-grams of 2 to REPEATS + 1 equal words, whatever the word, have places of their own.
REPEATS = 3
SAMPLE, FOLDS, SEED = 20_000, 5, 7
COST, EPOCHS, SMOOTHING = 1.0, 12, 1.0
THRESHOLD = 0.3
PIECE = 1 << 20


def places(text: bytes | None, mask: np.ndarray) -> np.ndarray:
    """The sorted distinct places of a text's n-grams. mask: all False, of 2**BITS; left so."""
    data = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE + max(ORDERS) - 1]
        code = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(part) < n:
                break
            code = (code[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            if n in ORDERS:
                mask[((code + np.uint32(n << 24)) * np.uint32(2654435769)) >> np.uint32(32 - BITS)] = True
    words = (text or b"").split()
    again = [a == b for a, b in zip(words, words[1:], strict=False)]
    for n in range(1, REPEATS + 1):
        if not any(again):
            break
        mask[n] = True
        again = [a and b for a, b in zip(again, again[1:], strict=False)]
    found = np.flatnonzero(mask)
    mask[found] = False
    return found.astype(np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = weights . scaled + offset."""

    ratio: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        if not len(at):
            return self.offset
        x = self.ratio[at]
        norm = float(np.sqrt((x * x).sum()))
        return (float(self.weights[at] @ x) / norm if norm else 0.0) + self.offset

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for at, y in zip(rows, labels, strict=True):
        counts[y, at] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], vector: Callable[[int], np.ndarray], labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + cost * sum_i max(0, 1 - y_i (w . x_i + b)): one dual variable after another.

    rows: the places of each x_i; vector(i): its values there, made when they are needed,
    as all at once would be several times the sample. The offset is the weight of a
    feature that is always 1.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    weights, offset = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    length = np.array([float(v @ v) + 1.0 for v in map(vector, range(len(rows)))])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        changed = 0.0
        for i in rng.permutation(len(rows)):
            values = vector(i)
            gradient = y[i] * (float(weights[rows[i]] @ values) + offset) - 1.0
            new = min(max(alpha[i] - gradient / length[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                weights[rows[i]] += step * values
                offset += step
                changed = max(changed, abs(step))
        if changed < 1e-3:
            break
    return weights, offset


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with a small pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - labels) * margins).sum() + 0.1 * (a - 1), (p - labels).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margins * margins).sum() + 0.1, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: places of each text, in a fixed order; labels: 0 or 1."""
    n, ones = len(labels), int(labels.sum())
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold = np.arange(n) % FOLDS

    def one(train: np.ndarray) -> Model:
        mine = [rows[i] for i in train]
        ratio = log_count_ratios(mine, labels[train])
        norms = [float(np.sqrt((ratio[at] ** 2).sum())) or 1.0 for at in mine]
        weights, offset = dual_coordinate_descent(mine, lambda i: ratio[mine[i]] / norms[i], labels[train])
        return Model(ratio, weights, offset, 1.0, 0.0)

    seen, unseen = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    if len(set(labels[seen])) < 2:
        seen = unseen = np.arange(n)
    part = one(seen)
    slope, shift = logistic_curve(np.array([part.margin(rows[i]) for i in unseen]), labels[unseen])
    whole = one(np.arange(n))
    return Model(whole.ratio, whole.weights, whole.offset, slope, shift)


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task hands on each document once; there are no more than the sample has."""
    mask, seen = np.zeros(1 << BITS, bool), set()
    for batch in sliced(batches):
        fresh = [i for i, d in enumerate(batch.column("doc_id").to_pylist()) if not (d in seen or seen.add(d))]
        part = batch.take(pa.array(fresh, pa.int64()))
        found = [places(t, mask) for t in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "places"])


def _fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        lists = batch.column("places")
        for i, (d, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            if d not in held:
                held[d] = (y, lists[i].values.to_numpy())
    # neighbours in doc_id go to different folds whatever their label
    found = [held[d] for d in sorted(held)]
    model = fit([r[1] for r in found], np.array([r[0] for r in found], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([model.ratio.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), *[pa.array([x]) for x in (model.offset, model.slope, model.shift)], pa.array([len(found)])], ["ratio", "weights", "offset", "slope", "shift", "rows"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1). Learns from rows that are not held out."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = saved(own.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), "quality-labels")
    n = own.count()
    if n > sample:
        own = own.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # about ``sample`` rows of two numbers at most, so they go to all tasks
    texts = docs.select("doc_id", F.col("text").cast("string"))
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    # however often a document repeats, it is learnt from once: of several texts, the one of the smallest digest
    one = texts.join(F.broadcast(own), "doc_id").groupBy("doc_id", "label").agg(F.min(digest).alias("digest"))
    one = saved(one, "quality-texts")
    rows = texts.join(F.broadcast(one), "doc_id").filter(digest == F.col("digest")).select(F.col("doc_id").cast("long"), "label", "text")
    placed = saved(rows.mapInArrow(tidy(_place_batches), "doc_id long, label int, places array<int>"), "quality-places")
    row = placed.coalesce(1).mapInArrow(tidy(_fit_all), "ratio binary, weights binary, offset double, slope double, shift double, rows long").first()
    if row is None:
        return fit([], np.zeros(0, np.int64))
    return Model(np.frombuffer(bytes(row["ratio"])), np.frombuffer(bytes(row["weights"])), row["offset"], row["slope"], row["shift"])


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        mask = np.zeros(1 << BITS, bool)
        for batch in sliced(batches):
            margins = np.array([model.margin(places(t, mask)) for t in batch.column("text").cast(pa.binary()).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(margins))], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: any columns but score, with text -> the same and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(tidy(_score_batches(shared)), schema)
