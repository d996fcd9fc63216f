"""Mixing sources to target weights: capped water-filling and seeded repetition.

Every source asks for a share of the words of the mix by its weight. A source
stops at ``max_epochs`` times its own size; what it cannot supply is shared
again by weight among the rest until no source is above its limit. That fixed
point is a water level: with sources sorted by limit/weight, the level at a
source is (wanted - limits before it) / (weights from it on). The level rises
while sources are full and falls afterwards, so the final level is the largest,
and a source gets ``least(limit, level * weight)``: one window over the table of
sources, no iteration.

A target of e epochs becomes floor(e) whole repetitions of every document and a
fraction for which documents are drawn without replacement, in the order of a
seeded digest, up to the point where the next one would take the source further
from its target. Running sums go over 4096 digest ranges for each source first, so
only the one range in which a source's draw ends has to be looked at in order. Its
rows are sorted over all tasks, with running sums of the tasks before the rows'
own; so no source is gathered in a task, however large, and neither are rows that
share a doc_id, or have none, and so a digest.

Documents do not move to be mixed: the ranges, which say what their documents
need, go to all tasks up to ``FEW_RANGES`` of them (beyond, both meet by a
shuffle), and only rows of the ranges where draws end are sorted.

Defined results: a null text has size 0; null is a source of its own, after all
others; documents of size 0 are never taken; rows that repeat are documents of
their own and those that agree in doc_id and size are interchangeable in ``mix``
(``repeated`` takes them by a digest of the text); very long texts are counted
whole; an empty table gives an empty result; other columns are ignored, and
``repeated`` hands them on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.base import quoted, same, saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
#: A table of so many ranges goes to all tasks.
FEW_RANGES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def sized_documents(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size in words, and the digest that orders the draw."""
    doc_id = F.col(quoted(id_col))
    return docs.select(doc_id.alias("doc_id"), F.col(quoted(source_col)).alias("source"), size_of(F.col(quoted(text_col))).alias("size"), draw_of(doc_id, seed).alias("draw"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> source, source_size, target, whole, goal.

    One row for each source goes through one window: the table of sources, not
    of documents. whole: full repetitions; goal: words that the draw adds.
    """
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(max_epochs))
    filling = Window.partitionBy().orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(everything) * F.lit(total_share)
    level = (wanted - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = named.withColumn("level", level).withColumn("target", F.least(F.col("limit"), F.max("level").over(everything) * F.col("weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return filled.withColumn("whole", whole).select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("goal"))


def _range() -> Column:
    return F.substring("draw", 1, 3)


def draw_ranges(sized: DataFrame, weights, total_share: float, max_epochs: float) -> DataFrame:
    """For each source and range: source_size, target, whole, goal, before (words of the ranges before), drawn (all of the range is), last (the draw ends here)."""
    sums = saved(sized.groupBy("source", _range().alias("range")).agg(F.sum("size").alias("words")), "mix-ranges")
    targets = saved(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_share, max_epochs), "mix-targets")
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cumulated = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    c, t = cumulated.alias("c"), targets.alias("t")
    end, goal = F.col("before") + F.col("words"), F.col("goal")
    ranges = c.join(t, same(F.col("c.source"), F.col("t.source"))).select(F.col("c.source").alias("_source"), F.col("range").alias("_range"), "source_size", "target", "whole", "goal", "before", (end <= goal).alias("drawn"), ((F.col("before") <= goal) & (end > goal)).alias("last"))
    return saved(ranges, "mix-drawn")


def _met(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (source, draw) with the columns of their ranges."""
    side = F.broadcast(ranges) if ranges.count() <= FEW_RANGES else ranges
    return rows.join(side, same(F.col("source"), F.col("_source")) & (_range() == F.col("_range"))).drop("_source", "_range")


def _drawn_at_the_end(rows: DataFrame, *order: str) -> DataFrame:
    """drawn for the rows of ranges in which draws end, in the order of draw, size and ``order``."""
    order = ("draw", "size", *order)
    # rows alike in all else are told apart, so that any number of them can be dealt to several tasks
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = saved(rows.repartitionByRange("source", *order, "_row").withColumn("_part", F.spark_partition_id()), "mix-last")
    parts = placed.groupBy(F.col("source").alias("_source"), F.col("_part").alias("_at")).agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("_source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_words").over(running), F.lit(0)))
    met = placed.join(parts, same(F.col("source"), F.col("_source")) & (F.col("_part") == F.col("_at")))
    own = Window.partitionBy("source", "_part").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.col("_ahead") + F.coalesce(F.sum("size").over(own), F.lit(0))
    return met.withColumn("drawn", so_far + F.col("size") / F.lit(2.0) <= F.col("goal")).drop("_row", "_part", "_source", "_at", "_words", "_ahead")


def mix(sized: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The rows of ``sized_documents`` with source_size, target and repetitions.

    ``sized`` should be a written table (it is read several times).
    """
    joined = _met(sized, draw_ranges(sized, weights, total_share, max_epochs))
    both = joined.filter(~F.col("last")).unionByName(_drawn_at_the_end(joined.filter("last")))
    repeats = F.when(F.col("size") > 0, F.col("whole") + F.col("drawn").cast("long")).otherwise(F.lit(0)).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"))


def repeated(docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (a written table) with each row as often as the mix takes it (not at all, once or more).

    Every row is taken as its own place in the draw says, also of rows that share a doc_id.
    """
    ranges = draw_ranges(sized_documents(docs, seed), weights, total_share, max_epochs)
    row = F.struct(*[F.col(quoted(c)).alias(f"r{i}") for i, c in enumerate(docs.columns)]).alias("row")
    text = F.col("text").cast("string")
    joined = _met(docs.select(row, text.alias("text"), F.col("source"), draw_of(F.col("doc_id"), seed).alias("draw")), ranges)
    last = joined.filter("last").withColumn("size", size_of(text)).withColumn("digest", F.xxhash64("text"))
    last = _drawn_at_the_end(last.drop("text"), "digest")
    rest = joined.filter(~F.col("last")).select("row", "whole", "drawn", F.coalesce(text.rlike(WORD), F.lit(False)).alias("some"))
    both = rest.unionByName(last.select("row", "whole", "drawn", (F.col("size") > 0).alias("some")))
    times = F.when(F.col("some"), F.col("whole") + F.col("drawn").cast("long")).otherwise(F.lit(0)).cast("int")
    again = both.select("row", times.alias("times")).filter("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    return again.select(*[F.col(f"row.r{i}").alias(c) for i, c in enumerate(docs.columns)])
