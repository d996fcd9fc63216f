"""Cells whose rows must meet in pairs, cut into parts where they are large.

A cell is all rows with one key. Where it has more than ``limit`` rows it is cut
into parts by a digest of the member, and each pair of parts is a cell of its own,
so a task never has to hold or compare more than about ``limit`` rows of a cell,
however large the corpus. Large cells are looked for among the sums of ``SHARES``
groups of cells first, which are combined before they move; only where a sum is
above the limit are single cells counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.base import saved

SHARES = 1 << 14
#: A table of so many large cells goes to all tasks; a larger one is joined by a shuffle.
FEW_CELLS = 100_000
#: Bits of ``w``: two for the side, and so many for each part.
PART_BITS = 20
PLACE_BITS = 2 * PART_BITS + 2


def large_cells(cells: DataFrame, by: list[str], limit: int) -> DataFrame | None:
    """``by`` and parts for each cell above the limit; None if there are none."""
    share = F.pmod(F.xxhash64(*by), F.lit(SHARES))
    # at most SHARES rows, whatever the number of cells
    full = [r["share"] for r in cells.groupBy(share.alias("share")).count().filter(F.col("count") > limit).collect()]
    if not full:
        return None
    counts = cells.filter(share.isin(full)).groupBy(*by).count().filter(F.col("count") > limit)
    large = saved(counts.select(*by, F.ceil(F.col("count") * 2 / limit).cast("int").alias("parts")), "large-cells")
    n = large.count()
    return None if not n else F.broadcast(large) if n <= FEW_CELLS else large


def divided(cells: DataFrame, by: list[str], member: str, limit: int) -> DataFrame:
    """``cells`` with w: the pair of parts, and in the last two bits the row's side of it.

    Sides 0 and 1 meet each other only; rows of side 2 (a whole part or cell) meet all others.
    """
    large = large_cells(cells, by, limit)
    if large is None:
        return cells.withColumn("w", F.lit(2).cast("long"))
    parts = F.coalesce("parts", F.lit(1))
    both = cells.join(large, by, "left").withColumn("_mine", F.pmod(F.xxhash64(member), parts).cast("int"))
    both = both.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    i, j = F.least("_mine", "_other").cast("long"), F.greatest("_mine", "_other").cast("long")
    side = F.when(i == j, 2).when(F.col("_mine") == j, 1).otherwise(0)
    return both.withColumn("w", F.shiftleft(F.shiftleft(i, PART_BITS) + j, 2) + side).drop("_mine", "_other", "parts")
