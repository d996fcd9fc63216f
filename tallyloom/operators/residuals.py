"""Pearson residuals of the depth-adjusted model: values, moments, histogram, sample, density.

Pairs of cells and genes are never moved or stored. Only the stored entries are: they go to their cell
or gene in order, each with the gap of empty pairs up to the next, and tasks write the pairs out.
"""

from __future__ import annotations

from math import ceil, exp

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.guarded import whole
from tallyloom.operators.depth import cell_stats
from tallyloom.operators.dispersion import fit_dispersion
from tallyloom.operators.dropout import SMALL_GENES, depths, few_genes
from tallyloom.sources.matrix import CountMatrix

#: The least denominator, and the number of sampled pairs.
LEAST, SAMPLED = 1e-12, 5e6
LOW, HIGH, BINS = -5.0, 5.0, 99
SHOWN = 10.0

#: A gap is written out in stretches of so many pairs; a task has about so many pairs in all.
STRETCH, TASK_PAIRS = 4096, 50_000_000


def _over(x: Column, mu: Column, denominator: Column) -> Column:
    return F.when(denominator < LEAST, 0.0).otherwise((x - mu) / denominator)


def approx_residual(x: Column, mu: Column) -> Column:
    return _over(x, mu, F.sqrt(mu))


def full_residual(x: Column, mu: Column, size: Column) -> Column:
    return _over(x, mu, F.sqrt(mu + mu * mu / size))


def _with_mu(df: DataFrame, cells: DataFrame) -> DataFrame:
    total = cells.agg(F.sum("ti").alias("total"))
    mu = F.when(F.col("total") > 0, F.col("tj") * F.col("ti") / F.col("total")).otherwise(0.0)
    return df.crossJoin(F.broadcast(total)).withColumn("mu", mu)


def _stored(matrix: CountMatrix) -> DataFrame:
    return matrix.counts.select("cell_id", "gene_id", whole(F.col("x")).alias("x"))


def _tasks(spark: SparkSession, pairs: int) -> int:
    return max(spark.sparkContext.defaultParallelism, min(ceil(pairs / TASK_PAIRS), 20_000))


def _placed(side: DataFrame, key: str) -> DataFrame:
    """``side`` with _at, a row's place in the order of its key (from 0)."""
    return side.withColumn("_at", F.row_number().over(Window.partitionBy().orderBy(key)) - 1)


def _gaps(stored: DataFrame, rows: DataFrame, row: str, columns: int, tasks: int) -> DataFrame:
    """The entries of each row by place with _next, the place of the next one; one at -1 opens each row.

    stored: row, _at, x; rows: row and other columns; columns: how many places there are.
    """
    opened = rows.select(row, F.lit(-1).alias("_at"), F.lit(0.0).alias("x"))
    entries = stored.select(row, "_at", "x").unionByName(opened).repartition(tasks, row)
    following = F.lead("_at", 1, columns).over(Window.partitionBy(row).orderBy("_at"))
    return entries.join(rows.repartition(tasks, row).hint("shuffle_hash"), row).withColumn("_next", following)


def _dense(matrix: CountMatrix, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """cells and genes in all pairs, with x. The shorter side goes to all tasks, by place."""
    nc, ng = cells.count(), genes.count()
    row, column, rows, columns, n = ("gene_id", "cell_id", genes, cells, nc) if nc < ng else ("cell_id", "gene_id", cells, genes, ng)
    placed = F.broadcast(_placed(columns, column))
    stored = _stored(matrix).join(placed.select(column, "_at"), column)
    runs = _gaps(stored, rows, row, n, _tasks(matrix.counts.sparkSession, nc * ng))
    first, last = F.greatest("_own", F.lit(0)), F.greatest("_own", F.col("_next") - 1)
    runs = runs.withColumnRenamed("_at", "_own").withColumn("_last", last).filter("_last >= 0").withColumn("_from", F.explode(F.sequence(first, last, F.lit(STRETCH))))
    pairs = runs.withColumn("_at", F.explode(F.sequence("_from", F.least(F.col("_from") + (STRETCH - 1), F.col("_last")))))
    pairs = pairs.withColumn("x", F.when(F.col("_at") == F.col("_own"), F.col("x")).otherwise(0.0))
    return pairs.join(placed, "_at").select(*cells.columns, *genes.columns, "x")


def pearson_residuals(matrix: CountMatrix, fit: DataFrame | None = None) -> DataFrame:
    """cell_id, gene_id, x, approx, full for every cell and kept gene, with x = 0 where nothing is stored.

    As large as cells times genes by its nature, but only entries are shuffled. ``stored_residuals``,
    ``residual_moments``, ``histogram`` and ``drawn_residuals`` do without the empty pairs.
    """
    fit = fit_dispersion(matrix) if fit is None else fit
    cells = cell_stats(matrix).select("cell_id", "ti")
    return _residuals(_dense(matrix, cells, fit.select("gene_id", "tj", "size")), cells)


def dense_residuals(matrix: CountMatrix, value: str, fit: DataFrame | None = None) -> DataFrame:
    """cell_id, values: x, approx or full of all kept genes in the order of gene_id, an array for each cell.

    The same as ``dense_rows`` of ``pearson_residuals``; arrays are filled up in place, and pairs never move.
    """
    fit = fit_dispersion(matrix) if fit is None else fit
    cells = cell_stats(matrix).select("cell_id", "ti")
    genes = _placed(fit.select("gene_id", "tj", "size"), "gene_id")
    nc, ng = cells.count(), fit.count()
    if not ng:
        return cells.filter(F.lit(False)).select("cell_id", F.array().cast("array<double>").alias("values"))
    runs = _gaps(_stored(matrix).join(genes.select("gene_id", "_at"), "gene_id"), cells, "cell_id", ng, _tasks(matrix.counts.sparkSession, nc * ng))
    by_cell = runs.groupBy("cell_id", "ti").agg(F.array_sort(F.collect_list(F.struct("_at", "_next", "x"))).alias("_runs"))

    def filled(r: Column) -> Column:
        zeros = F.array_repeat(F.lit(0.0), r["_next"] - F.greatest(r["_at"], F.lit(-1)) - 1)
        return F.when(r["_at"] < 0, zeros).otherwise(F.concat(F.array(r["x"]), zeros))

    rows = by_cell.select("cell_id", "ti", F.flatten(F.transform("_runs", filled)).alias("values"))
    if value == "x":
        return rows.select("cell_id", "values")
    every = genes.agg(F.array_sort(F.collect_list(F.struct("_at", "tj", "size"))).alias("_genes"))
    total = cells.agg(F.sum("ti").alias("total"))

    def residual(x: Column, g: Column) -> Column:
        mu = F.when(F.col("total") > 0, g["tj"] * F.col("ti") / F.col("total")).otherwise(0.0)
        return approx_residual(x, mu) if value == "approx" else full_residual(x, mu, g["size"])

    return rows.crossJoin(F.broadcast(every.crossJoin(total))).select("cell_id", F.zip_with("values", "_genes", residual).alias("values"))


def stored_residuals(matrix: CountMatrix, fit: DataFrame | None = None) -> DataFrame:
    """The same rows for stored entries only; an absent pair has -mu over the denominator."""
    fit = fit_dispersion(matrix) if fit is None else fit
    cells = cell_stats(matrix).select("cell_id", "ti")
    return _residuals(_stored(matrix).join(fit.select("gene_id", "tj", "size"), "gene_id").join(cells, "cell_id"), cells)


def _residuals(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    mu = F.col("mu")
    return _with_mu(pairs, cells).select("cell_id", "gene_id", "x", approx_residual(F.col("x"), mu).alias("approx"), full_residual(F.col("x"), mu, F.col("size")).alias("full"))


def residual_moments(matrix: CountMatrix, fit: DataFrame | None = None) -> DataFrame:
    """gene_id, mean_x, and mean and variance (over all cells) of both residuals, without dense rows.

    A residual is (x - mu) / d. Its sums over all cells are those with x = 0 everywhere, which depend on
    a cell's total only, plus what the stored entries add to them.
    """
    fit = fit_dispersion(matrix) if fit is None else fit
    genes = fit.select("gene_id", "tj", "size")
    cells = cell_stats(matrix).select("cell_id", "ti")
    mu, x, size = F.col("mu"), F.col("x"), F.col("size")
    both = {"approx": F.sqrt(mu), "full": F.sqrt(mu + mu * mu / size)}

    few = few_genes(matrix)
    spread = depths(cells)
    if few:
        spread = spread.repartition(spread.sparkSession.sparkContext.defaultParallelism)
    empty = _with_mu(spread.crossJoin(F.broadcast(genes) if few else genes), cells)
    aggs = [F.sum("cells").alias("nc")]
    for name, d in both.items():
        r = F.when(d < LEAST, 0.0).otherwise(-mu / d)
        aggs += [F.sum(F.col("cells") * r).alias(f"{name}_1"), F.sum(F.col("cells") * r * r).alias(f"{name}_2")]
    empty = empty.groupBy("gene_id").agg(*aggs)

    stored = _stored(matrix).join(genes, "gene_id").join(cells, "cell_id")
    aggs = [F.sum("x").alias("sx")]
    for name, d in both.items():
        aggs += [F.sum(F.when(d < LEAST, 0.0).otherwise(x / d)).alias(f"{name}_s1"), F.sum(F.when(d < LEAST, 0.0).otherwise((x * x - F.lit(2.0) * x * mu) / (d * d))).alias(f"{name}_s2")]
    stored = _with_mu(stored, cells).groupBy("gene_id").agg(*aggs)

    out = empty.join(stored, "gene_id")
    columns = [F.col("gene_id"), (F.col("sx") / F.col("nc")).alias("mean_x")]
    for name in both:
        mean = (F.col(f"{name}_1") + F.col(f"{name}_s1")) / F.col("nc")
        columns += [mean.alias(f"{name}_mean"), ((F.col(f"{name}_2") + F.col(f"{name}_s2")) / F.col("nc") - mean * mean).alias(f"{name}_var")]
    return out.select(*columns)


def histogram(matrix: CountMatrix, value: str, fit: DataFrame | None = None, low: float = LOW, high: float = HIGH, bins: int = BINS) -> DataFrame:
    """``residual_histogram`` of ``value`` (approx or full) over all pairs, without making them.

    An empty pair's residual depends on the totals of its cell and gene (and, if full, on the gene's size),
    so pairs of different totals are counted; of these the stored entries are taken back and put where they belong.
    """
    fit = fit_dispersion(matrix) if fit is None else fit
    cells = cell_stats(matrix).select("cell_id", "ti")
    genes = fit.select("gene_id", "tj", "size")
    kinds = genes.select("tj", (F.lit(1.0) if value == "approx" else F.col("size")).alias("size")).groupBy("tj", "size").agg(F.count("*").alias("genes"))
    few = kinds.count() <= SMALL_GENES
    spread = depths(cells)
    if few:
        spread = spread.repartition(spread.sparkSession.sparkContext.defaultParallelism)
    empty = spread.crossJoin(F.broadcast(kinds) if few else kinds).select("ti", "tj", "size", F.lit(0.0).alias("x"), (F.col("cells") * F.col("genes")).alias("n"))
    stored = _stored(matrix).join(genes, "gene_id").join(cells, "cell_id")
    both = F.explode(F.array(F.struct("x", F.lit(1).cast("long").alias("n")), F.struct(F.lit(0.0).alias("x"), F.lit(-1).cast("long").alias("n"))))
    moved = stored.filter("x != 0").select("ti", "tj", "size", both.alias("_v")).select("ti", "tj", "size", "_v.x", "_v.n")
    x, mu = F.col("x"), F.col("mu")
    r = approx_residual(x, mu) if value == "approx" else full_residual(x, mu, F.col("size"))
    return residual_histogram(_with_mu(empty.unionByName(moved), cells).select(r.alias("_r"), "n"), "_r", low, high, bins, "n")


def residual_histogram(residuals: DataFrame, value: str, low: float = LOW, high: float = HIGH, bins: int = BINS, times: str | None = None) -> DataFrame:
    """bin (from 1), left, density of the values in [low, high]; the last bin is closed on the right. times: how often a row counts."""
    v = F.col(value)
    width = (high - low) / bins
    inside = residuals.filter((v >= low) & (v <= high))
    number = F.least(F.floor((v - low) / width).cast("int") + 1, F.lit(bins))
    counts = inside.groupBy(number.alias("bin")).agg((F.count("*") if times is None else F.sum(times)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    every = residuals.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").crossJoin(F.broadcast(total))
    density = F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / (F.col("total") * F.lit(width))).otherwise(0.0)
    return full.select("bin", (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("left"), density.alias("density"))


def sampling_rate(cells: int, genes: int, sampled: float = SAMPLED) -> float:
    return min(1.0, sampled / (cells * genes)) if cells and genes else 1.0


def poisson_steps(rate: float) -> list[float]:
    """P(draws <= 0), P(draws <= 1), ... of a pair that is drawn ``rate`` times on average, up to double precision."""
    steps, term, total = [], exp(-rate), 0.0
    while len(steps) < 64 and total + term < 1.0 - 2.0**-52:
        total += term
        steps.append(total)
        term *= rate / len(steps)
    return steps


def residual_sample(residuals: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Pairs drawn with replacement, both residuals of a pair together.

    A pair's number of draws follows from a digest of its ids and the seed, so the sample is
    the same however the rows are dealt to tasks.
    """
    drawn = residuals.withColumn("_hash", F.md5(_drawn_text(seed, F.col("cell_id"), F.col("gene_id"))))
    return _repeated(drawn, rate)


def _drawn_text(seed: int, cell: Column, gene: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), cell.cast("string"), gene.cast("string"))


def _least_hash(rate: float) -> str:
    """The digits from which on a digest draws its pair; a chance is a whole number of 2 ** -52, so digits tell exactly."""
    steps = poisson_steps(rate)
    return f"{ceil(steps[0] * 2.0**52):013x}" if steps else "g"


def _repeated(hashed: DataFrame, rate: float) -> DataFrame:
    """Rows by their draws, which follow from the leading 52 bits of _hash."""
    chance = F.conv(F.substring("_hash", 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    draws = sum([(F.col("_chance") >= step).cast("int") for step in poisson_steps(rate)], F.lit(0))
    drawn = hashed.filter(F.col("_hash") >= _least_hash(rate)).withColumn("_chance", chance).withColumn("_draws", draws)
    return drawn.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("_draws")))).drop("_draw", "_draws", "_chance", "_hash")


def drawn_residuals(matrix: CountMatrix, rate: float, seed: int = 0, fit: DataFrame | None = None) -> DataFrame:
    """``residual_sample`` of ``pearson_residuals``: pairs are drawn by their ids before anything is known of them.

    Every pair's digest is made, which takes the time of cells times genes; only drawn pairs move.
    """
    fit = fit_dispersion(matrix) if fit is None else fit
    cells = cell_stats(matrix).select("cell_id", "ti")
    genes = fit.select("gene_id", "tj", "size")
    nc, ng = cells.count(), genes.count()
    # each side's part of the text is made once for its rows
    cells_text = cells.withColumn("_c", F.concat(F.lit(f"{seed}:"), F.col("cell_id").cast("string"), F.lit(":")))
    genes_text = genes.withColumn("_g", F.col("gene_id").cast("string"))
    short, long = (cells_text, genes_text) if nc < ng else (genes_text, cells_text)
    pairs = long.repartition(_tasks(matrix.counts.sparkSession, nc * ng)).crossJoin(F.broadcast(short))
    drawn = pairs.withColumn("_hash", F.md5(F.concat("_c", "_g"))).filter(F.col("_hash") >= _least_hash(rate)).drop("_c", "_g")
    # the same rule on the stored entries leaves few of them
    stored = _stored(matrix).filter(F.md5(_drawn_text(seed, F.col("cell_id"), F.col("gene_id"))) >= _least_hash(rate))
    found = drawn.join(stored, ["cell_id", "gene_id"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    return _residuals(_repeated(found, rate).select("cell_id", "ti", "gene_id", "tj", "size", "x"), cells)


def shown(sample: DataFrame, most: float = SHOWN) -> DataFrame:
    """The pairs whose approximate residual is within the plot's range."""
    return sample.filter((F.col("approx") > -most) & (F.col("approx") < most))


def density(sample: DataFrame, value: str, points: int = 200, low: float = -SHOWN, high: float = SHOWN) -> DataFrame:
    """at, density: a Gaussian kernel estimate (Scott's width) on a grid, over values binned ten times finer."""
    v = F.col(value)
    fine = (high - low) / (points * 10)
    bins = sample.filter((v > low) & (v < high)).groupBy(F.floor((v - low) / fine).alias("b")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    whole_sample = bins.agg(F.sum("n").alias("total"), ((F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")) / F.greatest(F.sum("n") - 1, F.lit(1))).alias("var"))
    width = F.sqrt("var") * F.pow("total", -0.2)
    grid = sample.sparkSession.range(points).select((F.lit(low) + F.col("id") * F.lit((high - low) / (points - 1))).alias("at"))
    # both sides have fixed sizes: the grid and its fine bins
    met = bins.select("n", (F.col("s") / F.col("n")).alias("v")).crossJoin(F.broadcast(grid)).crossJoin(F.broadcast(whole_sample.withColumn("h", width)))
    kernel = F.when(F.col("h") > 0, F.exp(-F.pow((F.col("at") - F.col("v")) / F.col("h"), 2) / 2) / (F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))).otherwise(0.0)
    return met.groupBy("at").agg((F.sum(F.col("n") * kernel) / F.first("total")).alias("density")).orderBy("at")
