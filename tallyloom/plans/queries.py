"""The matrix queries, and the same results in plain SQL.

The SQL states the formulas over all pairs of cells and genes, without the
rewrites of the operators. It gives nulls where there is no trend, and so do the queries. Both sides round, as sums are taken in different orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.normal import normal_tail_sql
from tallyloom.operators import corrections, depth, diagnostics, dispersion, dropout, residuals
from tallyloom.operators.fitted import fitted
from tallyloom.plans import fixtures as fx
from tallyloom.sources.work import shared_path
from tallyloom.streaming.stats import streaming_gene_stats


def r(name: str, digits: int = 6, of: Column | None = None) -> Column:
    return (F.round(F.col(name) if of is None else of, digits) + F.lit(0.0)).alias(name)


def rounded(name: str, of: Column, digits: int = 6) -> Column:
    """``r`` for tables of all pairs, as SQL engines round; decimals, which ``F.round`` makes of every value, take most of such a query's time."""
    scale = 10.0**digits
    near = F.signum(of) * (F.floor(F.abs(of) * scale + 0.5) / F.lit(scale))
    return (F.when(F.abs(of) < 1e6, near).otherwise(F.round(of, digits)) + F.lit(0.0)).alias(name)


def rs(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _prelude(fixture) -> str:
    counts, cells = fx.SQL[fixture]
    return f"""
WITH raw AS ({counts}), cells AS ({cells}),
counts AS (SELECT cell_id, gene_id, x, ceil(x) AS c FROM raw),
cs AS (SELECT cell_id, coalesce(s, 0) AS ti, coalesce(n, 0) AS n FROM cells LEFT JOIN (SELECT cell_id, sum(c) AS s, count(*) AS n FROM counts GROUP BY 1) USING (cell_id)),
tot AS (SELECT sum(ti) AS total, sum(ti * ti) AS s2, count(*) AS nc FROM cs),
gs AS (SELECT gene_id, sum(c) AS tj, nc - count(*) AS dj, sum(c) / nc AS mean FROM counts, tot GROUP BY gene_id, nc),
dev AS (
  SELECT gene_id, tj, dj, mean, tj / total * (tj / total) * s2 AS square,
         xx - 2.0 * (tj / total) * xt + tj / total * (tj / total) * s2 AS dev, nc
  FROM gs JOIN (SELECT gene_id, sum(c * c) AS xx, sum(c * ti) AS xt FROM counts JOIN cs USING (cell_id) GROUP BY 1) USING (gene_id), tot
), fit AS (
  SELECT gene_id, tj, dj, mean, dev / (nc - 1) AS var_obs, CASE WHEN dev - tj > 1e-6 THEN CASE WHEN square / (dev - tj) <= 0 THEN 10000.0 ELSE square / (dev - tj) END ELSE 10000.0 END AS size FROM dev
)"""


def _trend(fit: str, name: str) -> str:
    return f""", {name}_good AS (
  SELECT ln(size) AS y, ln(mean) AS x, log2(mean) > 4 AS high, count(*) FILTER (WHERE log2(mean) > 4) OVER () AS hn FROM {fit} WHERE size > 0 AND size < 9999 AND mean > 1e-3
), {name} AS (
  SELECT regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope, count(*) AS n FROM {name}_good WHERE hn <= 2000 OR high
)"""


_BASIC = """, med AS (SELECT median(ti) AS m FROM cs WHERE ti > 0),
sf AS (SELECT cell_id, CASE WHEN ti > 0 THEN ti / m ELSE 1.0 END AS size_factor FROM cs, med),
norm AS (SELECT gene_id, round_even(x / size_factor, 0) AS y FROM counts JOIN sf USING (cell_id)),
bm AS (SELECT gene_id, sum(y) / nc AS m, sum(y * y) / nc - (sum(y) / nc) * (sum(y) / nc) AS v FROM norm, tot GROUP BY gene_id, nc),
braw AS (SELECT *, CASE WHEN v - m > 1e-6 THEN m * m / (v - m) ELSE 1000.0 END AS raw FROM bm),
bmax AS (SELECT CASE WHEN coalesce(max(raw), 0) = 0 THEN 1000.0 ELSE max(raw) * 10 END AS largest FROM braw WHERE raw < 1e6),
basic AS (SELECT gene_id, tj, dj, mean, v AS var_obs, greatest(CASE WHEN raw <= 0 THEN largest ELSE raw END, 1e-10) AS size FROM gs JOIN braw USING (gene_id), bmax)"""


def _p(size: str, ti: str = "ti") -> str:
    return f"pow(greatest(tj * {ti} / total / {size} + 1.0, 1e-12), -{size})"


_SMOOTH = ", sm AS (SELECT fit.*, exp(intercept + slope * ln(mean)) AS es FROM fit, tr)"
_PAIRS = ", pairs AS (SELECT cell_id, gene_id, " + _p("es") + " AS p FROM sm, cs, tot)"
_Z = """, sums AS (SELECT gene_id, sum(p) AS ps, sum(p * (1.0 - p)) AS pq FROM pairs GROUP BY 1),
zs AS (SELECT gene_id, dj / nc AS observed, ps / nc AS expected, dj / nc - ps / nc AS effect_size, sqrt(pq / (nc * nc) + (dj / nc) * (1.0 - dj / nc) / nc) AS err FROM sums JOIN fit USING (gene_id), (SELECT nc::DOUBLE AS nc FROM tot)),
zz AS (SELECT *, CASE WHEN err > 0 THEN effect_size / err WHEN effect_size > 0 THEN 'inf'::DOUBLE WHEN effect_size < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS z FROM zs)"""
_PQ = ", pv AS (SELECT *, " + normal_tail_sql("z") + """ AS p_value FROM zz),
rk AS (SELECT *, row_number() OVER (ORDER BY p_value, gene_id) AS rn, count(*) OVER () AS n FROM pv),
qv AS (SELECT *, least(1.0, min(p_value * n / rn) OVER (ORDER BY p_value DESC, gene_id DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM rk)"""


def _full(fixture) -> str:
    return _prelude(fixture) + _trend("fit", "tr") + _SMOOTH + _PAIRS + _Z + _PQ


_RES = ", res AS (SELECT cell_id, gene_id, coalesce(c, 0) AS x, tj * ti / total AS mu, size FROM cs CROSS JOIN fit CROSS JOIN tot LEFT JOIN counts USING (cell_id, gene_id)), rv AS (SELECT *, CASE WHEN sqrt(mu) < 1e-12 THEN 0.0 ELSE (x - mu) / sqrt(mu) END AS approx, CASE WHEN sqrt(mu + mu * mu / size) < 1e-12 THEN 0.0 ELSE (x - mu) / sqrt(mu + mu * mu / size) END AS \"full\" FROM res)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Queries that need no fit; all others make one, once.
PLAIN = {"gene_mask", "cell_stats", "cell_stats_empty", "gene_stats", "totals", "size_factors", "normalized", "normalized_empty"}


def _add(name: str, fixture, make, sql: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        matrix = fixture(spark, sf_dir)
        return make(matrix if name in PLAIN else fitted(matrix, write_counts=True))

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_add("gene_mask", fx.customer_parts, lambda m: depth.gene_mask(m.counts), _prelude(fx.customer_parts) + "SELECT DISTINCT gene_id FROM counts")
_CELLS = "SELECT cell_id, ti, (SELECT count(*) FROM gs) - n AS di FROM cs"
for _name, _fx in (("cell_stats", fx.customer_parts), ("cell_stats_empty", fx.customer_parts_sparse)):
    _add(_name, _fx, depth.cell_stats, _prelude(_fx) + _CELLS)
_add("gene_stats", fx.customer_parts, depth.gene_stats, _prelude(fx.customer_parts) + "SELECT gene_id, tj, dj FROM gs")
_add("totals", fx.customer_parts, depth.totals, _prelude(fx.customer_parts) + "SELECT total, nc, (SELECT count(*) FROM gs) AS ng FROM tot")
_add("size_factors", fx.user_events, lambda m: depth.size_factors(depth.cell_stats(m)).select("cell_id", r("size_factor")), _prelude(fx.user_events) + _BASIC + f"SELECT cell_id, {rs('size_factor', 'size_factor')} FROM sf")


def _fit_columns(f: DataFrame) -> DataFrame:
    return f.select("gene_id", "tj", "dj", r("mean"), r("var_obs", 4), r("size", 4))


_FIT = f"SELECT gene_id, tj, dj, {rs('mean', 'mean')}, {rs('var_obs', 'var_obs', 4)}, {rs('size', 'size', 4)} FROM "
for _name, _fx in (("dispersion", fx.customer_parts), ("dispersion_sentinel", fx.supplier_part_lines)):
    _add(_name, _fx, lambda m: _fit_columns(dispersion.fit_dispersion(m)), _prelude(_fx) + _FIT + "fit")
for _name, _fx in (("basic_fit", fx.user_events), ("basic_fit_sentinel", fx.supplier_part_lines)):
    _add(_name, _fx, lambda m: _fit_columns(dispersion.fit_basic(m)), _prelude(_fx) + _BASIC + _FIT + "basic")
for _name, _fx in (("disp_trend", fx.customer_parts), ("disp_trend_planted", fx.customer_parts_planted), ("disp_trend_high", fx.supplier_part_flags)):
    _add(_name, _fx, lambda m: dispersion.fit_trend(dispersion.fit_dispersion(m)).select(r("intercept"), r("slope"), "n"), _prelude(_fx) + _trend("fit", "tr") + f"SELECT {rs('intercept', 'intercept')}, {rs('slope', 'slope')}, n FROM tr")
_add("high_variance", fx.customer_parts, lambda m: dispersion.select_high_variance(dispersion.fit_dispersion(m), strict=False).select("gene_id", r("residual")), _prelude(fx.customer_parts) + _trend("fit", "tr") + f"SELECT gene_id, {rs('ln(size) - (intercept + slope * ln(mean))', 'residual')} FROM fit, tr")
_add("expected_dropout_gene", fx.supplier_parts, lambda m: dropout.expected_dropout(m, strict=False)[0].select("gene_id", r("p_sum")), _prelude(fx.supplier_parts) + _trend("fit", "tr") + _SMOOTH + _PAIRS + f"SELECT gene_id, {rs('sum(p)', 'p_sum')} FROM pairs GROUP BY gene_id")
_add("expected_dropout_cell", fx.supplier_parts, lambda m: dropout.expected_dropout(m, strict=False)[1].select("cell_id", r("p_sum")), _prelude(fx.supplier_parts) + _trend("fit", "tr") + _SMOOTH + _PAIRS + f"SELECT cell_id, {rs('sum(p)', 'p_sum')} FROM pairs GROUP BY cell_id")
for _name, _fx in (("dropout_z", fx.customer_parts_planted), ("dropout_z_empty", fx.customer_parts_sparse)):
    _add(_name, _fx, lambda m: dropout.dropout_z(m, strict=False).select("gene_id", r("observed"), r("expected"), r("effect_size"), r("z", 4)), _full(_fx) + f"SELECT gene_id, {rs('observed', 'observed')}, {rs('expected', 'expected')}, {rs('effect_size', 'effect_size')}, {rs('z', 'z', 4)} FROM zz")


def _logs(t: DataFrame) -> DataFrame:
    log = lambda c: F.when(F.col(c) > 0, F.round(-F.log10(F.col(c)), 4) + F.lit(0.0))
    return t.select("gene_id", r("effect_size"), log("p_value").alias("neg_log10_p"), log("q_value").alias("neg_log10_q"))


_LOGS = f"SELECT gene_id, {rs('effect_size', 'effect_size')}, CASE WHEN p_value > 0 THEN round(-log10(p_value), 4) + 0.0 END AS neg_log10_p, CASE WHEN q_value > 0 THEN round(-log10(q_value), 4) + 0.0 END AS neg_log10_q FROM qv"
for _name, _fx in (("dropout_test", fx.customer_parts_planted), ("dropout_test_empty", fx.customer_parts_sparse)):
    _add(_name, _fx, lambda m: _logs(dropout.dropout_test(m, strict=False)), _full(_fx) + _LOGS)
_add("select_dropout", fx.customer_parts_planted, lambda m: _logs(dropout.select_dropout(m, strict=False)), _full(fx.customer_parts_planted) + _LOGS + " WHERE q_value < 0.05")


_add("select_dropout_labelled", fx.customer_parts_planted, lambda m: m.labelled(dropout.select_dropout(m, strict=False)).select("gene", "gene_id", r("effect_size")), _full(fx.customer_parts_planted) + f"SELECT p_name AS gene, gene_id, {rs('effect_size', 'effect_size')} FROM qv LEFT JOIN part ON p_partkey = gene_id WHERE q_value < 0.05")
for _name, _fx in (("normalized", fx.user_events), ("normalized_empty", fx.customer_parts_sparse)):
    _add(_name, _fx, lambda m: depth.normalized(m).select("cell_id", "gene_id", r("value")), _prelude(_fx) + f"SELECT cell_id, gene_id, {rs('CASE WHEN ti > 0 THEN c / ti * 10000.0 ELSE 0.0 END', 'value')} FROM counts JOIN cs USING (cell_id)")


def _volcano(m) -> DataFrame:
    return diagnostics.volcano(dropout.dropout_test(m, strict=False))


_VOLCANO = ", least_q AS (SELECT min(q_value) AS least FROM qv WHERE q_value > 0), vo AS (SELECT gene_id, effect_size, p_value AS p, CASE WHEN q_value = 0 THEN least ELSE q_value END AS q FROM qv, least_q), vc AS (SELECT *, CASE WHEN q < 0.05 AND effect_size > 0.25 THEN 'red' WHEN q < 0.05 AND effect_size < -0.25 THEN 'blue' ELSE 'grey' END AS colour FROM vo)"
_VOLCANO_COLUMNS = f" SELECT gene_id, {rs('effect_size', 'effect_size')}, {rs('-log10(q)', 'neg_log10_q', 4)}, colour FROM vc"
_add("volcano", fx.customer_parts_planted, lambda m: _volcano(m).select("gene_id", r("effect_size"), r("neg_log10_q", 4), "colour"), _full(fx.customer_parts_planted) + _VOLCANO + _VOLCANO_COLUMNS)
_add("volcano_labels", fx.customer_parts_planted, lambda m: diagnostics.volcano_labels(_volcano(m)).select("gene_id", r("effect_size"), r("neg_log10_q", 4), "colour"), _full(fx.customer_parts_planted) + _VOLCANO + _VOLCANO_COLUMNS + " ORDER BY q, p, gene_id LIMIT 10")
_COMPARE = _prelude(fx.customer_parts_planted) + _BASIC + _trend("fit", "tr") + _SMOOTH + _PAIRS + _trend("basic", "btr") + f""",
adj AS (SELECT gene_id, sum(p) / nc AS adj_fit FROM pairs, tot GROUP BY gene_id, nc),
bas AS (SELECT gene_id, {_p('es', '(total / nc)')} AS bas_fit FROM (SELECT basic.*, exp(intercept + slope * ln(mean)) AS es FROM basic, btr), tot),
cmp AS (SELECT gene_id, mean AS mean_expr, dj / nc AS observed, adj_fit, bas_fit FROM fit JOIN adj USING (gene_id) JOIN bas USING (gene_id), (SELECT nc::DOUBLE AS nc FROM tot))"""
_add("model_comparison", fx.customer_parts_planted, lambda m: dropout.compare_models(m, strict=False).select("gene_id", *[r(c) for c in ("mean_expr", "observed", "adj_fit", "bas_fit")]), _COMPARE + " SELECT gene_id, " + ", ".join(rs(c, c) for c in ("mean_expr", "observed", "adj_fit", "bas_fit")) + " FROM cmp")
_add("model_errors", fx.customer_parts_planted, lambda m: dropout.model_errors(dropout.compare_models(m, strict=False)).select(r("depth_adjusted"), r("basic")), _COMPARE + f" SELECT {rs('sum(abs(adj_fit - observed))', 'depth_adjusted')}, {rs('sum(abs(bas_fit - observed))', 'basic')} FROM cmp")
_add("comparison_points", fx.customer_parts_planted, lambda m: diagnostics.comparison_points(dropout.compare_models(m, strict=False), 1000).select("gene_id", r("mean_expr")), _COMPARE + f" SELECT gene_id, {rs('mean_expr', 'mean_expr')} FROM (SELECT *, row_number() OVER (ORDER BY mean_expr, gene_id) AS rn, count(*) OVER () AS n FROM cmp) WHERE n <= 1000 OR rn % 2 = 1")
_add("dispersion_curve", fx.customer_parts, lambda m: diagnostics.dispersion_curve(dispersion.fit_dispersion(m), strict=False).select("point", r("mean", 4), r("size")), _prelude(fx.customer_parts) + _trend("fit", "tr") + f", ends AS (SELECT min(ln(mean)) FILTER (WHERE mean > 0) AS lo, max(ln(mean)) AS hi FROM fit WHERE mean > 0), line AS (SELECT point, lo + point * (hi - lo) / 99.0 AS x FROM generate_series(0, 99) AS g(point), ends) SELECT point, {rs('exp(x)', 'mean', 4)}, {rs('exp(intercept + slope * x)', 'size')} FROM line, tr")
_add("dispersion_points", fx.supplier_part_lines, lambda m: diagnostics.dispersion_points(dispersion.fit_dispersion(m)).select("gene_id", r("mean"), r("size", 4)), _prelude(fx.supplier_part_lines) + f"SELECT gene_id, {rs('mean', 'mean')}, {rs('size', 'size', 4)} FROM fit WHERE size < 9999 AND size > 0")
for _kind in ("full", "approx"):
    _add(f"residual_{_kind}", fx.supplier_parts, lambda m, k=_kind: residuals.pearson_residuals(m).select("cell_id", "gene_id", "x", rounded("residual", F.col(k))), _prelude(fx.supplier_parts) + _RES + f'SELECT cell_id, gene_id, x, {rs(chr(34) + _kind + chr(34), "residual")} FROM rv')
_add("stored_residuals", fx.customer_parts, lambda m: residuals.stored_residuals(m).select("cell_id", "gene_id", r("approx"), r("full")), _prelude(fx.customer_parts) + f', st AS (SELECT cell_id, gene_id, c AS x, tj * ti / total AS mu, size FROM counts JOIN cs USING (cell_id) JOIN fit USING (gene_id), tot) SELECT cell_id, gene_id, {rs("(x - mu) / sqrt(mu)", "approx")}, {rs("(x - mu) / sqrt(mu + mu * mu / size)", chr(34) + "full" + chr(34))} FROM st')
_MOMENTS = ("mean_x", "approx_mean", "approx_var", "full_mean", "full_var")
_add("residual_moments", fx.supplier_parts, lambda m: residuals.residual_moments(m).select("gene_id", *[r(c) for c in _MOMENTS]), _prelude(fx.supplier_parts) + _RES + f'SELECT gene_id, {rs("avg(x)", "mean_x")}, {rs("avg(approx)", "approx_mean")}, {rs("avg(approx * approx) - avg(approx) * avg(approx)", "approx_var")}, {rs("avg(" + chr(34) + "full" + chr(34) + ")", "full_mean")}, {rs("avg(" + chr(34) + "full" + chr(34) + " * " + chr(34) + "full" + chr(34) + ") - avg(" + chr(34) + "full" + chr(34) + ") * avg(" + chr(34) + "full" + chr(34) + ")", "full_var")} FROM rv GROUP BY gene_id')
_add("residual_histogram", fx.supplier_parts, lambda m: residuals.histogram(m, "approx").select("bin", r("left"), r("density")), _prelude(fx.supplier_parts) + _RES + f", hb AS (SELECT least(CAST(floor((approx + 5.0) / (10.0 / 99)) AS INTEGER) + 1, 99) AS bin, count(*) AS n FROM rv WHERE approx BETWEEN -5 AND 5 GROUP BY 1), ht AS (SELECT sum(n)::DOUBLE AS total FROM hb) SELECT CAST(g.bin AS INTEGER) AS bin, {rs('-5.0 + (g.bin - 1) * (10.0 / 99)', chr(34) + 'left' + chr(34))}, {rs('coalesce(n, 0) / (total * (10.0 / 99))', 'density')} FROM generate_series(1, 99) AS g(bin) LEFT JOIN hb ON hb.bin = g.bin, ht")
_add("dense_rows", fx.supplier_parts, lambda m: residuals.dense_residuals(m, "x").select("cell_id", F.size("values").cast("long").alias("genes"), r("sum", 2, F.aggregate("values", F.lit(0.0), lambda a, v: a + v))), _prelude(fx.supplier_parts) + "SELECT cell_id, (SELECT count(*) FROM gs) AS genes, round(ti, 2) + 0.0 AS sum FROM cs")


def sampled_pairs(m, sampled: float = residuals.SAMPLED) -> DataFrame:
    """The residual pairs to plot, drawn at the rate that brings about ``sampled`` of them."""
    rate = residuals.sampling_rate(m.cells.count(), depth.gene_mask(m.counts).count(), sampled)
    return residuals.shown(residuals.drawn_residuals(m, rate, 1))


# a pair's number of draws in plain SQL: the product of uniform terms is summed up again for the rate of the tables
_DRAWN = _RES + """, dims AS (SELECT least(1.0::DOUBLE, 5e6::DOUBLE / ((SELECT count(*) FROM cs) * (SELECT count(*) FROM fit))) AS rate),
terms AS (SELECT k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS term FROM generate_series(0, 40) AS g(k), dims),
steps AS (SELECT k, sum(term) OVER (ORDER BY k) AS step FROM terms),
chances AS (SELECT *, CAST('0x' || substr(md5('1:' || cell_id || ':' || gene_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS chance FROM rv WHERE approx > -10 AND approx < 10),
drawn AS (SELECT cell_id, gene_id, x, approx, "full" FROM chances JOIN steps ON chance >= step AND step < 1.0 - 1e-12)"""
_DENSITY = """, bins AS (SELECT floor(("full" + 10.0) / (20.0::DOUBLE / 2000)) AS b, count(*) AS n, sum("full") AS s, sum("full" * "full") AS ss FROM drawn WHERE "full" > -10 AND "full" < 10 GROUP BY 1),
spread AS (SELECT sum(n)::DOUBLE AS total, sqrt((sum(ss) - sum(s) * sum(s) / sum(n)) / greatest(sum(n) - 1, 1)) * pow(sum(n), -0.2) AS h FROM bins),
grid AS (SELECT -10.0 + i * (20.0::DOUBLE / 199) AS spot FROM generate_series(0, 199) AS g(i))"""
_add("residual_sample", fx.supplier_parts, lambda m: sampled_pairs(m).select("cell_id", "gene_id", "x", r("approx"), r("full")), _prelude(fx.supplier_parts) + _DRAWN + f" SELECT cell_id, gene_id, x, {rs('approx', 'approx')}, {rs(chr(34) + 'full' + chr(34), chr(34) + 'full' + chr(34))} FROM drawn")
_add("residual_density", fx.supplier_parts, lambda m: residuals.density(sampled_pairs(m), "full").select(r("at"), r("density")), _prelude(fx.supplier_parts) + _DRAWN + _DENSITY + f" SELECT {rs('spot', chr(34) + 'at' + chr(34))}, {rs('sum(n * exp(-pow((spot - s / n) / h, 2) / 2) / (h * sqrt(2 * pi()))) / total', 'density')} FROM bins, spread, grid GROUP BY spot, total")


def _part_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ((F.col("p_partkey") * 7919) % 10007 + 1) / F.lit(10007.0)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("gene_id"), (u * u * u).alias("p_value"))


_U = "(((p_partkey * 7919) % 10007 + 1) / 10007.0::DOUBLE)"
_RANKED = f"WITH ps AS (SELECT p_partkey AS gene_id, {_U} * {_U} * {_U} AS p FROM part), t AS (SELECT *, row_number() OVER (ORDER BY p, gene_id) AS rn, count(*) OVER () AS n FROM ps)"
_DOWN = "OVER (ORDER BY p DESC, gene_id DESC ROWS UNBOUNDED PRECEDING)"
_UP = "OVER (ORDER BY p, gene_id ROWS UNBOUNDED PRECEDING)"
_TWO = ", bh AS (SELECT gene_id, n, least(1.0, min(p * n / rn) " + _DOWN + ") AS q FROM t), nulls AS (SELECT *, CASE WHEN c > 0 AND c < n THEN n - c ELSE n END AS n0 FROM (SELECT *, count(*) FILTER (WHERE q <= 0.05 / {f}) OVER () AS c FROM bh)) SELECT gene_id, " + rs("least(1.0, q * n0 / n * {f})", "q_value") + " FROM nulls"
_ADJUST = {
    "fdr_bh": f" SELECT gene_id, {rs(f'least(1.0, min(p * n / rn) {_DOWN})', 'q_value')} FROM t",
    "fdr_by": f" SELECT gene_id, {rs(f'least(1.0, min(p * n / rn) {_DOWN} * (SELECT sum(1.0::DOUBLE / rn) FROM t))', 'q_value')} FROM t",
    "bonferroni": f" SELECT gene_id, {rs('least(1.0, p * n)', 'q_value')} FROM t",
    "sidak": f" SELECT gene_id, {rs('1.0 - pow(1.0 - p, n)', 'q_value')} FROM t",
    "holm": f" SELECT gene_id, {rs(f'least(1.0, max(p * (n - rn + 1)) {_UP})', 'q_value')} FROM t",
    "holm-sidak": f" SELECT gene_id, {rs(f'max(1.0 - pow(1.0 - p, n - rn + 1)) {_UP}', 'q_value')} FROM t",
    "simes-hochberg": f" SELECT gene_id, {rs(f'least(1.0, min(p * (n - rn + 1)) {_DOWN})', 'q_value')} FROM t",
    "fdr_tsbh": _TWO.replace("{f}", "1.0"),
    "fdr_tsbky": _TWO.replace("{f}", "1.05"),
    "hommel": None,
}
for _method, _sql in _ADJUST.items():
    QUERIES["adjust_" + _method.replace("-", "_")] = lambda spark, sf_dir, m=_method: corrections.adjusted(_part_p(spark, sf_dir), m).select("gene_id", r("q_value"))
    if _sql:
        ORACLES["adjust_" + _method.replace("-", "_")] = _RANKED + _sql


def streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part totals kept over a stream of lines, run until all input is taken."""
    path = f"{sf_dir}/lineitem.parquet"
    # a file stream reads folders
    lines = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    entries = lines.select(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("x"))
    # every batch's totals replace those of the batch before, in a table that tasks write and read
    place = shared_path(spark, "streamed-gene-totals")

    def put(totals: DataFrame, number: int) -> None:
        totals.write.mode("overwrite").parquet(place)

    run = streaming_gene_stats(entries).writeStream.outputMode("complete").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(place)


QUERIES["streaming_gene_stats"] = streaming_totals
ORACLES["streaming_gene_stats"] = "SELECT l_partkey AS gene_id, sum(ceil(l_quantity)) AS tj, count(*) AS detected, sum(ceil(l_quantity) * ceil(l_quantity)) AS xx FROM lineitem GROUP BY 1"
