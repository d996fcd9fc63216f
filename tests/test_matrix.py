"""Rules of the matrix on small matrices by hand, and operators against plain loops."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.normal import normal_tail
from tallyloom.operators import corrections, depth, diagnostics, dispersion, dropout, residuals
from tallyloom.operators.fitted import fitted
from tallyloom.plans import fixtures, flow, queries
from tallyloom.sources.h5ad import balanced_ranges
from tallyloom.sources.matrix import CountMatrix, read_matrix
from tallyloom.sources.sinks import dense_rows, finished, stage, write_csv
from tests.oracle import check


def matrix(spark, entries, cells, genes=None):
    counts = spark.createDataFrame(entries, "cell_id long, gene_id long, x double")
    dims = spark.createDataFrame([(c,) for c in cells], "cell_id long")
    names = sorted({e[1] for e in entries}) if genes is None else genes
    return CountMatrix(counts, dims, spark.createDataFrame([(g,) for g in names], "gene_id long"))


def table(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in df.collect()}


def random_matrix(spark, cells=30, genes=12, seed=1):
    rng = np.random.default_rng(seed)
    depths = rng.gamma(3.0, 1.0, cells)
    x = rng.poisson(rng.gamma(0.8, 1.0, (cells, genes)) * depths[:, None] * rng.uniform(0.5, 4.0, genes)[None, :])
    x[3] = 0
    entries = [(i, j, float(x[i, j])) for i in range(cells) for j in range(genes) if x[i, j]]
    return x.astype(float), matrix(spark, entries, range(cells))


def test_empty_cell_counts(spark):
    m = matrix(spark, [(0, 0, 2.0), (0, 1, 1.0), (2, 2, 5.0)], [0, 1, 2])
    assert table(depth.cell_stats(m), "cell_id", "ti", "di") == {0: (3.0, 1), 1: (0.0, 3), 2: (5.0, 2)}
    assert depth.totals(m).first() == (8.0, 3, 3)
    fit = dispersion.fit_dispersion(m)
    r = residuals.pearson_residuals(m, fit).filter("cell_id = 1").collect()
    assert len(r) == 3 and all(x["approx"] == 0 and x["full"] == 0 for x in r)


def test_stored_zero_is_detected_and_dropped_gene_vanishes(spark):
    m = matrix(spark, [(0, 0, 0.0), (1, 1, 3.0)], [0, 1], genes=[0, 1, 2])
    assert table(depth.gene_stats(m), "gene_id", "tj", "dj") == {0: (0.0, 1), 1: (3.0, 1)}
    assert sorted(r[0] for r in depth.gene_mask(m.counts).collect()) == [0, 1]
    assert table(depth.gene_stats(m.without_zeros()), "gene_id", "dj") == {1: 1}


def test_masked_and_summed(spark):
    m = matrix(spark, [(0, 0, 1.0), (0, 0, 2.0), (0, 1, 1.0)], [0])
    assert table(depth.gene_stats(m.summed()), "gene_id", "tj", "dj") == {0: (3.0, 0), 1: (1.0, 0)}
    kept = spark.createDataFrame([(1,)], "gene_id long")
    assert table(depth.gene_stats(depth.masked(m, kept)), "gene_id", "tj") == {1: 1.0}


def test_ceilings(spark):
    m = matrix(spark, [(0, 0, 0.3), (0, 1, 1.0), (0, 2, 2.5)], [0])
    assert table(depth.gene_stats(m), "gene_id", "tj") == {0: 1.0, 1: 1.0, 2: 3.0}


def test_size_factors_take_the_mean_of_the_middle_two(spark):
    cells = spark.createDataFrame([(0, 2.0), (1, 4.0), (2, 0.0)], "cell_id long, ti double")
    assert table(depth.size_factors(cells), "cell_id", "size_factor") == {0: 2 / 3, 1: 4 / 3, 2: 1.0}


def test_basic_model_rounds_half_to_even_on_raw_values(spark):
    m = matrix(spark, [(0, 0, 0.5), (0, 1, 1.5), (0, 2, 2.5), (1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)], [0, 1])
    # both cells have 6 after the ceiling, so the factors are 1; values 0.5, 1.5, 2.5 become 0, 2, 2
    got = table(dispersion.fit_basic(m), "gene_id", "var_obs")
    assert got == {0: 0.25, 1: 0.0, 2: 0.25}


def test_undispersed_sentinels(spark):
    m = matrix(spark, [(i, j, 4.0) for i in range(4) for j in range(2)], range(4))
    assert set(table(dispersion.fit_dispersion(m), "gene_id", "size").values()) == {10000.0}
    assert set(table(dispersion.fit_basic(m), "gene_id", "size").values()) == {1000.0}
    with pytest.raises(Exception, match="no trend"):
        dispersion.select_high_variance(dispersion.fit_dispersion(m)).collect()


def test_dispersion_against_loops(spark):
    x, m = random_matrix(spark)
    nc = len(x)
    ti, tj = x.sum(1), x.sum(0)
    mu = np.outer(ti, tj) / x.sum()
    dev = ((x - mu) ** 2).sum(0)
    square = (mu**2).sum(0)
    for r in dispersion.fit_dispersion(m).collect():
        j = r["gene_id"]
        assert r["var_obs"] == pytest.approx(dev[j] / (nc - 1))
        assert r["size"] == pytest.approx(square[j] / (dev[j] - tj[j]) if dev[j] - tj[j] > 1e-6 else 10000.0)


def test_expected_dropout_by_depth_equals_all_pairs(spark):
    x, m = random_matrix(spark)
    fit = dispersion.fit_dispersion(m)
    trend = dispersion.fit_trend(fit).first()
    ti, tj = x.sum(1), x.sum(0)
    es = np.exp(trend["intercept"] + trend["slope"] * np.log(tj / len(x)))
    p = (np.outer(ti, tj) / x.sum() / es + 1.0) ** -es
    by_gene, by_cell = dropout.expected_dropout(m, fit)
    got = table(by_gene, "gene_id", "p_sum", "pq_sum")
    for j in got:
        assert got[j] == pytest.approx((p[:, j].sum(), (p[:, j] * (1 - p[:, j])).sum()))
    cells = table(by_cell, "cell_id", "p_sum")
    assert [cells[i] for i in range(len(x))] == pytest.approx(list(p.sum(1)))
    assert sum(v[0] for v in got.values()) == pytest.approx(sum(cells.values()))


def test_a_cell_without_counts_changes_the_fit(spark, sf_dir):
    m = fixtures.customer_parts_sparse(spark, sf_dir)
    fewer = CountMatrix(m.counts, m.counts.select("cell_id").distinct(), m.genes)
    assert depth.totals(m).first()["nc"] > depth.totals(fewer).first()["nc"]


def test_moments_without_dense_rows(spark):
    x, m = random_matrix(spark, seed=3)
    fit = dispersion.fit_dispersion(m)
    dense = residuals.pearson_residuals(m, fit)
    want = {r["gene_id"]: r for r in dense.groupBy("gene_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("approx", "full") for n, f in (("mean", F.avg), ("var", F.var_pop))]).collect()}
    for r in residuals.residual_moments(m, fit).collect():
        w = want[r["gene_id"]]
        assert (r["approx_mean"], r["approx_var"], r["full_mean"], r["full_var"]) == pytest.approx((w["mean_approx"], w["var_approx"], w["mean_full"], w["var_full"]), abs=1e-9)
    stored = residuals.stored_residuals(m, fit)
    assert stored.count() == m.counts.count()
    assert stored.join(dense, ["cell_id", "gene_id", "x", "approx", "full"]).count() == m.counts.count()


def test_z_without_an_error(spark):
    t = spark.createDataFrame([(0, 1.0, 0.0), (1, -1.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 2.0)], "gene_id long, d double, e double")
    t = t.select("gene_id", dropout.z_score(F.col("d"), F.col("e")).alias("z")).withColumn("p_value", normal_tail("z"))
    got = table(t, "gene_id", "p_value")
    assert got[0] == 0.0 and got[1] == 1.0 and math.isnan(got[2]) and got[3] == pytest.approx(0.3085375387)
    q = table(corrections.adjusted(t), "gene_id", "q_value", "p_value")
    assert q[2][0] == 1.0 and math.isnan(q[2][1])


def test_normal_tail_against_erfc(spark):
    z = [i / 16 for i in range(-40 * 16, 40 * 16 + 1)]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", normal_tail("z").alias("p")).collect()
    for r in got:
        want = 0.5 * math.erfc(r["z"] / math.sqrt(2))
        # below about 1e-308 digits are lost in either
        assert r["p"] == pytest.approx(want, rel=5e-12, abs=1e-306)


def plain_adjust(p, method):
    n = len(p)
    order = sorted(range(n), key=lambda i: p[i])
    s = [p[i] for i in order]
    out = [0.0] * n
    for k, i in enumerate(order):
        if method == "fdr_bh":
            v = min(s[j] * n / (j + 1) for j in range(k, n))
        elif method == "fdr_by":
            v = min(s[j] * n / (j + 1) for j in range(k, n)) * sum(1 / j for j in range(1, n + 1))
        elif method == "bonferroni":
            v = s[k] * n
        elif method == "sidak":
            v = 1 - (1 - s[k]) ** n
        elif method == "holm":
            v = max(s[j] * (n - j) for j in range(k + 1))
        elif method == "holm-sidak":
            v = max(1 - (1 - s[j]) ** (n - j) for j in range(k + 1))
        elif method == "simes-hochberg":
            v = min(s[j] * (n - j) for j in range(k, n))
        out[i] = min(1.0, v)
    return out


@pytest.mark.parametrize("method", corrections.METHODS)
def test_corrections(spark, method):
    p = [0.01, 0.02, 0.02, 0.04, float("nan"), 0.5, 1.0, 0.0]
    t = spark.createDataFrame(list(enumerate(p)), "gene_id long, p_value double")
    got = table(corrections.adjusted(t, method), "gene_id", "q_value")
    clean = [1.0 if math.isnan(v) else v for v in p]
    assert all(0 <= v <= 1 for v in got.values())
    if method in ("hommel", "fdr_tsbh", "fdr_tsbky"):
        bound = plain_adjust(clean, "simes-hochberg" if method == "hommel" else "fdr_bh")
        assert all(got[i] <= bound[i] * 1.05 + 1e-12 for i in got)
    else:
        assert [got[i] for i in range(len(p))] == pytest.approx(plain_adjust(clean, method))
    with pytest.raises(ValueError):
        corrections.adjusted(t, "none")


def test_bh_by_hand(spark):
    t = spark.createDataFrame(list(enumerate([0.01, 0.02, 0.02, 0.04, float("nan")])), "gene_id long, p_value double")
    assert [v for _, v in sorted(table(corrections.adjusted(t), "gene_id", "q_value").items())] == pytest.approx([1 / 30, 1 / 30, 1 / 30, 0.05, 1.0])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=2, max_size=7))
def test_hommel_against_its_closed_test(p):
    """Hommel rejects a hypothesis at a level if every subset that holds it is rejected by Simes."""
    from itertools import combinations

    p = sorted(p)
    n = len(p)
    got = corrections.hommel(np.array(p))
    for i in range(n):
        worst = 0.0
        for size in range(1, n + 1):
            for subset in combinations(range(n), size):
                if i in subset:
                    s = sorted(p[j] for j in subset)
                    worst = max(worst, min(size * v / (k + 1) for k, v in enumerate(s)))
        assert got[i] == pytest.approx(min(1.0, worst), abs=1e-12)


def test_planted_genes_are_found(spark):
    m = fixtures.customer_parts_planted(spark, "/root/testdata/sf0.01")
    found = [r["gene_id"] for r in dropout.select_dropout(m).collect()]
    assert len(found) == 200 and all(g % 10 == 0 for g in found)


def test_volcano_zeros(spark):
    t = spark.createDataFrame([(0, 0.5, 0.001, 0.0), (1, -0.5, 0.002, 0.01), (2, 0.0, 0.1, 0.2)], "gene_id long, effect_size double, p_value double, q_value double")
    got = table(diagnostics.volcano(t), "gene_id", "q_value", "colour")
    assert got == {0: (0.01, "red"), 1: (0.01, "blue"), 2: (0.2, "grey")}
    assert [r["gene_id"] for r in diagnostics.volcano_labels(diagnostics.volcano(t), 2).collect()] == [0, 1]
    zeros = diagnostics.volcano(t.filter("gene_id = 0"))
    assert zeros.first()["q_value"] is None


def test_equal_q_is_labelled_by_p(spark):
    t = spark.createDataFrame([(0, 0.9, 0.03, 0.04), (1, 0.3, 0.01, 0.04), (2, 0.5, 0.02, 0.04), (3, 0.1, None, None)], "gene_id long, effect_size double, p_value double, q_value double")
    assert [r["gene_id"] for r in diagnostics.volcano_labels(diagnostics.volcano(t)).collect()] == [1, 2, 0, 3]


def test_histogram_edges(spark):
    v = spark.createDataFrame([(5.0,), (5.0001,), (-5.0,), (0.0,)], "v double")
    got = table(residuals.residual_histogram(v, "v"), "bin", "density")
    width = 10 / 99
    assert len(got) == 99 and got[99] == pytest.approx(1 / 3 / width) and got[1] == pytest.approx(1 / 3 / width) and got[50] == pytest.approx(1 / 3 / width)


def test_sample_is_seeded_and_density_sums_to_one(spark):
    t = spark.range(4000).select((F.col("id") % 40).alias("cell_id"), F.floor(F.col("id") / 40).alias("gene_id"), ((F.rand(1) - 0.5) * 4).alias("approx"), F.lit(0.0).alias("full"))
    a, b, other = (sorted((r["cell_id"], r["gene_id"]) for r in residuals.residual_sample(t.repartition(n), 0.3, seed).collect()) for n, seed in ((3, 5), (7, 5), (3, 6)))
    assert a == b != other and len(a) == pytest.approx(1200, rel=0.1) and len(set(a)) < len(a)
    assert residuals.poisson_steps(0.3)[:2] == pytest.approx([math.exp(-0.3), 1.3 * math.exp(-0.3)])
    rows = residuals.density(t, "approx").collect()
    assert sum(r["density"] for r in rows) * 20 / 199 == pytest.approx(1.0, abs=0.02)
    assert residuals.sampling_rate(10, 10) == 1.0 and residuals.sampling_rate(10**6, 10**4) == 5e-4


def test_sources_and_sinks(spark, tmp_path):
    m = matrix(spark, [(0, 0, 2.0), (0, 1, 1.0), (1, 1, 5.0)], [0, 1])
    m.write(str(tmp_path / "m"))
    back = read_matrix(spark, str(tmp_path / "m"))
    assert back.counts.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_matrix(spark, str(tmp_path / "none"))
    calls = []

    def make():
        calls.append(1)
        return depth.gene_stats(m)

    path = str(tmp_path / "stage")
    assert not finished(spark, path)
    assert stage(spark, path, make).count() == stage(spark, path, make).count() == 2 and len(calls) == 1
    write_csv(depth.gene_stats(m), str(tmp_path / "csv"), gene_id="Gene")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[0] == "Gene"
    rows = {r["cell_id"]: list(r["values"]) for r in dense_rows(residuals.pearson_residuals(m), "x").collect()}
    assert rows == {0: [2.0, 1.0], 1: [0.0, 5.0]}


def test_balanced_ranges_cover_all_rows():
    indptr = np.array([0, 2, 2, 5, 6, 6])
    ranges = balanced_ranges(indptr, 3)
    assert ranges[0][0] == 0 and ranges[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_residual_queries_use_the_operators_settings(spark, sf_dir):
    matrix = fixtures.supplier_parts(spark, sf_dir)
    pairs = residuals.pearson_residuals(matrix).count()
    # far under the 5,000,000 of the default, so as many are drawn as there are pairs
    assert queries.QUERIES["residual_sample"](spark, sf_dir).count() == pytest.approx(pairs, rel=0.2)
    assert queries.sampled_pairs(matrix, pairs / 10).count() == pytest.approx(pairs / 10, rel=0.3)
    assert queries.QUERIES["residual_density"](spark, sf_dir).count() == 200


def test_comparison_points_thin_above_the_most(spark):
    rows = spark.createDataFrame([(g, float(g)) for g in range(11)], "gene_id long, mean_expr double")
    assert diagnostics.comparison_points(rows).count() == diagnostics.comparison_points(rows, 11).count() == 11
    assert sorted(r["gene_id"] for r in diagnostics.comparison_points(rows, 10).collect()) == [0, 2, 4, 6, 8, 10]


def test_without_a_trend_the_message_says_so(spark):
    m = matrix(spark, [(c, g, 1.0) for c in range(3) for g in range(2)], [0, 1, 2])
    with pytest.raises(Exception, match="no trend: the eligible genes have no two different means"):
        dropout.dropout_z(m).collect()


@pytest.mark.parametrize("method", ["fdr_tsbh", "fdr_tsbky"])
def test_two_stages_against_plain_loops(spark, method):
    rng = np.random.default_rng(3)
    p = np.r_[rng.uniform(size=60) ** 4, rng.uniform(size=40), 0.0, 1.0]
    n, alpha = len(p), 0.05

    def bh(values):
        order, q, least = np.argsort(values), np.empty(n), 1.0
        for rank in range(n, 0, -1):
            least = min(least, values[order[rank - 1]] * n / rank)
            q[order[rank - 1]] = least
        return q

    # the first stage rejects at alpha (at alpha / (1 + alpha) for tsbky) and so tells how many null hypotheses are left
    level = alpha if method == "fdr_tsbh" else alpha / (1 + alpha)
    rejected = sum(q <= level for q in bh(p))
    left = n - rejected if 0 < rejected < n else n
    factor = 1.0 if method == "fdr_tsbh" else 1 + alpha
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "gene_id long, p_value double")
    got = table(corrections.adjusted(t, method, alpha=alpha), "gene_id", "q_value")
    assert 0 < rejected < n
    assert [got[i] for i in range(n)] == pytest.approx([min(1.0, q * left / n * factor) for q in bh(p)])


class Group(dict):
    attrs: dict = {}


def test_h5ad_reader(monkeypatch):
    """The reader against a stand-in for the file library: every range gives its rows' entries."""
    import sys
    import types

    from tallyloom.sources import h5ad

    indptr = np.array([0, 3, 3, 4, 9, 11])
    indices, data = np.array([0, 2, 5, 1, 0, 1, 2, 3, 4, 5, 0]), np.arange(11) + 0.5
    x = Group(indptr=indptr, indices=indices, data=data)
    x.attrs = {"encoding-type": "csr_matrix"}
    obs = Group(_index=np.array([b"c1", b"c2", b"c3", b"c4", b"c5"]))
    file = {"X": x, "obs": obs}

    class File:
        def __init__(self, path, mode):
            assert (path, mode) == ("some.h5ad", "r")

        def __enter__(self):
            return file

        def __exit__(self, *_):
            pass

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File))
    reader = h5ad._Reader("some.h5ad", 4)
    parts = reader.partitions()
    assert len(parts) > 1 and (parts[0].start, parts[-1].stop) == (0, 5)
    rows = [r for p in parts for batch in reader.read(p) for r in zip(*(batch.column(i).to_pylist() for i in range(3)))]
    assert rows == [(c, int(indices[i]), float(data[i])) for c in range(5) for i in range(indptr[c], indptr[c + 1])]
    assert h5ad._labels("some.h5ad", "obs") == ["c1", "c2", "c3", "c4", "c5"]
    x.attrs = {"encoding-type": "csc_matrix"}
    with pytest.raises(ValueError, match="CSR"):
        reader.partitions()


def test_flow_keeps_its_stages(spark, sf_dir, tmp_path):
    m = fixtures.customer_parts_planted(spark, sf_dir)
    plain = table(dropout.dropout_test(m), "gene_id", "z", "q_value")
    out = flow.run(spark, m, str(tmp_path))
    got = table(out["dropout_test"], "gene_id", "z", "q_value")
    assert got.keys() == plain.keys() and all(got[g] == pytest.approx(plain[g]) for g in got)
    assert out["high_variance"].columns[:1] == ["gene"] and out["volcano_labels"].count() == 10
    text = spark.read.option("header", True).csv(f"{tmp_path}/dropout.csv")
    assert {"Gene", "p.value", "q.value"} <= set(text.columns) and text.count() == out["dropout"].count() > 0
    # a finished stage is taken as it is, a missing one is made
    spark.createDataFrame([(1,)], "gene_id long").write.mode("overwrite").parquet(f"{tmp_path}/mask")
    assert flow.run(spark, m, str(tmp_path))["mask"].count() == 1
    assert not finished(spark, f"{tmp_path}/nothing")


def test_a_fitted_matrix_reads_its_entries_once(spark, sf_dir):
    m = fitted(fixtures.customer_parts_planted(spark, sf_dir), write_counts=True)
    for result in (dropout.dropout_test(m), dropout.compare_models(m), residuals.residual_moments(m)):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan
    plain = table(dropout.dropout_z(fixtures.customer_parts_planted(spark, sf_dir)), "gene_id", "z")
    got = table(dropout.dropout_z(m), "gene_id", "z")
    assert all(got[g] == pytest.approx(plain[g]) for g in plain)


def test_normalized_and_labels(spark):
    m = matrix(spark, [(0, 0, 3.0), (0, 1, 1.0), (1, 1, 0.0)], [0, 1, 2])
    assert sorted((r["cell_id"], r["gene_id"], r["value"]) for r in depth.normalized(m, 100.0).collect()) == [(0, 0, 75.0), (0, 1, 25.0), (1, 1, 0.0)]
    named = CountMatrix(m.counts, m.cells, spark.createDataFrame([(0, "a")], "gene_id long, gene string"))
    assert [tuple(r) for r in named.labelled(depth.gene_stats(m)).orderBy("gene_id").collect()] == [("a", 0, 3.0, 2), (None, 1, 1.0, 1)]
    assert m.labelled(depth.cell_stats(m)).columns == ["cell_id", "ti", "di"]


def shuffled_bytes(spark, df):
    spent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = spent()
    got = df.collect()
    time.sleep(1)
    return got, spent() - before


def wide_matrix(spark, cells, genes):
    """Few entries for many pairs, an empty cell, and genes that share their totals."""
    rng = np.random.default_rng(11)
    entries = sorted({(int(c), int(g)) for c, g in zip(rng.integers(1, cells, 900), rng.integers(0, genes, 900), strict=True)} | {(1, g) for g in range(genes)})
    return fitted(matrix(spark, [(c, g, float(1 + (c * g) % 7)) for c, g in entries], range(cells)))


@pytest.mark.parametrize(("cells", "genes"), [(400, 250), (250, 400)])
def test_pairs_are_not_shuffled(spark, cells, genes):
    m = wide_matrix(spark, cells, genes)
    x = {(r["cell_id"], r["gene_id"]): r["x"] for r in m.counts.collect()}
    pairs = cells * genes
    got, moved = shuffled_bytes(spark, residuals.pearson_residuals(m))
    assert {(r["cell_id"], r["gene_id"]): r["x"] for r in got} == {(c, g): x.get((c, g), 0.0) for c in range(cells) for g in range(genes)}
    assert len(got) == pairs and moved < 2 * pairs
    for value in ("x", "approx", "full"):
        rows = {}
        for r in got:
            rows.setdefault(r["cell_id"], {})[r["gene_id"]] = r[value]
        dense, moved = shuffled_bytes(spark, residuals.dense_residuals(m, value))
        assert {r["cell_id"]: list(r["values"]) for r in dense} == {c: [v[g] for g in sorted(v)] for c, v in rows.items()}
        assert moved < 2 * pairs


@pytest.mark.parametrize("value", ["approx", "full"])
def test_histogram_without_the_pairs(spark, value):
    m = wide_matrix(spark, 400, 250)
    plain = table(residuals.residual_histogram(residuals.pearson_residuals(m), value), "bin", "left", "density")
    got, moved = shuffled_bytes(spark, residuals.histogram(m, value))
    assert {r["bin"]: (r["left"], r["density"]) for r in got} == plain
    assert value == "full" or moved < 400 * 250


@pytest.mark.parametrize("rate", [0.02, 1.0])
def test_pairs_are_drawn_by_their_ids(spark, rate):
    m = wide_matrix(spark, 250, 400)
    want = sorted(map(tuple, residuals.residual_sample(residuals.pearson_residuals(m), rate, 7).collect()))
    got, moved = shuffled_bytes(spark, residuals.drawn_residuals(m, rate, 7))
    assert sorted(map(tuple, got)) == want and len(want) == pytest.approx(rate * 100_000, rel=0.1)
    assert rate == 1.0 or moved < 250 * 400
    assert residuals.drawn_residuals(m, 1e-17, 7).count() == 0


def test_rounding_of_all_pairs(spark):
    values = [0.0, -0.0, 1.0000005, -1.0000005, 2.5, -0.1234564, 0.1234567, -3e-7, 1e300, -7e8, float("nan"), float("inf"), None]
    t = spark.createDataFrame([(v,) for v in values], "v double").select("v", queries.r("a", of=F.col("v")), queries.rounded("b", F.col("v")))
    assert all(repr(row["a"]) == repr(row["b"]) for row in t.collect())


@pytest.fixture(scope="module")
def many_cells(spark, tmp_path_factory):
    """So many cells that no mean is above the trend's least: there is nothing to fit."""
    folder = str(tmp_path_factory.mktemp("cells"))
    lines = [(i % 4, i % 3, i % 2, 45.0 + i % 5, "R") for i in range(9)]
    tables = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"),
        "orders": spark.createDataFrame([(i, i) for i in range(4)], "o_orderkey long, o_custkey long"),
        "customer": spark.range(200_000).select(F.col("id").alias("c_custkey")),
        "supplier": spark.range(200_000).select(F.col("id").alias("s_suppkey")),
        "part": spark.range(3).select(F.col("id").alias("p_partkey"), F.lit("p").alias("p_name")),
    }
    for name, t in tables.items():
        t.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["dropout_z_empty", "dropout_test_empty", "select_dropout", "volcano", "volcano_labels", "model_comparison", "model_errors", "dispersion_curve", "high_variance", "expected_dropout_gene", "expected_dropout_cell"])
def test_queries_without_a_trend_give_what_sql_gives(spark, many_cells, name):
    check(spark, many_cells, queries.QUERIES[name], queries.ORACLES[name])


def test_hommel_of_many_tests_takes_no_quadratic_time():
    rng = np.random.default_rng(5)
    p = np.sort(rng.uniform(size=300_000) ** 3)
    began = time.time()
    q = corrections.hommel(p)
    assert time.time() - began < 20 and (np.diff(q) >= 0).all() and (q >= p).all()
    small = np.sort(np.round(rng.uniform(size=400) ** 2, 2))
    want = small.copy()
    for m in range(2, 401):
        bound = (m * small[400 - m :] / np.arange(1, m + 1)).min()
        want = np.maximum(want, np.where(np.arange(400) >= 400 - m, bound, np.minimum(bound, m * small)))
    assert corrections.hommel(small) == pytest.approx(np.minimum(want, 1.0), rel=1e-12)


def test_expected_dropout_meets_kinds_of_genes(spark):
    """Genes of equal totals meet the cells' totals once; the sums are those over all pairs."""
    m = wide_matrix(spark, 60, 90)
    fit = dispersion.fit_dispersion(m)
    cells, genes = depth.cell_stats(m), dispersion.smoothed(fit, dispersion.fit_trend(fit), 0.0)
    for few in (True, False):
        pairs = dropout._pairs(cells, genes.select("gene_id", "tj", "exp_size"), few)
        assert pairs.count() == genes.select("tj").distinct().count() * cells.select("ti").distinct().count() < 0.9 * 90 * cells.select("ti").distinct().count()
    ti, every = table(cells, "cell_id", "ti"), table(genes, "gene_id", "tj", "exp_size")
    total = sum(ti.values())
    p = {(c, g): (tj * t / total / es + 1.0) ** -es for c, t in ti.items() for g, (tj, es) in every.items()}
    by_gene, by_cell = dropout.expected_dropout(m, fit)
    assert table(by_gene, "gene_id", "p_sum") == pytest.approx({g: sum(p[c, g] for c in ti) for g in every})
    assert table(by_cell, "cell_id", "p_sum") == pytest.approx({c: sum(p[c, g] for g in every) for c in ti})
