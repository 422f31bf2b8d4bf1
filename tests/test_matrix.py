import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellsift.operators import markers as mk
from cellsift.operators import normalize as nz
from cellsift.operators import qc
from cellsift.operators import summaries as sm
from cellsift.sources import guards


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(3)
    x = rng.poisson(0.7, (60, 12)).astype(float)
    x[:20, 0] += 3
    x[:, 11] = 0
    x[0, 11] = 2
    return x, np.array(["a"] * 20 + ["b"] * 25 + ["c"] * 15), np.array([f"s{i % 4}" for i in range(60)])


@pytest.fixture(scope="module")
def tables(spark, dense):
    x, lab, bat = dense
    i, j = np.nonzero(x)
    expr = spark.createDataFrame(pd.DataFrame({"cell_id": [f"c{v}" for v in i], "gene_id": [f"g{v:02d}" for v in j], "count": x[i, j]}))
    labels = spark.createDataFrame(pd.DataFrame({"cell_id": [f"c{v}" for v in range(60)], "cluster": lab, "batch": bat}))
    return expr, labels


def _ranks(col):
    return pd.Series(col).rank().to_numpy()


def test_rank_sum_with_implicit_zeros(tables, dense):
    x, lab, _ = dense
    expr, labels = tables
    got = mk.effect_size(mk.pct_in_out(mk.gene_cluster_stats(expr, labels, "count"))).toPandas().set_index(["cluster", "gene_id"])
    assert len(got) == 3 * 12
    for j in range(12):
        r = _ranks(x[:, j])
        for c in "abc":
            m, row = lab == c, got.loc[(c, f"g{j:02d}")]
            assert row["rank_sum"] == pytest.approx(r[m].sum())
            assert row["auc"] == pytest.approx((r[m].mean() - (m.sum() + 1) / 2) / (~m).sum())
            assert row["pct1"] == pytest.approx((x[m, j] > 0).mean())
            pool = np.sqrt((x[m, j].var() + x[~m, j].var()) / 2)
            assert row["cohen_d"] == pytest.approx((x[m, j].mean() - x[~m, j].mean()) / pool, abs=1e-9)
            assert row["log_ratio"] == pytest.approx(np.log2((x[m, j].mean() + 1) / (x[~m, j].mean() + 1)))


def test_rank_genes_finds_the_marker(tables):
    expr, labels = tables
    de = mk.rank_genes(nz.normalize_log(expr), labels, top=5)
    first = de.where("rank = 1 AND cluster = 'a'").first()
    assert first["gene_id"] == "g00" and first["pval"] < 1e-3 and first["pval_adj"] >= first["pval"]
    assert de.groupBy("cluster").count().toPandas()["count"].tolist() == [5, 5, 5]


def test_single_cluster_has_no_outside(spark, tables):
    expr, labels = tables
    one = mk.effect_size(mk.pct_in_out(mk.gene_cluster_stats(expr, labels.withColumn("cluster", F.lit("x")), "count"))).first()
    assert one["cohen_d"] == 0 and one["auc"] is None and one["fold_change"] is None and one["pct2"] == 0


def test_bh_is_monotone_and_capped(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.9]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(p)], "k string, i int, p double")
    got = [r["pval_adj"] for r in mk.bh_fdr(df, "p", ["k"], "i").orderBy("i").collect()]
    want = np.minimum.accumulate((np.array(p) * 10 / np.arange(1, 11))[::-1])[::-1]
    assert got == pytest.approx(np.minimum(want, 1))


def test_pseudobulk_sums_each_side(tables, dense):
    x, lab, bat = dense
    expr, labels = tables
    got = mk.pseudobulk_de(expr, labels, sample="batch").toPandas().set_index(["cluster", "gene_id"])
    inside, outside = [], []
    for s in np.unique(bat):
        for m, into in ((lab == "a", inside), (lab != "a", outside)):
            v = x[m & (bat == s)].sum(0)
            into.append(np.log1p(v / (v.sum() + 1e-9) * 1e6))
    a, b = np.array(inside), np.array(outside)
    va, vb = a.var(0, ddof=1) / 4, b.var(0, ddof=1) / 4
    t = (a.mean(0) - b.mean(0)) / np.sqrt(va + vb)
    for j in range(11):
        assert got.loc[("a", f"g{j:02d}"), "t"] == pytest.approx(t[j], rel=1e-6)
    assert (got["pval"] > 0).all() and (got["pval"] <= 1).all()


def test_merge_pseudobulk_replaces_rare_clusters(spark):
    de = spark.createDataFrame([("a", "g", 1, 1.0, 0.1, 0.1, 0.9, 0.5, 0.1, 0.4), ("b", "g", 1, 1.0, 0.1, 0.1, 0.9, 0.5, 0.1, 0.4)],
                               "cluster string, gene_id string, rank int, logfc double, pval double, pval_adj double, auc double, pct1 double, pct2 double, pct1_minus_pct2 double")
    pb = spark.createDataFrame([("b", "h", 1, 2.0, 0.2, 0.2)], "cluster string, gene_id string, rank int, logfc double, pval double, pval_adj double")
    got = {r["cluster"]: r for r in mk.merge_pseudobulk(de, pb).collect()}
    assert got["b"]["gene_id"] == "h" and got["b"]["auc"] is None and got["a"]["de_method"] == "wilcoxon"
    marked = mk.filter_markers(de, pseudobulk=pb).collect()
    assert {(r["cluster"], r["status"]) for r in marked} == {("a", "kept"), ("b", "dropped")}


def test_filter_markers_statuses(spark):
    rows = [("a", "k", 1, 0.8, 0.1), ("a", "g", 2, 0.6, 0.45), ("a", "d", 3, 0.95, 0.9), ("a", "k2", 4, 0.7, 0.2)]
    de = spark.createDataFrame([(*r, r[3] - r[4]) for r in rows], "cluster string, gene_id string, rank int, pct1 double, pct2 double, pct1_minus_pct2 double")
    got = {r["gene_id"]: (r["status"], r["marker_rank"]) for r in mk.filter_markers(de, top_n=1).collect()}
    assert got == {"k": ("kept", 1), "g": ("grey", None), "d": ("dropped", None), "k2": ("kept", None)}


def test_qc_and_filters(spark):
    expr = spark.createDataFrame([("c1", "MT-A", 2.0), ("c1", "ATCG1", 1.0), ("c1", "x", 1.0), ("c2", "x", 4.0)], "cell_id string, gene_id string, count double")
    m = {r["cell_id"]: r for r in qc.qc_metrics(expr, {"mt": qc.MITO_PATTERN, "cp": qc.CHLORO_PATTERN}).collect()}
    assert m["c1"]["pct_mt"] == 50 and m["c1"]["pct_cp"] == 25 and m["c1"]["n_genes"] == 3 and m["c2"]["pct_mt"] == 0
    metrics = qc.qc_metrics(expr, {"mt": qc.MITO_PATTERN, "cp": qc.CHLORO_PATTERN})
    assert [r["cell_id"] for r in qc.filter_cells(metrics, min_genes=1).collect()] == ["c2"]
    masks = qc.gene_masks(qc.gene_breadth(expr), {"mt": qc.MITO_PATTERN, "cp": qc.CHLORO_PATTERN}, min_cells=1)
    assert [r["gene_id"] for r in masks.where("kept").collect()] == ["x"]
    funnel = qc.cell_funnel(metrics, min_genes=2, max_mt=60.0, max_cp=None).first()
    assert (funnel["n_after"], funnel["min_genes_lost"], funnel["max_mt_lost"]) == (1, 1, 0)


def test_guards(spark):
    schema = "cell_id string, gene_id string, count double"
    with pytest.raises(ValueError, match="number"):
        guards.check_matrix(spark.createDataFrame([("c", "1", 1.0), ("c", "2", 1.0)], schema))
    with pytest.raises(ValueError, match="zeros"):
        guards.check_matrix(spark.createDataFrame([("c", "g", 0.0)], schema))
    with pytest.raises(ValueError, match="empty"):
        guards.check_matrix(spark.createDataFrame([], schema))
    assert guards.resolve_batch_column(["orig.ident", "n"], "Orig.ident") == "orig.ident"
    assert guards.resolve_batch_column(["orig.ident", "n"]) == "orig.ident"
    with pytest.raises(ValueError, match="stale|current labels"):
        guards.stale_guard(spark.createDataFrame([("9",)], "cluster string"), spark.createDataFrame([("1",)], "cluster string"))


def test_variable_genes_prefer_the_noisy_one(spark):
    rng = np.random.default_rng(0)
    x = rng.gamma(5, 0.2, (200, 30))
    x[:, 7] = np.where(np.arange(200) % 10 == 0, 5.5, 0.5)
    i, j = np.nonzero(x)
    norm = spark.createDataFrame(pd.DataFrame({"cell_id": i, "gene_id": [f"g{v:02d}" for v in j], "norm": np.log1p(x[i, j])}))
    got = nz.select_variable_genes(norm, 200, n_top=3)
    assert got.where("highly_variable").count() == 3
    assert got.where("gene_id = 'g07'").first()["highly_variable"]


def test_percent_is_rounded_once(spark):
    expr = spark.createDataFrame([("c", "MT-1", 7.0), ("c", "g", 18.0)], "cell_id string, gene_id string, count double")
    # 100 * (7 / 25) is above 28, so the value would fall into the next bin.
    assert qc.qc_metrics(expr, {"mt": qc.MITO_PATTERN, "cp": qc.CHLORO_PATTERN}).first()["pct_mt"] == 28.0


def test_variable_genes_read_their_moments_once(spark):
    """Values that change with every reading: a gene alone in its bin still scores exactly 1, and picks follow the scores."""
    import random

    noisy = F.udf(lambda v: v + random.random() * 0.01, "double").asNondeterministic()
    rows = [(c, f"g{g}", float(1 + g + (c * (g + 3)) % 7)) for c in range(40) for g in range(12)]
    norm = spark.createDataFrame(rows, "cell_id int, gene_id string, v double").select("cell_id", "gene_id", noisy(F.log1p("v")).alias("norm"))
    got = nz.select_variable_genes(norm, 40, n_top=4, bins=500).collect()
    alone = [r for r in got if abs(r["dispersion_norm"] - 1) < 0.5]
    assert len(alone) >= 6 and {r["dispersion_norm"] for r in alone} == {1.0}
    order = sorted(got, key=lambda r: (-r["dispersion_norm"], r["gene_id"]))
    assert [r["highly_variable"] for r in order] == [True] * 4 + [False] * 8


def _pairs(spark, pairs=12, cells=64):
    """Twelve bins of two genes each: both score 1 / sqrt(2) from 0, so the upper ones tie."""
    rows = []
    for p in range(pairs):
        for side in range(2):
            name = f"g{(p * 5) % pairs:02d}{'ab'[side]}"
            for c in range(cells):
                value = 40.0 * 1.5**p * (1 + 0.01 * side) * (1 + (0.3 + 0.05 * ((p + side) % 3) + 0.037 * side) * ((c * 7 + p) % 5 - 2))
                rows.append((c, name, float(np.log1p(value))))
    return spark.createDataFrame(rows, "cell_id int, gene_id string, norm double")


def _tied(scored):
    return sorted(r["gene_id"] for r in scored if abs(r["dispersion_norm"] - 0.5**0.5) < 1e-8)


def test_variable_genes_of_bins_of_two_tie(spark):
    """The scores differ by rounding only, so names decide who is picked."""
    norm = _pairs(spark)
    got = nz.select_variable_genes(norm, 64, n_top=5, bins=60).collect()
    tied = _tied(got)
    assert len(tied) == 12 and len({r["dispersion_norm"] for r in got if r["gene_id"] in tied}) > 1
    assert sorted(r["gene_id"] for r in got if r["highly_variable"]) == tied[:5]
    cells = norm.select("cell_id", F.lit("x").alias("batch")).distinct()
    by = nz.select_variable_genes_by_batch(norm, cells, n_top=5, bins=60).collect()
    assert sorted(r["gene_id"] for r in by if r["highly_variable"]) == tied[:5]


def test_variable_distributions_follow_names(spark):
    """The means of the kept genes are those of the tied genes first by name."""
    got = nz.select_variable_genes(_pairs(spark), 64, n_top=5, bins=60)
    rows = got.collect()
    want = [r["mean"] for r in rows if r["gene_id"] in _tied(rows)[:5]]
    row = sm.variable_distributions(got).where("variable = 'mean'").first()
    assert (row["n"], row["mean"], row["max"]) == (5, pytest.approx(np.mean(want), rel=1e-5), pytest.approx(max(want), rel=1e-5))
