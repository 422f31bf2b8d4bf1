"""One-vs-rest differential expression on sparse rows, pseudobulk, marker filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.functions.tails import chi2_1_upper, normal_two_sided, t_tail
from cellsift.operators.distribution import describe
from cellsift.operators.running import running

MEDIAN_CHI2_1 = 0.4549


def gene_cluster_stats(
    expr: DataFrame,
    labels: DataFrame,
    value: str = "norm",
    by=(),
    cell: str = "cell_id",
    gene: str = "gene_id",
    cluster: str = "cluster",
) -> DataFrame:
    """Sums, non-zero counts and rank sum of every gene inside and outside every cluster.

    ``labels`` is (by, cell, cluster), one row per cell and ``by`` group; it fixes
    the universe, so cells without a stored value count as zeros. All zeros of a
    gene form one tie block below the positive values, hence nothing is densified:
    equal values of a gene are merged first, ranked by a running count, and the
    zero block is added in closed form.
    """
    by = list(by)
    named = labels.select(*by, cell, F.col(cluster).alias("_c"))
    sizes = named.groupBy(*by, "_c").agg(F.count("*").alias("_n"))
    cells = sizes.groupBy(*by).agg(
        F.collect_list(F.struct("_c", "_n")).alias("_clusters"), F.sum("_n").alias("_cells")
    )
    blocks = (
        expr.where(F.col(value) > 0)
        .select(cell, F.col(gene).alias("_g"), F.col(value).cast("double").alias("_v"))
        .join(named, cell)
        .groupBy(*by, "_g", "_v", "_c")
        .agg(F.count("*").alias("_k"))
        .groupBy(*by, "_g", "_v")
        .agg(F.sum("_k").alias("_k"), F.collect_list(F.struct("_c", "_k")).alias("_parts"))
    )
    ranked = running(blocks, [*by, "_g"], ["_v"], {"_hi": ("sum", "_k")}, {"_nnz": ("sum", "_k")})
    inside = (
        ranked.select(*by, "_g", "_v", "_k", "_hi", "_nnz", F.explode("_parts").alias("_p"))
        .groupBy(*by, "_g", "_p._c")
        .agg(
            F.sum("_p._k").alias("nnz"),
            F.sum(F.expr("_p._k * (_hi - (_k - 1) / 2)")).alias("rank"),
            F.sum(F.expr("_p._k * _v")).alias("s"),
            F.sum(F.expr("_p._k * _v * _v")).alias("q"),
            F.max("_nnz").alias("_nnz"),
        )
    )
    per_gene = inside.groupBy(*by, "_g").agg(
        F.map_from_entries(F.collect_list(F.struct("_c", F.struct("nnz", "rank", "s", "q")))).alias("_in"),
        F.max("_nnz").alias("_nnz"),
        F.sum("s").alias("_s"),
        F.sum("q").alias("_q"),
    )
    if by:
        grid = per_gene.join(cells, by)
    else:
        grid = per_gene.withColumn("_u", cells.select(F.struct("_clusters", "_cells")).scalar()).select("*", "_u.*")
    return (
        grid.select("*", F.explode("_clusters").alias("_one"))
        .withColumn("_x", F.try_element_at("_in", F.col("_one._c")))
        .selectExpr(
            *by,
            f"_g AS {gene}",
            f"_one._c AS {cluster}",
            "_one._n AS n_in",
            "_cells - _one._n AS n_out",
            "coalesce(_x.nnz, 0L) AS nnz_in",
            "_nnz - coalesce(_x.nnz, 0L) AS nnz_out",
            "coalesce(_x.s, 0D) AS sum_in",
            "_s - coalesce(_x.s, 0D) AS sum_out",
            "coalesce(_x.q, 0D) AS sq_in",
            "_q - coalesce(_x.q, 0D) AS sq_out",
            """(_one._n - coalesce(_x.nnz, 0L)) * (_cells - _nnz + 1) / 2
               + coalesce(_x.nnz, 0L) * (_cells - _nnz) + coalesce(_x.rank, 0D) AS rank_sum""",
        )
    )


def gene_auc(stats: DataFrame) -> DataFrame:
    """Rank AUC; null when either side is empty."""
    return stats.withColumn(
        "auc", F.expr("IF(n_in = 0 OR n_out = 0, NULL, (rank_sum / n_in - (n_in + 1) / 2) / n_out)")
    )


def pct_in_out(stats: DataFrame) -> DataFrame:
    """Share of expressing cells inside and outside, 0 when there is no outside."""
    return stats.withColumns(
        {
            "pct1": F.expr("try_divide(nnz_in, n_in)"),
            "pct2": F.expr("coalesce(try_divide(nnz_out, n_out), 0D)"),
        }
    ).withColumn("pct1_minus_pct2", F.col("pct1") - F.col("pct2"))


def effect_size(stats: DataFrame) -> DataFrame:
    """Means, Cohen's d, AUC, fold change, log2 ratio of (mean + 1).

    Without an outside d is 0 and the rest null.
    """
    return gene_auc(stats).selectExpr(
        "*",
        "sum_in / n_in AS mean_in",
        "coalesce(try_divide(sum_out, n_out), 0D) AS mean_out",
    ).selectExpr(
        "*",
        """sqrt((greatest(sq_in / n_in - mean_in * mean_in, 0D)
                 + greatest(coalesce(try_divide(sq_out, n_out), 0D) - mean_out * mean_out, 0D)) / 2) AS _pool""",
    ).selectExpr(
        "* EXCEPT (_pool)",
        "IF(n_out = 0 OR _pool <= 1e-12D, 0D, (mean_in - mean_out) / _pool) AS cohen_d",
        "IF(n_out = 0, NULL, mean_in / greatest(mean_out, 1e-6D)) AS fold_change",
        "IF(n_out = 0, NULL, log2((mean_in + 1) / (mean_out + 1))) AS log_ratio",
    )


def bh_fdr(df: DataFrame, p: str, by, tie: str, out: str = "pval_adj", bounded: bool = False) -> DataFrame:
    """Benjamini-Hochberg over all rows of a group; ``tie`` makes the order unique."""
    up = running(
        df.withColumn("_one", F.lit(1).cast("long")), by, [p, tie], {"_rank": ("sum", "_one")},
        {"_m": ("sum", "_one")}, bounded=bounded,
    ).withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    down = running(up, by, [F.col(p).desc(), F.col(tie).desc()], {"_adj": ("min", "_q")}, bounded=bounded)
    return down.withColumn(out, F.least("_adj", F.lit(1.0))).drop("_one", "_rank", "_m", "_q", "_adj")


def rank_sum_scores(stats: DataFrame) -> DataFrame:
    """z of the rank sum (no tie term) and log2 fold change of expm1 means."""
    return stats.where("n_in >= 2 AND n_out > 0").selectExpr(
        "*",
        """(rank_sum - n_in * (n_in + n_out + 1) / 2)
           / sqrt(CAST(n_in AS double) * n_out * (n_in + n_out + 1) / 12) AS score""",
        "log2((expm1(sum_in / n_in) + 1e-9D) / (expm1(sum_out / n_out) + 1e-9D)) AS logfc",
    )


def rank_genes(
    expr: DataFrame, labels: DataFrame, top: int | None = 500, value: str = "norm", by=(), cell: str = "cell_id",
    gene: str = "gene_id", cluster: str = "cluster",
) -> DataFrame:
    """Top genes per cluster (None: all) by rank-sum score with p, BH-adjusted p, AUC and pct columns.

    p is adjusted over all genes, before the cut. Clusters of one cell are skipped.
    """
    keys = [*by, cluster]
    stats = gene_cluster_stats(expr, labels, value, by, cell, gene, cluster)
    scored = pct_in_out(gene_auc(rank_sum_scores(stats))).withColumn("pval", normal_two_sided("score"))
    adjusted = bh_fdr(scored, "pval", keys, gene)
    if top is None:
        ranked = running(
            adjusted.withColumns({"_down": -F.col("score"), "_one": F.lit(1)}), keys, ["_down", gene], {"rank": ("sum", "_one")}
        ).withColumn("rank", F.col("rank").cast("int"))
    else:
        w = W.partitionBy(*keys).orderBy(F.col("score").desc(), gene)
        ranked = adjusted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return (
        ranked.select(*keys, gene, "rank", "score", "logfc", "pval", "pval_adj", "auc", "pct1", "pct2", "pct1_minus_pct2")
    )


def inflation_lambda(de: DataFrame, by=("cluster",), p: str = "pval") -> DataFrame:
    """Median chi-square of the p-values in (0, 1) over its expected median."""
    chi = de.where((F.col(p) > 0) & (F.col(p) < 1)).withColumn("_chi", chi2_1_upper(p))
    return describe(chi, "_chi", list(by), compact=False).select(
        *by, (F.col("median") / MEDIAN_CHI2_1).alias("inflation_lambda")
    )


def de_summary(de: DataFrame, by=("cluster",)) -> DataFrame:
    """Significant counts, gaps between the first three fold changes, share above 0."""
    at = [F.max(F.when(F.col("rank") == i, F.col("logfc"))).alias(f"_l{i}") for i in (1, 2, 3)]
    return de.groupBy(*by).agg(
        *[F.count_if(F.col("pval_adj") < t).alias(f"n_fdr_{str(t)[2:]}") for t in (0.05, 0.01, 0.001)],
        F.avg((F.col("logfc") > 0).cast("int")).alias("frac_positive_logfc"),
        *at,
    ).select(
        *by, "n_fdr_05", "n_fdr_01", "n_fdr_001", "frac_positive_logfc",
        F.when(F.col("_l3").isNotNull(), F.col("_l1") - F.col("_l2")).alias("gap_1_2"),
        (F.col("_l2") - F.col("_l3")).alias("gap_2_3"),
    )


def pct_summary(de: DataFrame, by=("cluster",), first: int = 50) -> DataFrame:
    """describe() of pct1, pct2 and their difference, and the mean difference of the first genes."""
    from cellsift.operators.qc import melt

    long = melt(de, ("pct1", "pct2", "pct1_minus_pct2"), *by)
    head = de.where(F.col("rank") <= first).groupBy(*by).agg(F.avg("pct1_minus_pct2").alias("mean_specificity_of_top"))
    return describe(long, "value", [*by, "variable"]).join(head, list(by))


def filter_markers(
    de: DataFrame, min_pct1: float = 0.5, max_pct1: float = 0.9, min_diff: float = 0.25, top_n: int = 30,
    by=("cluster",), pseudobulk: DataFrame | None = None, gene: str = "gene_id",
) -> DataFrame:
    """Add ``status`` (kept / grey / dropped) and ``marker_rank``, set on the first top_n kept rows.

    A cluster named in ``pseudobulk`` (by, gene, rank) keeps the genes of that list instead.
    """
    by = list(by)
    rows = de.withColumns(
        {
            "_min": F.col("pct1") >= min_pct1,
            "_max": F.col("pct1") <= max_pct1,
            "_spec": F.col("pct1_minus_pct2") >= min_diff,
        }
    )
    kept = F.coalesce(F.col("_min") & F.col("_max") & F.col("_spec"), F.lit(False))
    grey = (F.col("pct1_minus_pct2") >= 0.1) & (F.col("pct1_minus_pct2") < min_diff)
    if pseudobulk is not None:
        listed = pseudobulk.where(F.col("rank") <= 500).select(*by, gene, F.lit(True).alias("_hit"))
        rare = pseudobulk.select(*by, F.lit(True).alias("_rare")).distinct()
        rows = rows.join(rare, by, "left").join(listed, [*by, gene], "left")
        kept = F.when(F.col("_rare"), F.coalesce("_hit", F.lit(False))).otherwise(kept)
        grey = grey & F.col("_rare").isNull()
    marked = rows.withColumn("status", F.when(kept, "kept").when(grey, "grey").otherwise("dropped"))
    # DE tables are cut to their top genes, so a cluster's rows are bounded.
    w = W.partitionBy(*by, "status").orderBy("rank")
    return (
        marked.withColumn("_m", F.row_number().over(w))
        .withColumn("marker_rank", F.when((F.col("status") == "kept") & (F.col("_m") <= top_n), F.col("_m")))
        .drop("_m", "_rare", "_hit")
    )


def marker_report(filtered: DataFrame, labels: DataFrame, cluster: str = "cluster", rare_threshold: float = 0.05) -> DataFrame:
    """Funnel, grey zone, efficiency and rarity per cluster."""
    sizes = labels.groupBy(cluster).agg(F.count("*").alias("_cells"))
    total = sizes.agg(F.sum("_cells")).scalar()
    return (
        filtered.groupBy(cluster)
        .agg(
            F.count("*").alias("n_before"),
            F.count_if("_min").alias("pct1_min_passed"),
            F.count_if(F.col("_min") & F.col("_max")).alias("pct1_max_left"),
            F.count_if(F.col("status") == "kept").alias("n_passed"),
            F.count("marker_rank").alias("n_markers"),
            F.count_if(F.col("status") == "grey").alias("n_grey"),
        )
        .join(sizes, cluster)
        .select(
            cluster, "n_before", "pct1_min_passed", "pct1_max_left", "n_passed", "n_markers", "n_grey",
            (F.col("n_markers") / F.greatest("n_before", F.lit(1))).alias("filter_efficiency"),
            (F.col("n_grey") / F.greatest("n_before", F.lit(1))).alias("grey_rate"),
            (F.col("_cells") / total < rare_threshold).alias("is_rare"),
        )
    )


def pseudobulk_de(
    counts: DataFrame, labels: DataFrame, sample: str = "batch", min_samples: int = 2, top: int = 500,
    rare_threshold: float | None = None, cell: str = "cell_id", gene: str = "gene_id", cluster: str = "cluster",
    count: str = "count",
) -> DataFrame:
    """Sum raw counts per (sample, side), log1p CPM, Welch t per gene, BH, order by p.

    A sample's outside is its total minus its inside, so the counts are summed
    once per (cluster, sample, gene) and never copied per cluster. Zeros enter
    through the number of samples on each side.
    """
    keep = labels.select(cell, F.col(cluster).alias("_c"), F.col(sample).alias("_s"))
    sizes = keep.groupBy("_c", "_s").agg(F.count("*").alias("_k"))
    per_sample = sizes.groupBy("_s").agg(F.sum("_k").alias("_ks"))
    per_cluster = sizes.groupBy("_c").agg(F.sum("_k").alias("_kc"))
    wanted = per_cluster.where("_kc > 0")
    if rare_threshold is not None:
        total = keep.select(F.count("*")).scalar()
        wanted = wanted.where(F.col("_kc") / total < rare_threshold)
    # Samples on each side: inside where the cluster has cells, outside where others have.
    pairs = (
        wanted.select("_c")
        .withColumn("_all", per_sample.select(F.collect_list(F.struct("_s", "_ks"))).scalar())
        .select("_c", F.explode("_all").alias("_a"))
        .select("_c", "_a.*")
        .join(sizes, ["_c", "_s"], "left")
        .selectExpr("_c", "_s", "coalesce(_k, 0L) > 0 AS _has_in", "_ks - coalesce(_k, 0L) > 0 AS _has_out")
    )
    sides = pairs.groupBy("_c").agg(
        F.count_if("_has_in").alias("_ni"), F.count_if("_has_out").alias("_no")
    ).where((F.col("_ni") >= min_samples) & (F.col("_no") >= min_samples))

    inner = (
        counts.select(cell, F.col(gene).alias("_g"), F.col(count).alias("_x"))
        .join(keep, cell)
        .groupBy("_c", "_s", "_g")
        .agg(F.sum("_x").alias("_in"))
    )
    whole = inner.groupBy("_s", "_g").agg(F.sum("_in").alias("_both"))
    # Every (cluster, sample, gene) with a count on either side, from the sample totals.
    cube = (
        pairs.join(sides, "_c")
        .join(whole, "_s")
        .join(inner, ["_c", "_s", "_g"], "left")
        .selectExpr("_c", "_s", "_g", "_ni", "_no", "_has_in", "_has_out", "coalesce(_in, 0D) AS _in",
                    "_both - coalesce(_in, 0D) AS _out")
    )
    lib = cube.groupBy("_c", "_s").agg(F.sum("_in").alias("_li"), F.sum("_out").alias("_lo"))
    sums = (
        cube.join(lib, ["_c", "_s"])
        .selectExpr("_c", "_g", "_ni", "_no", "IF(_has_in, log1p(_in / (_li + 1e-9D) * 1e6D), 0D) AS _a",
                    "IF(_has_out, log1p(_out / (_lo + 1e-9D) * 1e6D), 0D) AS _b")
        .groupBy("_c", "_g", "_ni", "_no")
        .agg(F.sum("_a").alias("_sa"), F.sum(F.expr("_a * _a")).alias("_qa"),
             F.sum("_b").alias("_sb"), F.sum(F.expr("_b * _b")).alias("_qb"))
    )
    moments = sums.selectExpr(
        "*", "_sa / _ni AS _ma", "_sb / _no AS _mb",
    ).selectExpr(
        "*",
        "greatest(try_divide(_qa - _ni * _ma * _ma, _ni - 1), 0D) / _ni AS _va",
        "greatest(try_divide(_qb - _no * _mb * _mb, _no - 1), 0D) / _no AS _vb",
    ).selectExpr(
        "_c", "_g", "_ni", "_ma - _mb AS logfc",
        "IF(_va + _vb > 1e-18D, (_ma - _mb) / sqrt(_va + _vb), NULL) AS t",
        "try_divide(power(_va + _vb, 2), try_divide(_va * _va, _ni - 1) + try_divide(_vb * _vb, _no - 1)) AS df",
    )
    tested = moments.withColumn("pval", F.coalesce(t_tail("t", "df"), F.lit(1.0)))
    adjusted = bh_fdr(tested, "pval", ["_c"], "_g")
    w = W.partitionBy("_c").orderBy("pval", "_g")
    return (
        adjusted.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top)
        .select(F.col("_c").alias(cluster), F.col("_g").alias(gene), "rank", "logfc", "t", "df", "pval", "pval_adj",
                F.col("_ni").alias("n_samples"))
    )


def merge_pseudobulk(de: DataFrame, pb: DataFrame, cluster: str = "cluster", gene: str = "gene_id") -> DataFrame:
    """Rare clusters take their pseudobulk rows; their AUC and pct columns become null."""
    shared = [cluster, gene, "rank", "logfc", "pval", "pval_adj"]
    rest = [c for c in ("auc", "pct1", "pct2", "pct1_minus_pct2") if c in de.columns]
    kept = de.select(*shared, *rest).join(pb.select(cluster).distinct(), cluster, "left_anti")
    return kept.withColumn("de_method", F.lit("wilcoxon")).unionByName(
        pb.select(*shared, *[F.lit(None).cast("double").alias(c) for c in rest], F.lit("pseudobulk").alias("de_method"))
    )


def marker_expression(
    stats: DataFrame, markers: DataFrame, top: int = 3, gene: str = "gene_id", cluster: str = "cluster"
) -> DataFrame:
    """pct, means, ratio and effect sizes of each cluster's top markers."""
    wanted = markers.where(F.col("marker_rank") <= top).select(cluster, gene, "marker_rank")
    return effect_size(pct_in_out(stats.join(wanted, [cluster, gene]))).selectExpr(
        cluster, gene, "marker_rank", "pct1", "pct2", "pct1_minus_pct2 AS specificity", "mean_in AS mean_expr",
        "mean_out AS mean_expr_other", "mean_in / greatest(mean_out, 1e-6D) AS expression_ratio", "cohen_d", "auc",
        "fold_change", "log_ratio",
    )


def marker_expression_summary(top_rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    return top_rows.groupBy(cluster).agg(
        F.avg("pct1").alias("mean_top_pct1"),
        F.avg("specificity").alias("mean_top_specificity"),
        F.avg((F.col("pct1") > 0.5).cast("int")).alias("frac_pct1_above_half"),
    )


def marker_overlap_score(markers: DataFrame, support: DataFrame, cluster: str = "cluster", gene: str = "gene_id") -> DataFrame:
    """|DE markers found among the supporting genes| / |supporting genes| per cluster.

    Near 1 by construction when the candidates came from the same markers.
    """
    sup = support.select(cluster, gene).distinct()
    de = markers.where(F.col("marker_rank").isNotNull()).select(cluster, gene, F.lit(1).alias("_de")).distinct()
    return sup.join(de, [cluster, gene], "left").groupBy(cluster).agg(
        (F.count("_de") / F.count("*")).alias("marker_overlap_score")
    )
