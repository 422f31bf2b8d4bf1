"""Overlap of sets, batch mixing, run summaries and diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.functions.fixed import REQUIRED_META
from cellsift.functions.tails import chi2_tail


def set_pairs(sets: DataFrame, by=(), set_col: str = "cluster", member: str = "gene") -> DataFrame:
    """Every pair of sets a < b with intersection, overlap (by smaller set) and Jaccard.

    Members are first grouped by who owns them; pairs are then made per distinct
    owner list with its member count, not per member, so a member that every set
    holds costs no more than one that two sets hold.
    """
    by = list(by)
    flat = sets.select(*by, F.col(set_col).alias("_s"), F.col(member).alias("_m")).where("_s IS NOT NULL").distinct()
    held = flat.where("_m IS NOT NULL")
    owners = held.groupBy(*by, "_m").agg(F.array_sort(F.collect_set("_s")).alias("_o")).groupBy(*by, "_o").agg(
        F.count("*").alias("_n"))
    shared = (
        owners.where(F.size("_o") > 1)
        .select(*by, "_n", "_o", F.posexplode("_o").alias("_i", "a"))
        .select(*by, "_n", "a", F.explode(F.expr("slice(_o, _i + 2, size(_o))")).alias("b"))
        .groupBy(*by, "a", "b")
        .agg(F.sum("_n").alias("_both"))
    )
    sizes = flat.groupBy(*by, "_s").agg(F.count("_m").alias("_k"))
    listed = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_s", "_k"))).alias("_l"))
    pairs = (
        listed.select(*by, "_l", F.posexplode("_l").alias("_i", "_a"))
        .select(*by, "_a", F.explode(F.expr("slice(_l, _i + 2, size(_l))")).alias("_b"))
        .select(*by, F.col("_a._s").alias("a"), F.col("_a._k").alias("_ka"), F.col("_b._s").alias("b"), F.col("_b._k").alias("_kb"))
    )
    both = F.coalesce("_both", F.lit(0))
    return pairs.join(shared, [*by, "a", "b"], "left").select(
        *by, "a", "b", both.cast("long").alias("n_shared"),
        (both / F.greatest(F.least("_ka", "_kb"), F.lit(1))).alias("overlap"),
        (both / F.greatest(F.col("_ka") + F.col("_kb") - both, F.lit(1))).alias("jaccard"),
    )


def overlap_summary(sets: DataFrame, by=(), set_col: str = "cluster", member: str = "gene") -> DataFrame:
    """Number of sets, mean and largest overlap, mean Jaccard; zeros when there is one set."""
    by = list(by)
    n = sets.groupBy(*by).agg(F.count_distinct(set_col).alias("n_sets"))
    pairs = set_pairs(sets, by, set_col, member).groupBy(*by).agg(
        F.avg("overlap").alias("mean_overlap"), F.max("overlap").alias("max_overlap"), F.avg("jaccard").alias("mean_jaccard"))
    cols = ["mean_overlap", "max_overlap", "mean_jaccard"]
    if by:
        return n.join(pairs, by, "left").fillna(0.0, cols)
    return n.withColumn("_p", pairs.select(F.struct(*cols)).scalar()).select("n_sets", "_p.*").fillna(0.0, cols)


def overlap_matrix(sets: DataFrame, by=(), set_col: str = "cluster", member: str = "gene") -> DataFrame:
    """Symmetric (a, b, overlap) with 1 on the diagonal."""
    by = list(by)
    pairs = set_pairs(sets, by, set_col, member).select(*by, "a", "b", "overlap")
    diagonal = sets.where(F.col(set_col).isNotNull()).select(
        *by, F.col(set_col).alias("a"), F.col(set_col).alias("b"), F.lit(1.0).alias("overlap")).distinct()
    return pairs.unionByName(pairs.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "overlap")).unionByName(diagonal)


def unique_fraction(sets: DataFrame, by=(), set_col: str = "cluster", member: str = "gene") -> DataFrame:
    """Share of a set's members that no other set holds; an empty set counts as all unique."""
    by = list(by)
    flat = sets.select(*by, set_col, member).where(F.col(set_col).isNotNull()).distinct()
    owners = flat.where(F.col(member).isNotNull()).groupBy(*by, member).agg(F.count("*").alias("_o"))
    return flat.join(owners, [*by, member], "left").groupBy(*by, set_col).agg(
        (1 - F.count_if(F.col("_o") > 1) / F.greatest(F.count(member), F.lit(1))).alias("frac_unique"))


def unknown_overlap(gaps: DataFrame, cluster_genes: DataFrame) -> DataFrame:
    """Overlap among the clusters without candidates, with their count and share."""
    unknown = gaps.where("status = 'no_candidates'").select("cluster")
    sets = unknown.join(cluster_genes.select("cluster", "gene"), "cluster")
    part = set_pairs(sets).agg(F.coalesce(F.avg("overlap"), F.lit(0.0)).alias("m")).scalar()
    return gaps.agg(
        F.count_if(F.col("status") == "no_candidates").alias("n_unknown"),
        (F.count_if(F.col("status") == "no_candidates") / F.greatest(F.count("*"), F.lit(1))).alias("frac_unknown"),
    ).withColumn("mean_overlap", part)


def batch_mixing(labels: DataFrame, batch: str = "batch", cluster: str = "cluster") -> DataFrame:
    """Per cluster: entropy in bits, batches seen, largest share."""
    counts = labels.groupBy(cluster, batch).agg(F.count("*").alias("_n"))
    n = F.sum("_n")
    h = F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n
    return counts.groupBy(cluster).agg(
        F.greatest(h, F.lit(0.0)).alias("entropy"), F.count("*").alias("n_batches"), (F.max("_n") / n).alias("max_fraction"))


def contingency_chi2(labels: DataFrame, batch: str = "batch", cluster: str = "cluster") -> DataFrame:
    """Chi-square of the cluster x batch table; null below 2 x 2.

    Empty cells need no rows: sum (n - e)^2 / e = sum n^2 / e - N. Yates' correction
    applies to 2 x 2 tables only, which are small enough to spell out.
    """
    counts = labels.groupBy(F.col(cluster).alias("_c"), F.col(batch).alias("_b")).agg(F.count("*").alias("_n"))
    rows = counts.groupBy("_c").agg(F.sum("_n").alias("_r"))
    cols = counts.groupBy("_b").agg(F.sum("_n").alias("_k"))
    total = counts.agg(F.sum("_n")).scalar()
    shape = counts.agg(F.count_distinct("_c"), F.count_distinct("_b"))
    placed = counts.join(rows, "_c").join(cols, "_b").withColumn("_total", total)
    out = placed.agg(
        (F.sum(F.expr("CAST(_n AS double) * _n * _total / (CAST(_r AS double) * _k)")) - F.max("_total")).alias("_x"),
        F.count_distinct("_c").alias("n_clusters"), F.count_distinct("_b").alias("n_batches"),
        F.max("_total").alias("_total"), F.max(F.expr("struct(_c, _b, _n, _r, _k)")).alias("_cell"),
    )
    # For a 2 x 2 table all four |n - e| are equal, so one cell gives the correction.
    gap = F.expr("abs(_cell._n - CAST(_cell._r AS double) * _cell._k / _total)")
    yates = (F.pow(F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0)), 2) / F.pow(gap, 2))
    dof = (F.col("n_clusters") - 1) * (F.col("n_batches") - 1)
    return (
        out.withColumn("dof", dof)
        .withColumn("yates", F.col("dof") == 1)
        .withColumn("chi2", F.when(F.col("dof") > 0, F.when(F.col("yates") & (gap > 0), F.col("_x") * yates).otherwise(F.col("_x"))))
        .withColumn("p", chi2_tail("chi2", F.when(F.col("dof") > 0, F.col("dof"))))
        .select("chi2", "dof", "p", "yates", "n_clusters", "n_batches")
    )


def mixing_index(labels: DataFrame, batch: str = "batch", cluster: str = "cluster") -> DataFrame:
    """Mean cluster entropy over the largest possible one; a single batch divides by 1."""
    n = labels.select(F.count_distinct(batch)).scalar()
    return batch_mixing(labels, batch, cluster).agg(F.avg("entropy").alias("_e")).withColumn("_n", n).select(
        (F.col("_e") / F.when(F.col("_n") > 1, F.log2("_n")).otherwise(1.0)).alias("mixing_index"), F.col("_n").alias("n_batches"))


def delivered(gaps: DataFrame) -> DataFrame:
    """Label a cluster would get: its first type, or unknown."""
    return gaps.withColumn("label", F.coalesce(F.when(F.col("status") != "no_candidates", F.col("first_type")), F.lit("unknown")))


def global_summary(labelled: DataFrame, top_summary: DataFrame | None = None, cluster_genes: DataFrame | None = None) -> DataFrame:
    """Clusters, unknowns, distinct labels, diversity, entropy and its exponential, means, shared markers."""
    per_label = labelled.groupBy("label").agg(F.count("*").alias("_n"))
    n = F.sum("_n")
    h = F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n
    out = per_label.agg(
        n.alias("n_clusters"),
        F.sum(F.when(F.col("label") == "unknown", F.col("_n")).otherwise(0)).alias("n_unknown"),
        F.count("*").alias("n_unique_labels"),
        F.greatest(h, F.lit(0.0)).alias("label_entropy"),
    ).select(
        "*", (F.col("n_unknown") / F.greatest("n_clusters", F.lit(1))).alias("unknown_rate"),
        (F.col("n_unique_labels") / F.greatest("n_clusters", F.lit(1))).alias("label_diversity"),
        F.pow(F.lit(2.0), "label_entropy").alias("effective_n_types"),
    )
    out = out.withColumn("mean_count_ratio", labelled.agg(F.avg("count_ratio")).scalar())
    if top_summary is not None:
        out = out.withColumn("mean_top_specificity", top_summary.agg(F.avg("mean_top_specificity")).scalar())
    if cluster_genes is not None:
        owners = cluster_genes.select("cluster", "gene").distinct().groupBy("gene").agg(F.count("*").alias("_o")).where("_o > 1")
        reuse = owners.agg(F.struct(F.count("*").alias("n_shared_markers"), F.coalesce(F.max("_o"), F.lit(0)).alias("max_owners")))
        out = out.withColumn("_r", reuse.scalar()).select("*", "_r.*").drop("_r")
    return out


def label_clusters(labelled: DataFrame) -> DataFrame:
    """(label, clusters, share): which clusters carry a label."""
    total = labelled.select(F.count("*")).scalar()
    return labelled.groupBy("label").agg(
        F.array_sort(F.collect_list("cluster")).alias("clusters"), (F.count("*") / total).alias("share"))


def marker_reuse(cluster_genes: DataFrame) -> DataFrame:
    """Genes that mark more than one cluster."""
    return cluster_genes.select("cluster", "gene").distinct().groupBy("gene").agg(F.count("*").alias("n_owners")).where("n_owners > 1")


def cluster_diagnosis(hit_counts: DataFrame, gaps: DataFrame, mixing: DataFrame) -> DataFrame:
    """Per cluster: hit rate, candidates, first and second support, strictly ahead, batch entropy."""
    return (
        gaps.join(hit_counts, "cluster", "left").join(mixing.select("cluster", "entropy"), "cluster", "left")
        .select(
            "cluster", (F.coalesce("n_markers_hit", F.lit(0)) / F.greatest(F.coalesce("n_markers", F.lit(0)), F.lit(1))).alias("hit_rate"),
            "n_candidates", "first_count", "second_count", (F.col("first_count") > F.col("second_count")).alias("strictly_ahead"),
            F.col("entropy").alias("batch_entropy"),
        )
    )


def cross_cluster(diagnosis: DataFrame, labelled: DataFrame, cluster_genes: DataFrame, labels: DataFrame, silhouette: DataFrame | None = None) -> DataFrame:
    """One row over all clusters: label uniqueness and entropy, mean gap, overlap, chi-square, hit rate."""
    s = global_summary(labelled).select("n_unique_labels", "n_clusters", "label_entropy")
    out = s.select(
        (F.col("n_unique_labels") / F.greatest("n_clusters", F.lit(1))).alias("label_uniqueness"), F.col("label_entropy").alias("annotation_entropy"))
    d = diagnosis.agg(F.struct(
        F.avg(F.col("first_count") - F.col("second_count")).alias("mean_first_count_gap"), F.avg("hit_rate").alias("mean_hit_rate"),
        F.count_if(F.col("n_candidates") == 0).alias("n_clusters_no_candidates")))
    out = out.withColumn("_d", d.scalar()).select("*", "_d.*").drop("_d")
    out = out.withColumn("mean_marker_overlap", overlap_summary(cluster_genes).select("mean_overlap").scalar())
    out = out.withColumn("chi2", contingency_chi2(labels).select("chi2").scalar())
    if silhouette is not None:
        out = out.withColumn("cluster_purity_proxy", silhouette.agg(F.avg("silhouette")).scalar())
    return out


def metadata_check(meta: DataFrame) -> DataFrame:
    """Required fields that are missing or null in (field, value)."""
    want = meta.sparkSession.createDataFrame([(f,) for f in REQUIRED_META], "field string")
    return want.join(meta.where("value IS NOT NULL").select("field"), "field", "left_anti")
