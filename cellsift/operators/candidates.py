"""Ranked candidate labels per cluster and what their order says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.functions.scalars import organ_class, organ_match, organ_priority
from cellsift.operators.distribution import describe


def rank_candidates(cluster_genes: DataFrame, hits: DataFrame, organ: str | None = None, by=("cluster",)) -> DataFrame:
    """One row per (cluster, cell type), ranked by organ status, support, confidence, name.

    ``cluster_genes`` is (by, gene, position). Hits are merged per (cluster, type,
    gene) before the second aggregation, so the lists that are collected hold at
    most a cluster's marker genes, whatever the graph's fan-out.
    """
    by = list(by)
    has_path = "source_path" in hits.columns
    target = organ if organ and organ.strip() else None
    matched = organ_match("organ", target) if target else F.lit(None).cast("boolean")
    usable = hits.withColumn("_match", matched).withColumn("_organ", F.when(F.col("organ") != "", F.col("organ")))
    paths = [F.collect_set("source_path").alias("_paths"), F.collect_set("ortholog_ref_species").alias("_species")]
    per_gene = (
        cluster_genes.select(*by, "gene", "position")
        .join(usable, "gene")
        .groupBy(*by, "cell_type", "gene")
        .agg(
            F.min("position").alias("_pos"),
            F.count("*").alias("_hits"),
            F.sum("confidence").alias("_conf"),
            F.min("confidence").alias("_low"),
            F.collect_set(F.coalesce("source", F.lit("?"))).alias("_sources"),
            F.collect_set("_organ").alias("_organs"),
            F.bool_or("_match").alias("_yes"),
            F.bool_or(~F.col("_match")).alias("_no"),
            *(paths if has_path else []),
        )
    )
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    per_type = per_gene.groupBy(*by, "cell_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "gene"))), lambda s: s["gene"]).alias("supporting_markers"),
        F.count("*").alias("marker_count"),
        (F.sum("_conf") / F.sum("_hits")).alias("mean_confidence"),
        F.min("_low").alias("min_confidence"),
        merged("_sources").alias("sources"),
        merged("_organs").alias("organs"),
        organ_class(F.bool_or("_yes"), F.bool_or("_no")).alias("organ_status"),
        *([merged("_paths").alias("source_paths"), merged("_species").alias("source_species")] if has_path else []),
    )
    # One row per type of the graph that the cluster hits: the group is small.
    # Rounding keeps the order of equal means independent of summation order.
    w = W.partitionBy(*by).orderBy(
        organ_priority("organ_status"), F.col("marker_count").desc(),
        F.round(F.coalesce("mean_confidence", F.lit(0.0)), 12).desc(), F.col("cell_type"),
    )
    return per_type.withColumn("rank", F.row_number().over(w))


def cluster_hits(cluster_genes: DataFrame, hits: DataFrame, by=("cluster",)) -> DataFrame:
    """Markers and hit markers per cluster, split by path when hits carry one."""
    by = list(by)
    if "source_path" in hits.columns:
        d, o = F.bool_or(F.col("source_path") == "direct"), F.bool_or(F.col("source_path") == "ortholog")
    else:
        d = o = F.lit(False)
    seen = hits.groupBy("gene").agg(F.count("*").alias("_h"), d.alias("_d"), o.alias("_o"))
    return (
        cluster_genes.join(seen, "gene", "left")
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_markers"),
            F.count("_h").alias("n_markers_hit"),
            F.count_if("_d").alias("n_direct_hit"),
            F.count_if("_o").alias("n_ortholog_hit"),
            F.count_if(F.col("_d") & F.col("_o")).alias("n_mixed_hit"),
        )
    )


def query_stats(genes: DataFrame, hits: DataFrame) -> DataFrame:
    """Hit rate, genes with and without hits, mean hits per gene that has any."""
    per_gene = hits.groupBy("gene").agg(F.count("*").alias("_h"))
    return genes.select("gene").distinct().join(per_gene, "gene", "left").agg(
        F.count("*").alias("n_genes"),
        F.count("_h").alias("n_with_hits"),
        F.count_if(F.col("_h").isNull()).alias("n_without_hits"),
        (F.count("_h") / F.greatest(F.count("*"), F.lit(1))).alias("hit_rate"),
        F.avg("_h").alias("mean_hits_per_gene"),
    )


def hits_per_gene(hits: DataFrame) -> DataFrame:
    return describe(hits.groupBy("gene").agg(F.count("*").alias("_h")), "_h")


def path_hit_stats(hits: DataFrame) -> DataFrame:
    """Genes reached directly, by orthologs, by both, by orthologs only."""
    per_gene = hits.groupBy("gene").agg(
        F.bool_or(F.col("source_path") == "direct").alias("d"), F.bool_or(F.col("source_path") == "ortholog").alias("o")
    )
    return per_gene.agg(
        F.count_if("d").alias("n_direct"),
        F.count_if("o").alias("n_ortholog"),
        F.count_if(F.col("d") & F.col("o")).alias("n_mixed"),
        F.count_if(F.col("o") & ~F.col("d")).alias("n_only_ortholog"),
    )


def candidate_stats(candidates: DataFrame, by=("cluster",)) -> DataFrame:
    """Per cluster: candidates, entropy of their support, ties with the first."""
    c = F.col("marker_count").cast("double")
    t = F.sum(c)
    h = (F.log(t) - F.sum(c * F.log(c)) / t) / F.log(F.lit(2.0))
    # A cluster has one row per type it hits, so the list of counts is small.
    wide = candidates.groupBy(*by).agg(
        F.count("*").alias("n_candidates"),
        F.collect_list("marker_count").alias("_counts"),
        F.max(F.when(F.col("rank") == 1, F.col("marker_count"))).alias("_top"),
        F.greatest(h, F.lit(0.0)).alias("entropy"),
    )
    return wide.select(*by, "n_candidates", F.expr("size(filter(_counts, x -> x = _top))").alias("n_tied_at_top"), "entropy")


def candidate_totals(candidates: DataFrame, by=("cluster",)) -> DataFrame:
    return candidates.agg(
        F.count_distinct("cell_type").alias("n_types"), F.count_distinct(*by).alias("n_clusters_with_candidates"),
        F.avg("mean_confidence").alias("mean_confidence"),
    )


def gap_metrics(candidates: DataFrame, clusters: DataFrame, ancestors: DataFrame, by=("cluster",)) -> DataFrame:
    """First against second candidate of every cluster, with their place in the hierarchy.

    ``clusters`` lists all clusters; those without candidates get zeros and the
    status ``no_candidates``. ``ancestors`` is (name, ancestor).
    """
    by = list(by)

    def at(rank: int, c: str):
        return F.max(F.when(F.col("rank") == rank, F.col(c)))

    # One pass; a cluster has one row per type it hits, so the list of counts is small.
    wide = candidates.groupBy(*by).agg(
        *[
            at(rank, c).alias(f"{name}_{out}")
            for rank, name in ((1, "first"), (2, "second"))
            for c, out in (("cell_type", "type"), ("marker_count", "count"), ("mean_confidence", "confidence"))
        ],
        F.count("*").alias("n_candidates"),
        F.sum("marker_count").alias("_support"),
        F.collect_list("marker_count").alias("_counts"),
    ).withColumn("n_tied_at_first", F.expr("size(filter(_counts, x -> x = first_count))"))
    # Ancestor sets are bounded by the depth of the hierarchy.
    up = ancestors.groupBy("name").agg(F.collect_set("ancestor").alias("_up"))
    base = (
        clusters.select(*by).distinct()
        .join(wide, by, "left")
        .join(up.select(F.col("name").alias("first_type"), F.col("_up").alias("_fa")), "first_type", "left")
        .join(up.select(F.col("name").alias("second_type"), F.col("_up").alias("_sa")), "second_type", "left")
    )
    none = F.array().cast("array<string>")
    base = base.withColumns({"_fa": F.coalesce("_fa", none), "_sa": F.coalesce("_sa", none)})
    up_of = F.array_contains("_sa", F.col("first_type"))
    down_of = F.array_contains("_fa", F.col("second_type"))
    has, two = F.col("first_type").isNotNull(), F.col("second_type").isNotNull()
    shared = F.array_sort(F.array_intersect("_fa", "_sa"))
    sc = F.coalesce("second_count", F.lit(0))
    return base.select(
        *by,
        F.when(has, "has_candidates").otherwise("no_candidates").alias("status"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        "first_type", "second_type",
        F.coalesce("first_count", F.lit(0)).alias("first_count"),
        sc.alias("second_count"),
        "first_confidence", "second_confidence",
        F.when(has, F.col("first_count") / F.greatest(sc, F.lit(1))).alias("count_ratio"),
        F.when(has, F.col("first_count") - sc).alias("count_diff"),
        F.when(two, F.coalesce("first_confidence", F.lit(0.0)) - F.coalesce("second_confidence", F.lit(0.0))).alias("confidence_diff"),
        "n_tied_at_first",
        F.when(has, F.col("first_count") / F.greatest("_support", F.lit(1))).alias("frac_support_first"),
        F.when(two, up_of | down_of).alias("related"),
        F.when(two & (up_of | down_of), up_of).alias("first_is_ancestor"),
        F.when(two & ~(up_of | down_of), F.size(shared)).alias("n_shared_ancestors"),
        F.when(two & ~(up_of | down_of), shared).alias("shared_ancestors"),
    )


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        F.count("*").alias("n_clusters"),
        F.count_if(F.col("status") == "has_candidates").alias("n_with_candidates"),
        F.avg("count_ratio").alias("mean_count_ratio"),
        F.count_if(F.col("count_ratio") <= 1).alias("n_tied"),
    )


def decision_view(candidates: DataFrame, by=("cluster",), shown: int | None = None, genes: int | None = None) -> DataFrame:
    """What a judge sees: first two candidates with their genes, then the rest without; a report may ask for the first ones only."""
    rows = candidates if shown is None else candidates.where(F.col("rank") <= shown)
    return rows.select(
        *by, "rank", "cell_type", "marker_count", "mean_confidence", "organs", "organ_status",
        F.when(F.col("rank") <= 2, F.col("supporting_markers") if genes is None else F.slice("supporting_markers", 1, genes)).alias("supporting_markers"),
    )


def reverse_marker_dict(candidates: DataFrame) -> DataFrame:
    """gene -> its types, sorted; one row per gene."""
    return (
        candidates.where(F.col("cell_type") != "")
        .select("cell_type", F.explode("supporting_markers").alias("gene"))
        .where(F.col("gene") != "")
        .groupBy("gene")
        .agg(F.array_sort(F.collect_set("cell_type")).alias("cell_types"))
    )


def dict_coverage(gene_types: DataFrame, entries: DataFrame, least: int = 3) -> DataFrame:
    """Per true label: distinct markers over its predicted terms, five of them, flag when too few.

    ``entries`` is (true, predicted).
    """
    flat = gene_types.select("gene", F.explode("cell_types").alias("predicted"))
    pairs = entries.select("true", "predicted").distinct().join(flat, "predicted", "left")
    marks = pairs.select("true", "gene").distinct()
    # Five smallest names per label, cut before the shuffle.
    w = W.partitionBy("true").orderBy("gene")
    sample = (
        marks.where("gene IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r <= 5")
        .groupBy("true").agg(F.array_sort(F.collect_list("gene")).alias("sample_markers"))
    )
    terms = pairs.where("gene IS NOT NULL").groupBy("true").agg(F.count_distinct("predicted").alias("n_terms_covered"))
    return (
        marks.groupBy("true").agg(F.count("gene").alias("n_markers"))
        .join(sample, "true", "left").join(terms, "true", "left")
        .withColumn("n_terms_covered", F.coalesce("n_terms_covered", F.lit(0)))
        .withColumn("too_few", F.col("n_markers") < least)
    )


def match_dictionary(cluster_genes: DataFrame, gene_types: DataFrame, organ: str | None = None, by=("cluster",)) -> DataFrame:
    """Candidates from a gene -> types dictionary alone: no confidence, no organ check."""
    by = list(by)
    flat = gene_types.select("gene", F.explode("cell_types").alias("cell_type")).where(F.col("cell_type") != "")
    per_type = (
        cluster_genes.select(*by, "gene", "position").join(flat, "gene")
        .groupBy(*by, "cell_type", "gene").agg(F.min("position").alias("_pos"))
        .groupBy(*by, "cell_type")
        .agg(
            F.count("*").alias("marker_count"),
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "gene"))), lambda s: s["gene"]).alias("supporting_markers"),
        )
    )
    w = W.partitionBy(*by).orderBy(F.col("marker_count").desc(), "cell_type")
    return per_type.withColumns(
        {
            "organ_status": F.lit("match" if organ else "unknown"),
            "mean_confidence": F.lit(None).cast("double"),
            "rank": F.row_number().over(w),
        }
    )
