"""Distributions that the steps report beside their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.operators.distribution import describe, gini
from cellsift.operators.neighbors import connected_components
from cellsift.operators.qc import melt


def gene_means(norm: DataFrame, n_cells: int, gene: str = "gene_id", value: str = "norm") -> DataFrame:
    """describe() of the genes' mean values over all cells, those without a value included."""
    return describe(norm.groupBy(gene).agg((F.sum(value) / n_cells).alias("mean_value")), "mean_value")


def variable_distributions(genes: DataFrame) -> DataFrame:
    """describe() of normalised dispersion and mean of the genes that were kept."""
    return describe(melt(genes.where("highly_variable"), ("dispersion_norm", "mean")), "value", ["variable"])


def variable_batches(genes: DataFrame) -> DataFrame:
    """How often batches picked the kept genes, and how many of these one batch alone picked."""
    kept = genes.where("highly_variable")
    return kept.agg(F.count("*").alias("n_kept"), F.sum("n_batches").cast("long").alias("n_batch_picks"), F.count_if(F.col("n_batches") == 1).alias("n_of_one_batch"))


def de_distributions(de: DataFrame, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """describe() of fold change, p and AUC of all tested genes."""
    return describe(melt(de, ("logfc", "pval", "auc"), *by), "value", [*by, "variable"])


def top_genes(de: DataFrame, by: Sequence[str] = ("cluster",), k: int = 15) -> DataFrame:
    """The first k genes of each group as one ordered list (name, fold change, adjusted p, AUC, shares)."""
    packed = F.struct("rank", F.struct(F.col("gene_id").alias("name"), "logfc", "pval_adj", "auc", "pct1", "pct2").alias("g"))
    return de.where(F.col("rank") <= k).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda s: s["g"]).alias("top_genes"))


def candidate_distributions(candidates: DataFrame, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """describe() of the candidates a group has, and of their mean confidences."""
    counts = candidates.groupBy(*by).agg(F.count("*").cast("double").alias("value")).select(F.lit("n_candidates").alias("variable"), "value")
    trust = candidates.where("mean_confidence IS NOT NULL").select(F.lit("confidence").alias("variable"), F.col("mean_confidence").alias("value"))
    return describe(counts.unionByName(trust), "value", ["variable"])


def chosen_agreement(agreement: DataFrame, chosen: str) -> DataFrame:
    """Mean adjusted Rand index of the pairs of resolutions that touch the chosen one; one row."""
    return agreement.where((F.col("r1") == chosen) | (F.col("r2") == chosen)).agg(F.avg("ari").alias("stability_at_chosen"), F.count("*").alias("n_pairs"))


def degree_summary(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """describe() of the weighted degrees (0 without edges), and the number of connected components."""
    degree = edges.groupBy("src").agg(F.sum("weight").alias("degree"))
    full = nodes.select(F.col(id_col).alias("src")).join(degree, "src", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    parts = connected_components(edges, nodes, id_col).select(F.count_distinct("component")).scalar()
    return describe(full, "degree").withColumn("n_components", parts)


def size_summary(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """describe() of the cluster sizes with their gini."""
    sizes = labels.groupBy(cluster).agg(F.count("*").cast("double").alias("size"))
    return describe(sizes, "size").withColumn("gini", gini(sizes, "size").scalar())


def mean_autocorrelation(per_batch: DataFrame) -> DataFrame:
    """Mean absolute Moran's I over the batches that have one."""
    return per_batch.agg(F.avg(F.abs("morans_i")).alias("mean_abs"), F.count("morans_i").alias("n_batches"))


def available_genes(sets: DataFrame, genes: DataFrame, by: Sequence[str] = ("cluster", "which"), gene: str = "gene_id") -> DataFrame:
    """Genes of each set, and how many of them the matrix has."""
    known = genes.select(gene).distinct().withColumn("_k", F.lit(1))
    return sets.select(*by, gene).distinct().join(known, gene, "left").groupBy(*by).agg(F.count("*").alias("n_genes"), F.count("_k").alias("n_available"))
