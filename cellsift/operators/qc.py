"""Quality control: flags, per-cell metrics, filters with their reports."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.operators.distribution import describe, distribution_shift, filter_funnel, gini, ks_normal, valley

# The usual organelle prefixes and filter limits.
MITO_PATTERN = "^(ATMG|MT-)"
CHLORO_PATTERN = "^ATCG"
MIN_GENES, MAX_MITO, MAX_CHLORO = 300, 15.0, 15.0
QC_COLUMNS = ("n_genes", "total_counts", "pct_mt", "pct_cp")


def flag_features(var: DataFrame, patterns: Mapping[str, str], gene: str = "gene_id") -> DataFrame:
    """One boolean column per pattern; a pattern is anchored at the start of the name."""
    for p in patterns.values():
        re.compile(p)
    return var.withColumns({name: F.col(gene).rlike(f"^(?:{p})") for name, p in patterns.items()})


def qc_metrics(
    expr: DataFrame, patterns: Mapping[str, str], cell: str = "cell_id", gene: str = "gene_id", count: str = "count"
) -> DataFrame:
    """Per cell: genes detected, total, percent of the total in each flagged set.

    Flags come from the name itself, so one aggregation is enough and no join.
    """
    flagged = flag_features(expr.where(F.col(count) > 0), {f"_{k}": p for k, p in patterns.items()}, gene)
    sums = flagged.groupBy(cell).agg(
        F.count("*").alias("n_genes"),
        F.sum(count).alias("total_counts"),
        *[F.sum(F.when(F.col(f"_{k}"), F.col(count)).otherwise(0.0)).alias(f"_s_{k}") for k in patterns],
    )
    return sums.select(
        cell,
        "n_genes",
        F.col("total_counts").cast("double"),
        *[F.expr(f"try_divide(100D * _s_{k}, total_counts)").alias(f"pct_{k}") for k in patterns],
    )


def melt(df: DataFrame, columns, *keep: str) -> DataFrame:
    """(keep, variable, value): several columns as one, so one job serves all."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS double)" for c in columns)
    return df.selectExpr(*keep, f"stack({len(columns)}, {pairs}) AS (variable, value)")


def qc_summary(metrics: DataFrame, columns=QC_COLUMNS) -> DataFrame:
    """describe() of every metric in one pass, with the gini of each."""
    long = melt(metrics, columns)
    return describe(long, "value", ["variable"]).join(gini(long, "value", ["variable"]), "variable")


def qc_distribution(metrics: DataFrame, columns=QC_COLUMNS) -> DataFrame:
    """qc_summary plus valley, tail p99 - p90 and KS distance to the normal."""
    long = melt(metrics, columns)
    d = describe(long, "value", ["variable"])
    return (
        d.join(valley(d, ["variable"]), "variable")
        .join(ks_normal(long, "value", ["variable"]), "variable")
        .withColumn("tail_fraction", F.col("p99") - F.col("p90"))
    )


def cell_masks(
    min_genes: int | None = MIN_GENES, max_mt: float | None = MAX_MITO, max_cp: float | None = MAX_CHLORO
) -> dict:
    masks = {}
    if min_genes:
        masks["min_genes"] = F.col("n_genes") >= min_genes
    if max_mt is not None:
        masks["max_mt"] = F.col("pct_mt") < max_mt
    if max_cp is not None:
        masks["max_cp"] = F.col("pct_cp") < max_cp
    return masks


def filter_cells(metrics: DataFrame, **limits) -> DataFrame:
    """Cells that pass every limit of ``cell_masks``."""
    kept = metrics
    for m in cell_masks(**limits).values():
        kept = kept.where(m)
    return kept


def cell_funnel(metrics: DataFrame, **limits) -> DataFrame:
    return filter_funnel(metrics, cell_masks(**limits)).withColumn(
        "frac_lost", 1 - F.col("n_after") / F.greatest("n_before", F.lit(1))
    )


def cell_shift(metrics: DataFrame, column: str, **limits) -> DataFrame:
    """How filtering moved one metric."""
    return distribution_shift(metrics, filter_cells(metrics, **limits), column).withColumn("variable", F.lit(column))


def gene_breadth(expr: DataFrame, n_cells: int | None = None, cell: str = "cell_id", gene: str = "gene_id",
                 count: str = "count") -> DataFrame:
    """(gene, n_cells_expr, breadth): cells that express the gene, and their share."""
    if n_cells is None:
        total = expr.select(F.count_distinct(cell).alias("n")).scalar()
    else:
        total = F.lit(n_cells)
    per_gene = expr.where(F.col(count) > 0).groupBy(gene).agg(F.count("*").alias("n_cells_expr"))
    return per_gene.withColumn("breadth", F.col("n_cells_expr") / total)


def gene_masks(breadth: DataFrame, patterns: Mapping[str, str], min_cells: int = 3, drop_flagged: bool = True,
               gene: str = "gene_id") -> DataFrame:
    """gene_breadth rows with flags and ``kept``."""
    flagged = flag_features(breadth, patterns, gene)
    flags = [F.col(k) for k in patterns] if drop_flagged else []
    kept = F.col("n_cells_expr") >= min_cells
    for f in flags:
        kept = kept & ~f
    return flagged.withColumn("kept", kept)


def filter_genes(expr: DataFrame, masks: DataFrame, gene: str = "gene_id") -> DataFrame:
    return expr.join(masks.where("kept").select(gene), gene, "left_semi")


def gene_report(masks: DataFrame, patterns: Mapping[str, str], min_cells: int = 3) -> DataFrame:
    """Counts before and after, removed per reason, genes seen in under 1 % of cells."""
    return masks.agg(
        F.count("*").alias("n_before"),
        F.count_if("kept").alias("n_after"),
        (1 - F.count_if("kept") / F.greatest(F.count("*"), F.lit(1))).alias("frac_lost"),
        *[F.count_if(k).alias(f"n_{k}_removed") for k in patterns],
        F.count_if(F.col("n_cells_expr") < min_cells).alias("n_removed_by_min_cells"),
        F.count_if(F.col("breadth") < 0.01).alias("n_in_lt_1pct_cells"),
    )
