"""Load-time checks: facts as a DataFrame, or an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_facts(expr: DataFrame, cell: str = "cell_id", gene: str = "gene_id", count: str = "count") -> DataFrame:
    """All names numeric?, total, entries, cells, genes: one row."""
    return expr.agg(
        F.bool_and(F.col(gene).try_cast("double").isNotNull()).alias("all_numeric_genes"),
        F.sum(count).alias("total"),
        F.count("*").alias("n_entries"),
        F.count_distinct(cell).alias("n_cells"),
        F.count_distinct(gene).alias("n_genes"),
    )


def check_matrix(expr: DataFrame, cell: str = "cell_id", gene: str = "gene_id", count: str = "count") -> DataFrame:
    """The matrix itself, or ValueError: no rows, all zero, or gene names that are only numbers."""
    facts = matrix_facts(expr, cell, gene, count).first()
    if not facts["n_entries"]:
        raise ValueError("the matrix is empty")
    if facts["all_numeric_genes"]:
        raise ValueError("every gene name is a number; the name column is probably an index")
    if not facts["total"]:
        raise ValueError("the matrix holds only zeros")
    return expr


def split_labels(obs: DataFrame, columns, key: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """(obs without the label columns, key with the label columns); absent names are ignored."""
    present = [c for c in columns if c in obs.columns]
    return obs.drop(*present), obs.select(key, *present)


def check_alignment(left: DataFrame, right: DataFrame, key: str = "cell_id") -> DataFrame:
    """One row: keys in common, missing from the right, extra on the right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    sides = a.select(key, F.lit(1).alias("_a")).join(b.select(key, F.lit(1).alias("_b")), key, "full_outer")
    return sides.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_common"),
        F.count_if(F.col("_b").isNull()).alias("n_missing"),
        F.count_if(F.col("_a").isNull()).alias("n_extra"),
    )


def require_aligned(left: DataFrame, right: DataFrame, key: str = "cell_id") -> None:
    row = check_alignment(left, right, key).first()
    if row["n_missing"] or row["n_extra"]:
        raise ValueError(f"keys differ: {row['n_missing']} missing, {row['n_extra']} extra")


def stale_clusters(refined: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters of the artifact that the labelling does not hold (any more)."""
    return refined.select(cluster).distinct().join(labels.select(cluster).distinct(), cluster, "left_anti")


def stale_guard(refined: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``refined`` itself, or ValueError naming up to ten stale clusters."""
    stale = [r[0] for r in stale_clusters(refined, labels, cluster).orderBy(cluster).limit(10).collect()]
    if stale:
        raise ValueError(f"clusters {stale} are not in the current labels; rerun the steps after clustering")
    return refined


def resolve_batch_column(columns, requested: str | None = None) -> str:
    """Exact name, else the same name in another case, else the first usual batch column."""
    folded = {c.lower(): c for c in columns}
    for name in [requested] if requested else []:
        if name in columns:
            return name
        if name.lower() in folded:
            return folded[name.lower()]
    # Usual batch columns, in order of preference.
    for name in ("orig.ident", "sample", "batch", "donor", "library"):
        if name in folded:
            return folded[name]
    raise ValueError(f"no batch column among {list(columns)}")
