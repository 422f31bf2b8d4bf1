"""Library-size normalisation, variable features, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.session import durable


def normalize_log(
    expr: DataFrame, target_sum: float = 1e4, cell: str = "cell_id", count: str = "count", out: str = "norm"
) -> DataFrame:
    """Add ln(1 + count / cell total * target).

    The totals are joined back rather than windowed: a cell that holds much of
    the table is then split by the skew join instead of sorted in one task.
    """
    totals = expr.groupBy(cell).agg(F.sum(count).alias("_total"))
    return (
        expr.join(totals, cell)
        .withColumn(out, F.log1p(F.col(count) / F.col("_total") * target_sum))
        .drop("_total")
    )


def normalization_summary(
    norm: DataFrame, n_cells: int | None = None, cell: str = "cell_id", gene: str = "gene_id", count: str = "count"
) -> DataFrame:
    """Median library size (via cell totals), share of zeros on the full grid."""
    from cellsift.operators.distribution import describe

    sizes = norm.groupBy(cell).agg(F.sum(count).alias("size"))
    median = describe(sizes, "size", compact=False).select("median").scalar()
    grid = norm.agg(
        F.count_if(F.col(count) > 0).alias("_nnz"),
        F.count_distinct(cell).alias("n_cells"),
        F.count_distinct(gene).alias("n_genes"),
    )
    cells = F.lit(n_cells) if n_cells is not None else F.col("n_cells")
    return grid.select(
        median.alias("median_library_size"),
        cells.cast("long").alias("n_cells"),
        "n_genes",
        (1 - F.col("_nnz") / F.greatest(cells * F.col("n_genes"), F.lit(1))).alias("frac_zero"),
    )


def gene_moments(norm: DataFrame, n_cells, by=(), gene: str = "gene_id", value: str = "norm") -> DataFrame:
    """Mean and sample variance of expm1(value) over all cells, zeros included.

    ``n_cells`` is a number, or a table (by, n_cells) when ``by`` is given.
    """
    x = F.expm1(value)
    sums = norm.groupBy(*by, gene).agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_q"), F.sum(value).alias("_l"))
    if isinstance(n_cells, DataFrame):
        sums = sums.join(n_cells, list(by))
    else:
        sums = sums.withColumn("n_cells", F.lit(n_cells))
    n = F.col("n_cells")
    mean = F.col("_s") / n
    return sums.select(
        *by, gene, mean.alias("mean"), ((F.col("_q") - n * mean * mean) / (n - 1)).alias("variance"),
        (F.col("_l") / n).alias("mean_log"),
    )


def _dispersions(moments: DataFrame, by, bins: int) -> DataFrame:
    # Stored, so that range, bins, spreads and picks read the same sums: one row a gene (and batch).
    moments = durable(moments)
    floor = "greatest(IF(mean = 0, 1e-12D, mean), 1e-12D)"
    scored = moments.selectExpr(
        "*",
        f"IF(variance <= 0, NULL, ln(variance / {floor})) AS dispersion",
        f"log1p({floor}) AS log_mean",
    )
    span = scored.groupBy(*by).agg(F.min("log_mean").alias("_lo"), F.max("log_mean").alias("_hi"))
    if by:
        placed = scored.join(span, list(by))
    else:
        placed = scored.withColumn("_s", span.select(F.struct("_lo", "_hi")).scalar()).select("*", "_s.*").drop("_s")
    # Right-closed bins of equal width; the lowest value belongs to the first.
    binned = placed.withColumn(
        "_bin",
        F.expr(f"greatest(1, least({bins}, coalesce(ceil(try_divide(log_mean - _lo, _hi - _lo) * {bins}), 1)))"),
    )
    # A bin with one gene scores 1: its spread is taken as its mean, its mean as 0.
    per_bin = binned.groupBy(*by, "_bin").agg(
        F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_sd")
    )
    return (
        binned.join(per_bin, [*by, "_bin"])
        .withColumn(
            "dispersion_norm",
            F.expr("try_divide(dispersion - IF(_sd IS NULL, 0D, _m), coalesce(_sd, _m))"),
        )
        .drop("_bin", "_m", "_sd", "_lo", "_hi")
    )


def _ranking(gene: str) -> list:
    """Highest score first. Both genes of a bin of two score 1 / sqrt(2) from 0, but for rounding: digits beyond the eighth don't tell genes apart, names do."""
    return [F.round("dispersion_norm", 8).desc_nulls_last(), F.col(gene)]


def select_variable_genes(
    norm: DataFrame, n_cells: int, n_top: int = 2000, bins: int = 20, gene: str = "gene_id", value: str = "norm"
) -> DataFrame:
    """Gene table with mean, dispersion, normalised dispersion and ``highly_variable``; ties go to the gene name."""
    scored = _dispersions(gene_moments(norm, n_cells, (), gene, value), (), bins)
    top = scored.orderBy(*_ranking(gene)).limit(n_top)
    return scored.join(
        top.select(gene, F.lit(True).alias("highly_variable")), gene, "left"
    ).withColumn("highly_variable", F.coalesce("highly_variable", F.lit(False)))


def select_variable_genes_by_batch(
    norm: DataFrame, batches: DataFrame, batch: str = "batch", n_top: int = 2000, bins: int = 20,
    cell: str = "cell_id", gene: str = "gene_id", value: str = "norm",
) -> DataFrame:
    """Rank genes inside each batch, then by how many batches picked them.

    Ties go to the higher mean normalised dispersion, then to the gene name.
    """
    sizes = batches.groupBy(batch).agg(F.count("*").alias("n_cells"))
    joined = norm.join(batches.select(cell, batch), cell)
    scored = _dispersions(gene_moments(joined, sizes, (batch,), gene, value), (batch,), bins)
    # rank <= n_top is cut before the shuffle, so a batch never moves whole.
    w = W.partitionBy(batch).orderBy(*_ranking(gene))
    picked = (
        scored.select(batch, gene, "dispersion_norm", F.row_number().over(w).alias("_r"))
        .where(F.col("_r") <= n_top)
        .groupBy(gene)
        .agg(F.count("*").alias("n_batches"))
    )
    n_batches = sizes.select(F.count("*")).scalar()
    merged = scored.groupBy(gene).agg(F.sum(F.coalesce("dispersion_norm", F.lit(0.0))).alias("_s")).select(
        gene, (F.col("_s") / n_batches).alias("dispersion_norm")
    )
    merged = merged.join(picked, gene, "left").withColumn("n_batches", F.coalesce("n_batches", F.lit(0)))
    top = merged.orderBy(F.col("n_batches").desc(), *_ranking(gene)).limit(n_top)
    return merged.join(top.select(gene, F.lit(True).alias("highly_variable")), gene, "left").withColumn(
        "highly_variable", F.coalesce("highly_variable", F.lit(False))
    )


def variable_summary(genes: DataFrame) -> DataFrame:
    """Counts and the gap between the median dispersions of kept and dropped genes."""
    from cellsift.operators.distribution import describe

    med = describe(genes, "dispersion_norm", ["highly_variable"], compact=False).select("highly_variable", "median")
    gap = med.agg(
        (F.max(F.when(F.col("highly_variable"), F.col("median")))
         - F.max(F.when(~F.col("highly_variable"), F.col("median")))).alias("g")
    ).scalar()
    cols = [F.count("*").alias("n_before"), F.count_if("highly_variable").alias("n_after")]
    if "n_batches" in genes.columns:
        cols.append(F.count_if(F.col("n_batches") == 1).alias("n_batch_specific"))
    return genes.agg(*cols).withColumn("frac_kept", F.col("n_after") / F.greatest("n_before", F.lit(1))).withColumn(
        "dispersion_gap", gap
    )


def scale_clip(
    norm: DataFrame, n_cells: int, max_value: float = 10.0, gene: str = "gene_id", value: str = "norm"
) -> DataFrame:
    """z-score per gene on the full grid, clipped above.

    Only stored entries are returned; ``zero_scaled`` is what every absent entry
    of the gene scales to, so the grid is never written out.
    """
    v = F.col(value)
    sums = norm.groupBy(gene).agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    mean = F.col("_s") / n_cells
    sd = F.sqrt(F.greatest((F.col("_q") - n_cells * mean * mean) / (n_cells - 1), F.lit(0.0)))
    stats = sums.select(gene, mean.alias("_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("_sd"))
    return norm.join(stats, gene).select(
        *norm.columns,
        F.least((v - F.col("_mean")) / F.col("_sd"), F.lit(float(max_value))).alias("scaled"),
        F.least(-F.col("_mean") / F.col("_sd"), F.lit(float(max_value))).alias("zero_scaled"),
    )
