"""Refinement inside clusters: gene scores, subclusters, their labels; doublets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.operators.distribution import describe, valley
from cellsift.operators.components import principal_components
from cellsift.operators.embedding import _centroids, sparse_scaled
from cellsift.operators.markers import filter_markers, rank_genes
from cellsift.operators.neighbors import autocorrelation, knn_join
from cellsift.operators.normalize import normalize_log
from cellsift.operators.running import running
from cellsift.session import durable


def subset_cluster(expr: DataFrame, labels: DataFrame, wanted, cell: str = "cell_id", cluster: str = "cluster") -> DataFrame:
    """Matrix rows of the cells in the wanted clusters."""
    return expr.join(labels.where(F.col(cluster).isin(list(wanted))).select(cell), cell, "left_semi")


def gene_score(
    expr: DataFrame, labels: DataFrame, sets: DataFrame, bins: int = 25, controls: int = 50, seed: int = 0,
    value: str = "norm", cell: str = "cell_id", gene: str = "gene_id", by: str = "cluster",
) -> DataFrame:
    """(by, which, cell, score): mean of a gene set minus mean of matched control genes.

    ``sets`` is (by, which, gene). Controls are genes of the same expression bin,
    picked by seeded hash; a cell's score is then one weighted sum over its stored
    values, so absent values cost nothing.
    """
    sizes = labels.groupBy(by).agg(F.count("*").alias("_n"))
    inside = expr.join(labels.select(cell, by), cell)
    means = inside.groupBy(by, gene).agg(F.sum(value).alias("_s")).join(sizes, by).select(by, gene, (F.col("_s") / F.col("_n")).alias("_m"))
    # One row per gene of the cluster: the group is the feature list.
    w = W.partitionBy(by)
    binned = means.withColumn("_items", F.greatest(F.round(F.count("*").over(w) / (bins - 1)), F.lit(1))).withColumn(
        "_bin", F.floor(F.rank().over(w.orderBy(F.round("_m", 12))) / F.col("_items")))
    own = sets.select(by, "which", gene).distinct().join(binned.select(by, gene, "_bin"), [by, gene])
    cuts = own.select(by, "which", "_bin").distinct()
    pick = W.partitionBy(by, "which", "_bin").orderBy(F.xxhash64(F.col(gene), F.lit(seed)), gene)
    ctrl = (
        cuts.join(binned.select(by, gene, "_bin"), [by, "_bin"])
        .withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= controls)
        .join(own.select(by, "which", gene), [by, "which", gene], "left_anti")
        .select(by, "which", gene)
    )
    weigh = lambda df, sign: df.join(df.groupBy(by, "which").agg(F.count("*").alias("_k")), [by, "which"]).select(
        by, "which", gene, (F.lit(sign) / F.col("_k")).alias("_w"))
    weights = weigh(own.select(by, "which", gene), 1.0).unionByName(weigh(ctrl, -1.0))
    scored = inside.join(weights, [by, gene]).groupBy(by, "which", cell).agg(F.sum(F.col(value) * F.col("_w")).alias("_s"))
    grid = labels.select(by, cell).join(own.select(by, "which").distinct(), by)
    return grid.join(scored, [by, "which", cell], "left").select(by, "which", cell, F.coalesce("_s", F.lit(0.0)).alias("score"))


def preference_scores(scores: DataFrame, cell: str = "cell_id", by: str = "cluster") -> DataFrame:
    """score(first) - score(second) per cell; a missing set scores 0."""
    part = lambda n: F.sum(F.when(F.col("which") == n, F.col("score")).otherwise(0.0))
    return scores.groupBy(by, cell).agg(part("first").alias("first"), part("second").alias("second")).withColumn(
        "value", F.col("first") - F.col("second"))


def candidate_autocorr(scores: DataFrame, edges: DataFrame, clusters: DataFrame, min_cells: int = 30, cell: str = "cell_id") -> DataFrame:
    """Moran, Geary and shape of the preference score per cluster, with a status for every cluster.

    ``scores`` comes from preference_scores; ``clusters`` is (cluster, n_cells,
    status, selected) with the status of gap_metrics.
    """
    auto = autocorrelation(edges, scores, "value", ["cluster"], cell)
    shape = describe(scores, "value", ["cluster"]).select("cluster", "mean", "std", "bimodality")
    means = scores.groupBy("cluster").agg(F.avg("first").alias("first_mean"), F.avg("second").alias("second_mean"))
    status = (
        F.when(~F.col("selected"), "not_selected")
        .when(F.col("status") != "has_candidates", "no_candidates")
        .when(F.col("n_cells") < min_cells, "too_small")
        .when(F.col("morans_i").isNull(), "error")
        .otherwise("ambiguous")
    )
    joined = clusters.join(auto, "cluster", "left").join(shape, "cluster", "left").join(means, "cluster", "left")
    out = joined.withColumn("status", status)
    shown = lambda c: F.when(F.col("status") == "ambiguous", F.col(c)).alias(c)
    return out.select("cluster", "n_cells", "status", *[shown(c) for c in ("morans_i", "gearys_c", "mean", "std", "bimodality", "first_mean", "second_mean")])


def subcluster(points: DataFrame, labels: DataFrame, targets: DataFrame, k: int = 3, min_cells: int = 100, rounds: int = 10,
               seed: int = 0, id_col: str = "id", vec: str = "x", cluster: str = "cluster") -> DataFrame:
    """(parent, id, sub): seeded k-means inside every target cluster, all parents in one job.

    A parent's few centres travel to its points, so a parent of any size is fine.
    """
    sizes = labels.groupBy(F.col(cluster).alias("parent")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_cells)
    held = (
        labels.select(F.col(id_col).alias("id"), F.col(cluster).alias("parent"))
        .join(targets.select(F.col(cluster).alias("parent")).distinct(), "parent", "left_semi").join(sizes.select("parent"), "parent", "left_semi")
        .join(points.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("x")), "id")
    )
    held = durable(held)
    w = W.partitionBy("parent").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), "id")
    centers = held.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("parent", (F.col("_r") - 1).alias("sub"), F.col("x").alias("_c"))
    placed = None
    for _ in range(rounds):
        lists = centers.groupBy("parent").agg(F.collect_list(F.struct("sub", "_c")).alias("_l"))
        best = F.expr("""array_min(transform(_l, c -> struct(
            round(aggregate(zip_with(x, c._c, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v), 12) AS d, c.sub AS sub))).sub""")
        placed = durable(held.join(lists, "parent").select("parent", "id", "x", best.alias("sub")))
        centers = _centroids(placed, ["parent", "sub"])
    return placed.select("parent", "id", F.col("sub").cast("string").alias("sub"))


def subcluster_outcomes(labels: DataFrame, targets: DataFrame, subs: DataFrame, min_cells: int = 100, cluster: str = "cluster") -> DataFrame:
    """skipped / analyzed_nosplit / analyzed per target, with sizes."""
    sizes = labels.groupBy(F.col(cluster)).agg(F.count("*").alias("n_cells"))
    per = subs.groupBy("parent", "sub").agg(F.count("*").alias("_k")).groupBy(F.col("parent").alias(cluster)).agg(
        F.count("*").alias("n_subclusters"), F.array_sort(F.collect_list("_k")).alias("sub_sizes"))
    return targets.select(cluster).distinct().join(sizes, cluster).join(per, cluster, "left").select(
        cluster, "n_cells", "n_subclusters", "sub_sizes",
        F.when(F.col("n_cells") < min_cells, "skipped").when(F.col("n_subclusters").isNull(), "skipped")
        .when(F.col("n_subclusters") < 2, "analyzed_nosplit").otherwise("analyzed").alias("outcome"),
        F.when(F.col("n_cells") < min_cells, "n_cells_below_min").when(F.col("n_subclusters").isNull(), "error")
        .when(F.col("n_subclusters") < 2, "single_subcluster").alias("reason"))


def subcluster_markers(expr: DataFrame, subs: DataFrame, n: int = 50, top: int = 10, cell: str = "cell_id", **limits) -> DataFrame:
    """Markers of every subcluster against the rest of its parent, all parents in one job."""
    labels = subs.select("parent", F.col("id").alias(cell), F.col("sub").alias("cluster"))
    de = rank_genes(expr, labels, top=n, by=("parent",), cell=cell)
    return filter_markers(de, top_n=top, by=("parent", "cluster"), **limits)


def first_second(candidates: DataFrame, by=("parent", "cluster")) -> DataFrame:
    """First and second type with support, confidence of the first, number of candidates."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return candidates.groupBy(*by).agg(
        at(1, "cell_type").alias("first_type"), at(2, "cell_type").alias("second_type"),
        F.coalesce(at(1, "marker_count"), F.lit(0)).alias("first_count"), F.coalesce(at(2, "marker_count"), F.lit(0)).alias("second_count"),
        at(1, "mean_confidence").alias("first_confidence"), F.count("*").alias("n_candidates"))


def type_membership(sub_first: DataFrame, parent_candidates: DataFrame) -> DataFrame:
    """Is a subcluster's first type among its parent's candidates: true, false, or null without one."""
    known = parent_candidates.select(F.col("cluster").alias("parent"), F.col("cell_type").alias("first_type"), F.lit(True).alias("_in")).distinct()
    return sub_first.join(known, ["parent", "first_type"], "left").select(
        "parent", "cluster", "first_type", F.when(F.col("first_type").isNotNull(), F.coalesce("_in", F.lit(False))).alias("in_parent"))


def membership_counts(membership: DataFrame) -> DataFrame:
    return membership.agg(
        F.count_if("in_parent").alias("n_in_range"), F.count_if(~F.col("in_parent")).alias("n_out_of_range"),
        F.count_if(F.col("in_parent").isNull()).alias("n_none"))


def subcluster_delivery(subs: DataFrame, sub_first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cell, parent, subcluster), (parent, subcluster, label)): unnamed subclusters are unknown."""
    cells = subs.select("id", "parent", F.col("sub").alias("subcluster"))
    names = sub_first.select("parent", F.col("cluster").alias("subcluster"), "first_type")
    labels = cells.select("parent", "subcluster").distinct().join(names, ["parent", "subcluster"], "left").select(
        "parent", "subcluster", F.coalesce(F.nullif("first_type", F.lit("")), F.lit("unknown")).alias("label"))
    return cells, labels


def refine_status(gaps: DataFrame, targets: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """unknown / passthrough / analyzed / skipped per cluster; without targets nothing was refined."""
    if targets is None or outcomes is None:
        return gaps.withColumn("outcome", F.lit(None).cast("string")).withColumn(
            "status", F.when(F.col("status") == "no_candidates", "unknown").otherwise("passthrough"))
    picked = targets.select("cluster", F.lit(True).alias("_t")).distinct()
    return (
        gaps.join(picked, "cluster", "left").join(outcomes.select("cluster", "outcome"), "cluster", "left")
        .withColumn(
            "status",
            F.when(F.col("status") == "no_candidates", "unknown").when(F.col("_t").isNull(), "passthrough")
            .when(F.col("outcome").isin("analyzed", "analyzed_nosplit"), "analyzed").otherwise("skipped"))
        .drop("_t")
    )


def refine_counts(refined: DataFrame) -> DataFrame:
    return refined.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("passthrough", "analyzed", "skipped", "unknown")])


def doublet_scores(
    expr: DataFrame, rate: float = 0.06, ratio: float = 2.0, k: int = 30, pcs: int = 10, seed: int = 0,
    cell: str = "cell_id", gene: str = "gene_id", count: str = "count",
) -> DataFrame:
    """(cell, score): likelihood that a cell is two, from its share of simulated neighbours.

    Simulated cells are sums of two cells picked by seeded hash. Cells and simulated
    cells are embedded together, and the neighbours of each are counted.

    The matrix is read once; from then on cells go by their number in the order of their names, simulated ones after
    them. A cell's rows are brought together once and stay so, which keeps its sums out of later shuffles.
    """
    base = durable(expr.select(F.col(cell).cast("string").alias("_c"), gene, count))
    cells = base.select("_c").distinct().withColumn("_one", F.lit(1).cast("long"))
    numbered = durable(running(cells, [], ["_c"], {"_i": ("sum", "_one")}).select("_c", (F.col("_i") - 1).alias("_i")))
    n = numbered.count()
    n_sim = max(int(n * ratio), 1)
    pick = lambda part: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(part)), F.lit(n))
    sims = expr.sparkSession.range(n_sim).select((F.col("id") + n).alias("_s"), F.explode(F.array(pick(0), pick(1))).alias("_i"))
    real = base.join(numbered, "_c").select("_i", gene, count)
    made = real.join(sims, "_i").select(F.col("_s").alias("_i"), gene, count)
    both = real.unionByName(made).repartition("_i").groupBy("_i", gene).agg(F.sum(count).alias(count))
    normed = normalize_log(both, cell="_i", count=count).select("_i", gene, "norm")
    scaled = sparse_scaled(normed, n + n_sim, gene=gene).select("_i", gene, "scaled_raw")
    points = durable(principal_components(scaled, pcs, cell="_i", feature=gene, distinct=True).scores)
    k_all = max(int(round(k * (1 + ratio))), 1)
    near = knn_join(points, k_all)
    share = near.groupBy("id").agg(F.count_if(F.col("nbr") >= n).alias("_s")).join(numbered, F.col("id") == F.col("_i"), "left")
    q = (F.col("_s") + 1) / F.lit(k_all + 2.0)
    score = q * rate / ratio / (1 - rate - q * (1 - rate - rate / ratio))
    return share.select(F.coalesce("_c", F.concat(F.lit("sim"), F.col("id") - n)).alias("id"), (F.col("id") >= n).alias("simulated"), score.alias("score"))


def call_doublets(scores: DataFrame) -> DataFrame:
    """(cell, score, doublet): above the valley of the simulated scores; without a valley nothing is called."""
    limit = valley(describe(scores.where("simulated"), "score")).scalar()
    return scores.where("NOT simulated").withColumn("threshold", limit).select(
        F.col("id").alias("cell_id"), "score", "threshold", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)).alias("doublet"))


def doublet_summary(called: DataFrame) -> DataFrame:
    return called.agg(
        F.count("*").alias("n_before"), F.count_if("doublet").alias("n_doublets"), F.count_if(~F.col("doublet")).alias("n_after"),
        F.avg(F.col("doublet").cast("int")).alias("frac_doublets"), F.max("threshold").alias("threshold"))
