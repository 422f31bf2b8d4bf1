"""Embeddings and clusterings: PCA, silhouette, compactness, stability, layout quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.operators import blocks
from cellsift.operators.distribution import describe, gini
from cellsift.operators.hot import hot_join
from cellsift.operators.neighbors import knn_join
from cellsift.session import durable


def sample_rows(points: DataFrame, n: int | None, seed: int = 0, id_col: str = "id") -> DataFrame:
    """All rows, or the n rows with the smallest seeded hash: the same ones on every run."""
    if n is None:
        return points
    return points.orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), id_col).limit(n)


def sparse_scaled(norm: DataFrame, n_cells: int, max_value: float = 10.0, gene: str = "gene_id", value: str = "norm") -> DataFrame:
    """Values clipped at mean + max_value spreads, over the spread: scaling without centring.

    ``norm`` is stored, as it is read twice; rows of a gene with much of the table stay where they are.
    """
    v, norm = F.col(value), durable(norm.where(F.col(gene).isNotNull()))
    sums = norm.groupBy(gene).agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    stats = sums.select(gene, (F.col("_s") / n_cells).alias("_m"), F.sqrt(F.greatest(
        (F.col("_q") - F.col("_s") * F.col("_s") / n_cells) / (n_cells - 1), F.lit(0.0))).alias("_d"))
    sd = F.when(F.col("_d") == 0, 1.0).otherwise(F.col("_d"))
    return hot_join(norm, stats, [gene], "inner").withColumn("scaled_raw", F.least(v, F.col("_m") + max_value * sd) / sd).drop("_m", "_d")


def variance_explained(ratios: DataFrame) -> DataFrame:
    """(pc, ratio, cumulative); components are few."""
    w = W.partitionBy(F.lit(1)).orderBy("pc").rowsBetween(W.unboundedPreceding, 0)
    return ratios.withColumn("cumulative", F.sum("ratio").over(w))


def variance_summary(ratios: DataFrame) -> DataFrame:
    """PCs needed for 50 / 80 / 90 %, and the PC after the largest drop."""
    w = W.partitionBy(F.lit(1)).orderBy("pc")
    v = variance_explained(ratios).withColumn("_drop", F.col("ratio") - F.lead("ratio").over(w))
    need = lambda t: F.coalesce(F.min(F.when(F.col("cumulative") >= t, F.col("pc"))), F.max("pc"))
    return v.agg(
        need(0.5).alias("n_pcs_50"), need(0.8).alias("n_pcs_80"), need(0.9).alias("n_pcs_90"),
        (F.max_by("pc", F.when(F.col("_drop").isNotNull(), F.struct("_drop", -F.col("pc")))) + 1).alias("knee"))


def silhouette(points: DataFrame, max_n: int | None = None, seed: int = 0, id_col: str = "id", vec: str = "x",
               cluster: str = "cluster", block: int = 2048) -> DataFrame:
    """(id, cluster, a, b, silhouette) with Euclidean distances.

    Every row is scored; only a caller who names max_n gets a seeded sample. Blocks of
    rows meet in tiles, and only distance sums per (row, cluster) leave a task: the work
    is quadratic in the rows. The result is stored.
    """
    held = points.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("x"), F.col(cluster).cast("string").alias("cluster"))
    pts = durable(sample_rows(held, max_n, seed, "id"))
    sums = blocks.cluster_sums(pts, pts.count(), block)
    sizes = pts.groupBy("cluster").agg(F.count("*").alias("_n"))
    own = F.col("other") == F.col("cluster")
    joined = sums.join(pts.select("id", "cluster"), "id").join(sizes.withColumnRenamed("cluster", "other"), "other")
    per = joined.groupBy("id", "cluster").agg(
        F.max(F.when(own & (F.col("_n") > 1), F.col("total") / (F.col("_n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("_n"))).alias("b"))
    return durable(per.withColumn("silhouette", F.expr(
        "IF(b IS NULL, NULL, coalesce(IF(greatest(a, b) > 0, (b - a) / greatest(a, b), 0D), 0D))")))


def silhouette_summary(rows: DataFrame) -> DataFrame:
    """Mean, median and quartiles per cluster."""
    return describe(rows, "silhouette", ["cluster"], compact=False).select("cluster", "n", "mean", "median", "p25", "p75")


def silhouette_overall(rows: DataFrame, n_total: int | None = None) -> DataFrame:
    neg = rows.groupBy("cluster").agg(F.avg("silhouette").alias("_m")).select(F.count_if(F.col("_m") < 0)).scalar()
    out = rows.agg(F.avg("silhouette").alias("mean"), F.stddev_pop("silhouette").alias("std"), F.count("*").alias("n_scored"))
    return out.withColumns({"n_negative_clusters": neg, "sampled": F.col("n_scored") < F.lit(n_total if n_total is not None else 0)})


def cluster_sizes(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Summary of cluster sizes with gini, extreme shares, rare and tiny clusters."""
    sizes = labels.groupBy(cluster).agg(F.count("*").alias("size"))
    g = gini(sizes, "size").scalar()
    n = F.sum("size")
    total = sizes.agg(n).scalar()
    return sizes.withColumn("_t", total).agg(
        F.count("*").alias("n_clusters"), F.avg("size").alias("mean_size"),
        (F.max("size") / F.max("_t")).alias("frac_largest"), (F.min("size") / F.max("_t")).alias("frac_smallest"),
        F.count_if(F.col("size") / F.col("_t") < 0.05).alias("n_rare"), F.count_if(F.col("size") <= 2).alias("n_singleton"),
    ).withColumn("gini", g)


def _centroids(points: DataFrame, by, vec: str = "x") -> DataFrame:
    """Mean vector per group: dimensions are averaged apart, then put together again."""
    long = points.select(*by, F.posexplode(vec).alias("_i", "_x"))
    means = long.groupBy(*by, "_i").agg(F.avg("_x").alias("_x"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_c"))


def _sq(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def compactness(points: DataFrame, cluster: str = "cluster", vec: str = "x") -> DataFrame:
    """Davies-Bouldin, Calinski-Harabasz, WCSS, BCSS and their ratio."""
    pts = points.select(F.col(cluster).alias("_k"), F.col(vec).cast("array<double>").alias("x"))
    cent = durable(_centroids(pts, ["_k"]))
    whole = _centroids(pts, []).scalar()
    per = durable(
        pts.join(cent, "_k").withColumn("_d2", _sq("x", "_c")).groupBy("_k").agg(
            F.count("*").alias("_n"), F.avg(F.sqrt("_d2")).alias("_s"), F.sum("_d2").alias("_w"))
        .join(cent, "_k").withColumn("_g", whole).withColumn("_b", F.col("_n") * _sq("_c", "_g")))
    others = per.select(F.collect_list(F.struct("_k", "_s", "_c"))).scalar()
    # Clusters against clusters: a small table against its own list.
    worst = (
        per.select("_k", "_s", "_c").withColumn("_o", others).select("_k", "_s", "_c", F.explode("_o").alias("_z"))
        .select("_k", "_s", "_c", F.col("_z._k").alias("_k2"), F.col("_z._s").alias("_s2"), F.col("_z._c").alias("_c2"))
        .where("_k <> _k2").groupBy("_k").agg(F.max(F.try_divide(F.col("_s") + F.col("_s2"), F.sqrt(_sq("_c", "_c2")))).alias("_r"))
    )
    db = worst.agg(F.avg("_r")).scalar()
    return per.agg(F.sum("_w").alias("wcss"), F.sum("_b").alias("bcss"), F.sum("_n").alias("_n"), F.count("*").alias("_k")).select(
        db.alias("davies_bouldin"),
        F.expr("try_divide(try_divide(bcss, _k - 1), try_divide(wcss, _n - _k))").alias("calinski_harabasz"),
        "wcss", "bcss", F.expr("try_divide(wcss, bcss)").alias("wcss_bcss_ratio"))


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    return labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def ari_nmi(table: DataFrame, by=()) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of contingency counts (by, a, b, n)."""
    by = list(by)
    pairs = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)
    plogp = lambda n: F.sum(F.col(n) * F.log(F.col(n).cast("double")))
    joint = table.groupBy(*by).agg(F.sum("n").alias("_t"), pairs("n").alias("_ij"), plogp("n").alias("_lij"))
    side = lambda c: table.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(pairs("m").alias(f"_{c}"), plogp("m").alias(f"_l{c}"))
    if by:
        all_ = joint.join(side("a"), by).join(side("b"), by)
    else:
        one = lambda c: side(c).select(F.struct(f"_{c}", f"_l{c}")).scalar()
        all_ = joint.withColumn("_x", one("a")).withColumn("_y", one("b")).select("*", "_x.*", "_y.*")
    return all_.selectExpr(
        "*", "_t * (_t - 1) / 2D AS _all", "try_divide(_a * _b, _t * (_t - 1) / 2D) AS _exp",
        "ln(_t) - _la / _t AS _ha", "ln(_t) - _lb / _t AS _hb", "ln(_t) + (_lij - _la - _lb) / _t AS _mi",
    ).selectExpr(
        *by,
        "IF(abs((_a + _b) / 2 - _exp) < 1e-12D, 1D, (_ij - _exp) / ((_a + _b) / 2 - _exp)) AS ari",
        "IF(_ha + _hb < 1e-12D, 1D, greatest(2 * _mi / (_ha + _hb), 0D)) AS nmi")


def adjacent_agreement(labels: DataFrame, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """ARI and NMI of neighbouring resolutions; ``labels`` is (id, resolution, cluster)."""
    step = {a: b for a, b in zip(order, order[1:])}
    nxt = F.create_map(*[F.lit(x) for kv in step.items() for x in kv])
    left = labels.where(F.col("resolution").isin(list(step))).select(
        id_col, F.col("resolution").alias("r1"), F.try_element_at(nxt, F.col("resolution")).alias("r2"), F.col("cluster").alias("a"))
    right = labels.select(id_col, F.col("resolution").alias("r2"), F.col("cluster").alias("b"))
    table = left.join(right, [id_col, "r2"]).groupBy("r1", "r2", "a", "b").agg(F.count("*").alias("n"))
    return ari_nmi(durable(table), ["r1", "r2"])


def persistence(labels: DataFrame, chosen: str, id_col: str = "id") -> DataFrame:
    """Per chosen cluster: mean over other resolutions of its best Jaccard; stable at 0.7."""
    base = labels.where(F.col("resolution") == chosen).select(id_col, F.col("cluster").alias("c"))
    rest = labels.where(F.col("resolution") != chosen).select(id_col, "resolution", F.col("cluster").alias("o"))
    both = base.join(rest, id_col).groupBy("resolution", "c", "o").agg(F.count("*").alias("_i"))
    nc = base.groupBy("c").agg(F.count("*").alias("_nc"))
    no = rest.groupBy("resolution", "o").agg(F.count("*").alias("_no"))
    best = both.join(nc, "c").join(no, ["resolution", "o"]).groupBy("resolution", "c").agg(
        F.max(F.expr("_i / (_nc + _no - _i)")).alias("_j"))
    return best.groupBy("c").agg(F.avg("_j").alias("persistence")).select(
        F.col("c").alias("cluster"), "persistence", (F.col("persistence") >= 0.7).alias("stable"))


def resolution_counts(labels: DataFrame, order: Sequence[str]) -> DataFrame:
    """Clusters per resolution, change from the one before, and whether it is the knee.

    The knee follows the largest drop, if any count drops at all.
    """
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(order) for x in (r, i)])
    counts = labels.groupBy("resolution").agg(F.count_distinct("cluster").alias("n_clusters")).withColumn(
        "_o", F.try_element_at(ranks, F.col("resolution"))).where("_o IS NOT NULL")
    w = W.partitionBy(F.lit(1)).orderBy("_o")
    diff = counts.withColumn("change", F.col("n_clusters") - F.lag("n_clusters").over(w))
    worst = diff.agg(F.min_by("_o", F.when(F.col("change") < 0, F.struct("change", "_o")))).scalar()
    return diff.withColumn("_k", worst).select("resolution", "n_clusters", "change", (F.col("_o") == F.col("_k")).alias("is_knee")).withColumn(
        "is_knee", F.coalesce("is_knee", F.lit(False)))


def choose_resolution(labels: DataFrame, target: str | None, id_col: str = "id") -> DataFrame:
    """Labels of an explicitly named resolution; there is no automatic choice."""
    if target is None or not str(target).strip():
        raise ValueError("name the resolution to use; it is never chosen silently")
    picked = labels.where(F.col("resolution") == str(target)).select(id_col, "cluster")
    if picked.isEmpty():
        raise ValueError(f"resolution {target} has not been clustered")
    return picked


def graph_clusters(points: DataFrame, ks: Sequence[int], seed: int = 0, id_col: str = "id", vec: str = "x") -> DataFrame:
    """(id, resolution, cluster) by seeded k-means for several granularities."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    pts = durable(points.select(F.col(id_col).alias("id"), array_to_vector(F.col(vec).cast("array<double>")).alias("features")))
    out = None
    for k in ks:
        got = KMeans(k=k, seed=seed, maxIter=20).fit(pts).transform(pts).select(
            "id", F.lit(str(k)).alias("resolution"), F.col("prediction").cast("string").alias("cluster"))
        out = got if out is None else out.unionByName(got)
    return out


def power_clusters(edges: DataFrame, k: int, max_iter: int = 20) -> DataFrame:
    """(id, cluster) by power iteration on the weighted graph; ids are numbers."""
    from pyspark.ml.clustering import PowerIterationClustering

    pic = PowerIterationClustering(k=k, maxIter=max_iter, weightCol="weight")
    half = edges.where("src < dst").select(F.col("src").cast("long"), F.col("dst").cast("long"), "weight")
    return pic.assignClusters(half).select("id", F.col("cluster").cast("string"))


def trustworthiness(points: DataFrame, k: int = 15, max_n: int | None = None, seed: int = 0, high: str = "x", low: str = "y", id_col: str = "id") -> DataFrame:
    """How far neighbours in the layout are neighbours in the full space, over all rows (a seeded sample if max_n is named).

    A layout neighbour's rank in the full space is the number of rows that
    are closer, ties by id. Blocks of rows meet in tiles, each pair of tiles in a task.
    """
    pts = durable(sample_rows(points.select(F.col(id_col).alias("id"), F.col(high).cast("array<double>").alias("x"), F.col(low).cast("array<double>").alias("y")), max_n, seed, "id"))
    near = knn_join(pts.select("id", F.col("y").alias("x")), k).select("id", "nbr")
    asked = near.join(pts.select("id", "x"), "id").join(pts.select(F.col("id").alias("nbr"), F.col("x").alias("_nx")), "nbr").withColumn("_d", F.round(F.sqrt(_sq("x", "_nx")), 12))
    per = asked.groupBy("id").agg(F.collect_list("nbr").alias("nbrs"), F.collect_list("_d").alias("dists"))
    total = pts.count()
    # The number of closer rows and the neighbour itself, less k.
    over = F.greatest(F.col("closer") + 1 - k, F.lit(0))
    n = F.lit(total).cast("double")
    return blocks.closer_rows(per, pts.select("id", "x"), total).agg(F.sum(over).alias("_s")).select(
        (1 - 2 / (n * k * (2 * n - 3 * k - 1)) * F.coalesce("_s", F.lit(0))).alias("trustworthiness"))


def continuity(points: DataFrame, k: int = 16, max_n: int | None = None, seed: int = 0, high: str = "x", low: str = "y", id_col: str = "id") -> DataFrame:
    """Mean share of full-space neighbours kept in the layout, over all rows (a seeded sample if max_n is named)."""
    pts = durable(sample_rows(points.select(F.col(id_col).alias("id"), F.col(high).alias("x"), F.col(low).alias("y")), max_n, seed, "id"))
    a = knn_join(pts.select("id", "x"), k).select("id", "nbr")
    b = knn_join(pts.select("id", F.col("y").alias("x")), k).select("id", "nbr", F.lit(1).alias("_hit"))
    return a.join(b, ["id", "nbr"], "left").agg((F.count("_hit") / F.count("*")).alias("continuity"))


def layout_separation(points: DataFrame, max_n: int | None = None, seed: int = 0, low: str = "y", cluster: str = "cluster", id_col: str = "id") -> DataFrame:
    """Mean distance within and across clusters of a layout, and their ratio, over all rows.

    First the mean per cluster, then the mean of the clusters' means.
    """
    pts = durable(sample_rows(points.select(F.col(id_col).alias("id"), F.col(low).cast("array<double>").alias("x"), F.col(cluster).cast("string").alias("cluster")), max_n, seed, "id"))
    sums = blocks.cluster_sums(pts, pts.count()).join(pts.select("id", "cluster"), "id")
    n = pts.groupBy("cluster").agg(F.count("*").alias("_n"))
    total = pts.select(F.count("*")).scalar()
    own = F.col("other") == F.col("cluster")
    per = sums.groupBy("cluster").agg(
        F.sum(F.when(own, F.col("total"))).alias("_in"), F.sum(F.when(~own, F.col("total"))).alias("_out")
    ).join(n, "cluster").where("_n >= 2").withColumn("_t", total)
    return per.agg(
        F.avg(F.expr("_in / (_n * (_n - 1))")).alias("mean_within"), F.avg(F.expr("try_divide(_out, _n * (_t - _n))")).alias("mean_across")
    ).withColumn("separation", F.try_divide("mean_across", "mean_within"))


def layout_ranges(points: DataFrame, low: str = "y") -> DataFrame:
    x, y = F.col(low)[0], F.col(low)[1]
    return points.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def bbox_overlaps(points: DataFrame, cluster: str = "cluster", low: str = "y") -> DataFrame:
    """Cluster pairs whose bounding boxes meet: one box per cluster against the list of boxes."""
    x, y = F.col(low)[0], F.col(low)[1]
    box = points.groupBy(F.col(cluster).alias("_k")).agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"))
    listed = box.select(F.collect_list(F.struct("_k", "a", "b", "c", "d"))).scalar()
    return box.withColumn("_l", listed).select("*", F.explode("_l").alias("o")).where(
        "_k < o._k AND a <= o.b AND o.a <= b AND c <= o.d AND o.c <= d").select(F.count("*").alias("n_overlaps"))
