"""Nearest neighbours and the cell graph: edges, components, modularity, autocorrelation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.operators import blocks
from cellsift.operators.distribution import describe
from cellsift.operators.hot import hot_bound, hot_join, least_neighbors
from cellsift.session import durable


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    # The expanded form loses small distances; those are taken directly.
    near = d < 1e-6 * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :])
    i, j = np.nonzero(near)
    if len(i):
        d[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(np.maximum(d, 0.0))


def _top(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("id").orderBy("dist", "nbr")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(points: DataFrame, k: int = 15, id_col: str = "id", vec: str = "x", pivots: int = 16, block: int = 2048) -> DataFrame:
    """Exact k nearest neighbours (id, nbr, dist, rank), the row itself excluded; ties go to the smaller id. The result is stored.

    Points are packed into blocks of close ones (``pivots`` cells at least), and a row meets the blocks that may hold a
    nearer point than its own, see ``blocks``. Of equal vectors the k + 1 smallest ids meet the others: no further copy can be
    a neighbour of anything, and it has the neighbours of the first. Rows with a null vector or id are left out.
    """
    return without_copies(points, k, id_col, vec, lambda kept: blocks.nearest(kept, k, block, pivots))


def without_copies(points: DataFrame, k: int, id_col: str, vec: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, nbr, dist, rank) of all rows by a ``search`` of stored rows (id, x) that hold at most k + 1 copies of a vector."""
    held = durable(points.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL"))
    keyed = held.withColumn("_h", F.xxhash64("x"))
    # row_number() <= k + 1 is cut before the shuffle, so copies do not move whole.
    copies = keyed.withColumn("_n", F.row_number().over(W.partitionBy("_h", "x").orderBy("id")))
    kept = durable(copies.where(F.col("_n") <= k + 1))
    found = durable(search(kept.select("id", "x")))
    if kept.count() == held.count():
        return found
    heads = kept.where("_n = 1").select("_h", "x", F.col("id").alias("_first"))
    lists = found.join(heads.select(F.col("_first").alias("id")), "id").groupBy(F.col("id").alias("_first")).agg(F.collect_list(F.struct("dist", "nbr")).alias("_l"))
    own = F.array(F.struct(F.lit(0.0).alias("dist"), F.col("_first").alias("nbr")))
    answers = heads.join(lists, "_first").select("_h", "x", F.slice(F.sort_array(F.concat("_l", own)), 1, k).alias("_l"))
    rest = durable(keyed.join(kept.select("id"), "id", "left_anti"))
    more = hot_join(rest, durable(answers), ["_h", "x"], "inner").select("id", F.posexplode("_l").alias("_p", "_s")).select(
        "id", "_s.nbr", "_s.dist", (F.col("_p") + 1).cast("int").alias("rank"))
    return durable(found.unionByName(more))


def knn_graph(neighbors: DataFrame) -> DataFrame:
    """Weighted symmetric edges (src, dst, weight), both directions present.

    Stated kernel: exp(-(d - nearest) / mean gap) per row, joined for the two
    directions as a + b - ab.
    """
    local = neighbors.groupBy("id").agg(F.min("dist").alias("_near"), F.avg("dist").alias("_mean"))
    one = neighbors.join(local, "id").select(
        F.col("id").alias("src"), F.col("nbr").alias("dst"),
        F.exp(-(F.col("dist") - F.col("_near")) / F.greatest(F.col("_mean") - F.col("_near"), F.lit(1e-12))).alias("w"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    # At most two rows meet per pair: its two directions.
    return both.groupBy("src", "dst").agg(
        F.sum("w").alias("_s"), F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0).alias("_p")
    ).select("src", "dst", (F.col("_s") - F.col("_p")).alias("weight"))


def graph_stats(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """Density, degree summary, isolated share: one row."""
    degree = edges.groupBy("src").agg(F.sum("weight").alias("degree"))
    full = nodes.select(F.col(id_col).alias("src")).join(degree, "src", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    n_edges = edges.select(F.count("*")).scalar()
    median = describe(full, "degree", compact=False).select("median").scalar()
    return full.agg(
        F.count("*").alias("n_nodes"), F.avg("degree").alias("mean_degree"),
        F.avg((F.col("degree") == 0).cast("int")).alias("frac_isolated"),
    ).withColumns({"n_edges": n_edges, "median_degree": median}).withColumn(
        "density", F.col("n_edges") / F.greatest(F.col("n_nodes") * F.col("n_nodes"), F.lit(1)))


def connected_components(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, component): smallest id reachable; a node without edges is its own component. One direction of an edge is enough.

    Of many links each node first keeps two, which already join most of a component; all links are then read once
    more, and those between two such parts are solved the same way, see ``_lowest``.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    found = _lowest(durable(edges.where("src <> dst").select(high.alias("a"), low.alias("b"))))
    ids = nodes.select(F.col(id_col).alias("id"))
    return ids.join(found.select(F.col("a").alias("id"), F.col("b").alias("_low")), "id", "left").select(
        "id", F.coalesce("_low", "id").alias("component"))


def _lowest(links: DataFrame) -> DataFrame:
    """(a, b): every node of ``links`` (stored, a > b) but the smallest of its component, with that smallest node.

    Each node picks its links to the smallest and the largest neighbour, and stars solve these picks. A link whose ends
    got the same node is done; the others become links between these nodes. As every node picks, there are at most half
    as many nodes each time. A hub's links are not gathered: its node is broadcast.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = durable(both.groupBy("a").agg(F.min("b").alias("_l"), F.max("b").alias("_h"), F.count("*").alias("_n")))
    size = ends.agg(F.count("*"), F.sum("_n")).first()
    rows = (size[1] or 0) // 2
    if rows <= 4 * size[0]:
        return _stars(durable(links.distinct()))
    picks = ends.select("a", F.explode(F.array("_l", "_h")).alias("b"))
    found = _stars(durable(picks.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    names = durable(ends.join(found, "a", "left").select("a", "_n", F.coalesce("b", "a").alias("m")))
    hubs = names.where(F.col("_n") >= hot_bound(rows))
    few, left = hubs.count(), links
    for end in ("a", "b"):
        named = names.select(F.col("a").alias(end), F.col("m").alias(f"_{end}"))
        if few:
            seen = left.join(F.broadcast(hubs.select(F.col("a").alias(end), F.col("m").alias("_hub"))), end, "left")
            near = seen.where("_hub IS NOT NULL").withColumnRenamed("_hub", f"_{end}")
            left = durable(near.unionByName(seen.where("_hub IS NULL").drop("_hub").join(named, end)))
        else:
            left = left.join(named, end)
    rest = durable(left.where("_a <> _b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct())
    if rest.isEmpty():
        return found
    more = _lowest(rest)
    joined = hot_join(found, durable(more.select(F.col("a").alias("b"), F.col("b").alias("m"))), ["b"])
    return durable(joined.select("a", F.coalesce("m", "b").alias("b")).unionByName(more))


def _stars(now: DataFrame) -> DataFrame:
    """(a, b) as ``_lowest``, of stored distinct links.

    Two-phase stars, until nothing changes: every node passes the smallest id of its neighbourhood to its larger
    neighbours, then a node and its smaller neighbours take the smallest of these. The links are stored every round,
    so the plan does not grow and a lost executor costs one round. The minima are combined before the shuffle, and a
    hub's links are not gathered (see ``least_neighbors``), so no task holds a hub.
    """
    rows, mark = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = durable(least_neighbors(both, 2 * rows).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        rows = large.count()
        small = least_neighbors(large, rows)
        now = durable(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))).distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            # Every larger node now has one link, to the smallest node of its component.
            return now
        rows, mark = new[0], new


def clustering_coefficient(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """Mean local clustering coefficient.

    Every undirected edge is pointed from its lower-degree end to the higher, so a
    hub has few outgoing edges and no node opens the square of its degree in pairs.
    """
    und = edges.where("src <> dst").select("src", "dst").distinct()
    deg = und.groupBy("src").agg(F.count("*").alias("_d"))
    ranked = und.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("_d").alias("_e")), "dst")
    up = durable(ranked.where("_d < _e OR (_d = _e AND src < dst)").select("src", "dst"))
    wedge = up.select("src", F.col("dst").alias("a")).join(up.select("src", F.col("dst").alias("b")), "src").where("a < b")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    closed = wedge.join(
        up.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), ["a", "b"], "left_semi")
    corners = closed.select(F.explode(F.array("src", "a", "b")).alias("src")).groupBy("src").agg(F.count("*").alias("_t"))
    local = nodes.select(F.col(id_col).alias("src")).join(deg, "src", "left").join(corners, "src", "left").select(
        F.when(F.col("_d") > 1, 2 * F.coalesce("_t", F.lit(0)) / (F.col("_d") * (F.col("_d") - 1))).otherwise(0.0).alias("_c"))
    return local.agg(F.avg("_c").alias("clustering_coefficient"))


def modularity(edges: DataFrame, labels: DataFrame, id_col: str = "id", cluster: str = "cluster") -> DataFrame:
    """Weighted Newman modularity; null on a graph without weight."""
    lab = labels.select(F.col(id_col).alias("src"), F.col(cluster).alias("_a"))
    placed = edges.join(lab, "src").join(lab.select(F.col("src").alias("dst"), F.col("_a").alias("_b")), "dst")
    per = placed.groupBy("_a").agg(
        F.sum("weight").alias("_k"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("_e"))
    m2 = per.agg(F.sum("_k")).scalar()
    return per.withColumn("_m", m2).agg(
        F.sum(F.try_divide("_e", "_m") - F.pow(F.try_divide("_k", "_m"), 2)).alias("modularity"))


def autocorrelation(edges: DataFrame, values: DataFrame, value: str = "value", by=(), id_col: str = "id") -> DataFrame:
    """Moran's I and Geary's C of a value on the graph; null for a constant."""
    by = list(by)
    v = values.select(*by, F.col(id_col).alias("_id"), F.col(value).cast("double").alias("_x"))
    stats = v.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_x").alias("_m"), (F.var_pop("_x") * F.count("*")).alias("_ss"))
    ends = edges.join(v.withColumnsRenamed({"_id": "src", "_x": "_xs"}), "src").join(
        v.withColumnsRenamed({"_id": "dst", "_x": "_xd"}), [*by, "dst"])
    if by:
        placed = ends.join(stats, by)
    else:
        placed = ends.withColumn("_t", stats.select(F.struct("_n", "_m", "_ss")).scalar()).select("*", "_t.*")
    sums = placed.groupBy(*by).agg(
        F.sum("weight").alias("_w"), F.sum(F.expr("weight * (_xs - _m) * (_xd - _m)")).alias("_i"),
        F.sum(F.expr("weight * (_xs - _xd) * (_xs - _xd)")).alias("_g"), F.max("_n").alias("_n"), F.max("_ss").alias("_ss"))
    return sums.selectExpr(
        *by, "IF(_ss > 1e-18D, _n / _w * _i / _ss, NULL) AS morans_i", "IF(_ss > 1e-18D, (_n - 1) * _g / (2 * _w * _ss), NULL) AS gearys_c")


def batch_autocorrelation(edges: DataFrame, labels: DataFrame, batch: str = "batch", id_col: str = "id") -> DataFrame:
    """Moran's I of every batch's one-hot indicator.

    For a 0/1 value the sums follow from edge weights inside the batch and the
    batch's degree, so no indicator column is spread over all cells.
    """
    lab = labels.select(F.col(id_col).alias("src"), F.col(batch).alias("_a"))
    placed = edges.join(lab, "src").join(lab.select(F.col("src").alias("dst"), F.col("_a").alias("_b")), "dst")
    per = placed.groupBy("_a").agg(
        F.sum("weight").alias("_k"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("_in"))
    total = per.agg(F.sum("_k")).scalar()
    sizes = labels.groupBy(F.col(batch).alias("_a")).agg(F.count("*").alias("_c"))
    n = labels.select(F.count("*")).scalar()
    # With mean m: sum w (x-m)(y-m) = inside - 2 m degree + m^2 W; sum (x-m)^2 = n m (1-m).
    return sizes.join(per, "_a", "left").withColumns({"_w": total, "_n": n}).withColumn("_m", F.col("_c") / F.col("_n")).selectExpr(
        f"_a AS {batch}", """IF(_m < 1, _n / _w * (coalesce(_in, 0D) - 2 * _m * coalesce(_k, 0D) + _m * _m * _w) / (_n * _m * (1 - _m)), NULL) AS morans_i""")
