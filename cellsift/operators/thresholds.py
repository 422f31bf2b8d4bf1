"""Threshold rules on cluster features, and the search over their grid."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.functions.fixed import HIERARCHY_WEIGHT
from cellsift.operators.evaluate import f1, first_entries, weight
from cellsift.session import durable

# The searched thresholds.
GRID = {
    "diff_decisive": [1, 2, 3, 4, 5],
    "ratio_tied": [1.05, 1.1, 1.15, 1.2, 1.25, 1.3],
    "pct2_high": [0.5, 0.6, 0.7, 0.8],
    "ratio_medium": [1.0, 1.01, 1.02, 1.05, 1.08, 1.1, 1.15, 1.2, 1.3, 1.4, 1.5, 1.8, 2.0],
}
RATIO_HIGH = 2.0


def cluster_features(gaps: DataFrame, top_rows: DataFrame, by=("cluster",)) -> DataFrame:
    """Gap numbers of a cluster and the largest outside share of its top markers."""
    pct2 = top_rows.groupBy(*by).agg(F.max("pct2").alias("max_top_pct2"))
    return gaps.join(pct2, list(by), "left").select(
        *by, "first_type", "second_type", "first_count", "second_count",
        F.coalesce("count_diff", F.lit(0)).alias("count_diff"),
        F.coalesce("count_ratio", F.lit(0.0)).alias("count_ratio"),
        F.coalesce("related", F.lit(False)).alias("related"),
        F.coalesce("max_top_pct2", F.lit(0.0)).alias("max_top_pct2"),
        "n_candidates",
    )


def rule_predict(features: DataFrame) -> DataFrame:
    """Gap decision, confirmation and confidence; thresholds are columns of the row."""
    gap = (
        F.when(F.col("count_diff") >= F.col("diff_decisive"), "first_decisive")
        .when(F.col("count_ratio") >= RATIO_HIGH, "ambiguous_true")
        .when(F.col("related"), "ambiguous_parent_child")
        .when((F.col("count_ratio") < F.col("ratio_tied")) & (F.col("second_count") > 0), "ambiguous_synonym")
        .otherwise("first_decisive")
    )
    down = (F.col("max_top_pct2") > F.col("pct2_high")) | (F.col("count_ratio") < F.col("ratio_medium"))
    return features.withColumns(
        {
            "gap_decision": gap,
            "label_confirm": F.when(down, "label_downgraded").otherwise("label_confirmed"),
            "confidence": F.when(down, "low").when(F.col("count_ratio") >= RATIO_HIGH, "high").otherwise("medium"),
        }
    )


def threshold_grid(spark: SparkSession, grid: dict | None = None) -> DataFrame:
    """One row per combination, with a grid_id."""
    grid = grid or GRID
    rows = [(i, *map(float, combo)) for i, combo in enumerate(product(*grid.values()))]
    return spark.createDataFrame(rows, "grid_id int, " + ", ".join(f"{k} double" for k in grid))


def _corner(value: Column, levels: Column, passed) -> Column:
    """How many levels of an axis a value has passed: the corner of its box."""
    return F.size(F.filter(levels, lambda level: passed(value, level)))


def low_counts(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """(grid_id, n_low): rows of low confidence under each combination, by a summed-area table.

    A row is not low where its outside share is at most ``pct2_high`` and its ratio at least ``ratio_medium``: a box of
    the grid. Boxes are counted at their corners, the corners are summed along both axes, and each combination reads its
    cell. The tables have at most (levels + 1) squared rows; no row meets the grid.
    """
    axes = {c: grid.select(F.array_sort(F.collect_set(c))).scalar() for c in ("pct2_high", "ratio_medium")}
    placed = rows.withColumns({f"_{c}": axis for c, axis in axes.items()}).select(
        _corner(F.col("max_top_pct2"), F.col("_pct2_high"), lambda v, level: v > level).alias("_p"),
        _corner(F.col("count_ratio"), F.col("_ratio_medium"), lambda v, level: v >= level).alias("_m"))
    corners = placed.groupBy("_p", "_m").agg(F.count("*").alias("_n"))
    cell = grid.withColumns({f"_{c}": axis for c, axis in axes.items()}).select(
        "grid_id", F.array_position("_pct2_high", F.col("pct2_high")).alias("_i"), F.array_position("_ratio_medium", F.col("ratio_medium")).alias("_j"))
    spread = cell.select((F.col("_i") - 1).alias("_p"), F.col("_j").alias("_m"), F.lit(0).alias("_n")).distinct().unionByName(corners)
    table = spread.groupBy("_p", "_m").agg(F.sum("_n").alias("_n"))
    # The number of levels bounds the table and the windows.
    along = W.partitionBy("_m").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    every = spread.select("_p").distinct().withColumn("_ms", spread.select(F.collect_set("_m")).scalar()).select("_p", F.explode("_ms").alias("_m"))
    full = every.join(table, ["_p", "_m"], "left").fillna(0, ["_n"])
    summed = full.withColumn("_n", F.sum("_n").over(along))
    across = W.partitionBy("_p").orderBy(F.desc("_m")).rowsBetween(W.unboundedPreceding, 0)
    summed = summed.withColumn("_n", F.sum("_n").over(across))
    total = rows.select(F.count("*")).scalar()
    return cell.join(summed, (F.col("_i") - 1 == F.col("_p")) & (F.col("_j") == F.col("_m"))).select("grid_id", (total - F.col("_n")).alias("n_low"))


def threshold_search(features: DataFrame, tops: DataFrame, entries: DataFrame, grid: DataFrame, k: int | None = None) -> DataFrame:
    """Cluster-level strict, relaxed, macro F1 and low-confidence count of every combination.

    ``tops`` is (cluster, true); combinations are ordered by strict, then relaxed. The thresholds decide confidence only,
    so the scores are worked out once and the low ones are counted by ``low_counts``.
    """
    base = durable(
        features.where("first_type IS NOT NULL")
        .join(tops.select("cluster", "true"), "cluster")
        .join(first_entries(entries).withColumnRenamed("predicted", "first_type"), "first_type", "left")
        .withColumn("relation", F.coalesce("relation", F.lit("unmatched")))
        .withColumn("w", weight(HIERARCHY_WEIGHT, "relation"))
    )
    totals = base.agg(
        F.avg(F.col("relation").isin("exact", "synonym").cast("int")).alias("strict"), F.avg("w").alias("relaxed"), F.count("*").alias("n_clusters"))
    right = (F.col("w") > 0) & (F.col("mapped") == F.col("true"))
    wrong = (F.col("w") > 0) & (F.col("mapped") != F.col("true"))
    own = base.groupBy(F.col("true").alias("type")).agg(
        F.sum(F.when(right, F.col("w")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(wrong, F.col("w")).when(~right, 1.0).otherwise(0.0)).alias("fn"),
    )
    lost = base.where(wrong).groupBy(F.col("mapped").alias("type")).agg(F.sum("w").alias("fp"))
    macro = f1(own.join(lost, "type", "full_outer").fillna(0.0, ["tp", "fn", "fp"])).agg(F.avg("f1").alias("macro_f1"))
    # One row of scores rides along with the grid; without clusters there is no combination.
    scores = totals.withColumn("macro_f1", macro.scalar()).where("n_clusters > 0").select(F.struct("strict", "relaxed", "n_clusters", "macro_f1")).scalar()
    out = grid.join(low_counts(base, grid), "grid_id").withColumn("_s", scores).where("_s IS NOT NULL").select(*grid.columns, "_s.*", "n_low")
    return out.orderBy(F.col("strict").desc(), F.col("relaxed").desc(), "grid_id").limit(k) if k else out


def baseline(features: DataFrame, tops: DataFrame, entries: DataFrame) -> DataFrame:
    """The same scores when no rule is applied: first candidate, high confidence."""
    one = {"diff_decisive": [0], "ratio_tied": [0.0], "pct2_high": [2.0], "ratio_medium": [0.0]}
    return threshold_search(features, tops, entries, threshold_grid(features.sparkSession, one)).select(
        "strict", "relaxed", "macro_f1", "n_clusters", F.lit(0).alias("n_low"))
