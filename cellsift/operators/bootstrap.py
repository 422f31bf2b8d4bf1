"""Cluster bootstrap of the evaluation metrics, as one grouped job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

METRICS = ("strict", "relaxed", "macro_f1")


def contributions(scored: DataFrame) -> DataFrame:
    """What one copy of a cluster adds to every true type: n, strict, relaxed, tp, fp, fn."""
    hit = F.col("hierarchy_weight") > 0
    n = F.col("n").cast("double")
    own = scored.select(
        "run", "cluster", F.col("true").alias("type"), n.alias("n"),
        (n * F.col("accuracy_weight")).alias("strict"), (n * F.col("hierarchy_weight")).alias("relaxed"),
        F.when(hit, n * F.col("hierarchy_weight")).otherwise(0.0).alias("tp"), F.lit(0.0).alias("fp"),
        F.when(~hit, n).otherwise(0.0).alias("fn"),
    )
    zero = F.lit(0.0)
    lost = scored.where(~hit & (F.col("mapped_true") != F.col("true"))).select(
        "run", "cluster", F.col("mapped_true").alias("type"), zero.alias("n"), zero.alias("strict"), zero.alias("relaxed"),
        zero.alias("tp"), n.alias("fp"), zero.alias("fn"))
    known = scored.select(F.col("true").alias("type")).distinct()
    return (
        own.unionByName(lost.join(known, "type", "left_semi").select(own.columns))
        .groupBy("run", "cluster", "type")
        .agg(*[F.sum(c).alias(c) for c in ("n", "strict", "relaxed", "tp", "fp", "fn")])
    )


def draws(clusters: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """(run, draw, cluster, copies): each draw takes as many clusters as the run has, with replacement.

    Slot s of draw b picks cluster xxhash64(seed, run, b, s) mod k, so a draw is the
    same on every cluster and after every retry. A run's cluster list is small.
    """
    w = W.partitionBy("run").orderBy("cluster")
    placed = clusters.select("run", "cluster").distinct().withColumn("_i", F.row_number().over(w) - 1)
    sizes = placed.groupBy("run").agg(F.count("*").alias("_k"))
    slots = (
        sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .repartition("run", "draw")
        .select("run", "draw", "_k", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_s"))
    )
    pick = F.pmod(F.xxhash64(F.lit(seed), "run", "draw", "_s"), F.col("_k")).cast("int")
    return (
        slots.groupBy("run", "draw", pick.alias("_i")).agg(F.count("*").alias("copies"))
        .join(placed, ["run", "_i"]).select("run", "draw", "cluster", "copies")
    )


def boot_metrics(scored: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """strict, relaxed and macro_f1 of every (run, draw)."""
    parts = contributions(scored)
    n_types = scored.select(F.count_distinct("true")).scalar()
    per_type = (
        draws(scored, n_boot, seed).join(parts, ["run", "cluster"])
        .groupBy("run", "draw", "type")
        .agg(*[F.sum(F.col("copies") * F.col(c)).alias(c) for c in ("n", "strict", "relaxed", "tp", "fp", "fn")])
        .selectExpr("*", "coalesce(try_divide(tp, tp + fp), 0D) AS p", "coalesce(try_divide(tp, tp + fn), 0D) AS r")
        .selectExpr("*", "coalesce(try_divide(2 * p * r, p + r), 0D) AS f1")
    )
    return per_type.groupBy("run", "draw").agg(
        F.sum("n").alias("_n"), F.sum("strict").alias("_s"), F.sum("relaxed").alias("_x"), F.sum("f1").alias("_f"),
    ).select(
        "run", "draw", (F.col("_s") / F.col("_n")).alias("strict"), (F.col("_x") / F.col("_n")).alias("relaxed"),
        (F.col("_f") / n_types).alias("macro_f1"),
    )


def _spread(values: DataFrame, by, n_boot: int) -> DataFrame:
    """Mean and the values at the 2.5 % and 97.5 % index; a group holds n_boot rows."""
    low, high = int(0.025 * n_boot) + 1, max(int(0.975 * n_boot), 1)
    w = W.partitionBy(*by, "metric").orderBy("value", "draw")
    return values.withColumn("_r", F.row_number().over(w)).groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"),
        F.max(F.when(F.col("_r") == low, F.col("value"))).alias("ci_low"),
        F.max(F.when(F.col("_r") == high, F.col("value"))).alias("ci_high"),
    )


def _long(df: DataFrame, keys) -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    return df.selectExpr(*keys, "draw", f"stack({len(METRICS)}, {pairs}) AS (metric, value)")


def cluster_bootstrap(boots: DataFrame, n_boot: int = 1000) -> DataFrame:
    """Per run and metric: mean and 95 % interval."""
    return _spread(_long(boots, ["run"]), ["run"], n_boot)


def bootstrap_deltas(boots: DataFrame, n_boot: int = 1000, line: float = 0.03) -> DataFrame:
    """Per pair of runs and metric: target - ref with interval and verdict."""
    ref = _long(boots, ["run"]).withColumnsRenamed({"run": "ref", "value": "_a"})
    target = _long(boots, ["run"]).withColumnsRenamed({"run": "target", "value": "_b"})
    both = ref.join(target, ["draw", "metric"]).where("ref < target").withColumn("value", F.col("_b") - F.col("_a"))
    verdict = (
        F.when(F.col("ci_low") > line, "R1")
        .when(F.col("ci_high") < -line, "R4")
        .when((F.col("ci_low") > -0.01) & (F.col("ci_high") < 0.01), "R3")
        .otherwise("inconclusive")
    )
    return _spread(both, ["ref", "target"], n_boot).withColumn("verdict", verdict)
