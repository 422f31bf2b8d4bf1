"""Scoring of delivered labels against ground truth.

Cells are tallied once per (run, cluster, raw, confidence, status, true); every
metric reads that tally, so nothing but the tally touches row-level data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.functions.fixed import ACCURACY_WEIGHT, CONFIDENCE_WEIGHT, HIERARCHY_WEIGHT
from cellsift.functions.scalars import fold
from cellsift.operators.knowledge import canonical_name
from cellsift.session import durable

OTHER = "<other>"


def weight(table: dict, key, default: float = 0.0):
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.col(key)), F.lit(default))


def resolve_truth(df: DataFrame, pins: DataFrame, column: str = "true", out: str = "node_b") -> DataFrame:
    """Node of a true label: its pin, else the pin that is equal ignoring case."""
    kept = pins.where("trim(coalesce(node, '')) <> '' AND trim(label) <> ''").select(
        F.trim("label").alias("label"), F.trim("node").alias("node"))
    exact = kept.groupBy(F.col("label").alias("_t")).agg(F.min("node").alias("_exact"))
    loose = kept.groupBy(F.lower("label").alias("_k")).agg(F.min("node").alias("_loose"))
    return (
        df.join(exact, F.trim(column) == F.col("_t"), "left")
        .join(loose, fold(column) == F.col("_k"), "left")
        .withColumn(out, F.coalesce("_exact", "_loose"))
        .drop("_t", "_k", "_exact", "_loose")
    )


def resolve_predicted(
    df: DataFrame, pins: DataFrame, aliases: DataFrame, nodes: DataFrame | None, column: str = "raw", out: str = "node_a"
) -> DataFrame:
    """Node of a predicted label: alias, then the node of that name; blank and unknown have none.

    Without a hierarchy (``nodes`` is None) an alias or a pinned node must do.
    """
    named = aliases.where("trim(coalesce(node, '')) <> ''").groupBy(fold("alias").alias("_k")).agg(
        F.min(F.trim("node")).alias("_alias"))
    usable = (F.trim(column) != "") & (fold(column) != "unknown")
    first = df.join(named, fold(column) == F.col("_k"), "left").drop("_k")
    if nodes is None:
        pinned = pins.where("trim(coalesce(node, '')) <> ''").groupBy(fold("node").alias("_k")).agg(
            F.min(F.trim("node")).alias("_pin"))
        return (
            first.join(pinned, fold(column) == F.col("_k"), "left")
            .withColumn(out, F.when(usable, F.coalesce("_alias", "_pin")))
            .drop("_k", "_alias", "_pin")
        )
    sought = first.withColumn("_seek", F.coalesce("_alias", F.trim(column)))
    return (
        canonical_name(sought, nodes, "_seek", "_node")
        .withColumn(out, F.when(usable, F.coalesce("_node", "_alias")))
        .drop("_seek", "_node", "_alias")
    )


def label_relation(
    pairs: DataFrame, pins: DataFrame, aliases: DataFrame, nodes: DataFrame | None = None,
    ancestors: DataFrame | None = None,
) -> DataFrame:
    """Relation of distinct (raw, true) pairs, with both nodes, mapped_true and the weights.

    exact / synonym: same node; subtype: the true node is above the predicted one;
    supertype: below it; else unrelated; unmatched when a node is missing.
    """
    both = resolve_predicted(resolve_truth(pairs.select("raw", "true").distinct(), pins), pins, aliases, nodes)
    up, down = F.lit(False), F.lit(False)
    if ancestors is not None and nodes is not None:
        anc = ancestors.select(fold("name").alias("_n"), fold("ancestor").alias("_a")).distinct()
        both = (
            both.join(anc.select("*", F.lit(True).alias("_sub")), (fold("node_a") == F.col("_n")) & (fold("node_b") == F.col("_a")), "left")
            .drop("_n", "_a")
            .join(anc.select("*", F.lit(True).alias("_sup")), (fold("node_b") == F.col("_n")) & (fold("node_a") == F.col("_a")), "left")
            .drop("_n", "_a")
        )
        up, down = F.col("_sub").isNotNull(), F.col("_sup").isNotNull()
    same = fold("node_a") == fold("node_b")
    relation = (
        F.when(F.col("node_a").isNull() | F.col("node_b").isNull(), "unmatched")
        .when(same & (F.trim("raw") == F.trim("true")), "exact")
        .when(same, "synonym")
        .when(up, "subtype")
        .when(down, "supertype")
        .otherwise("unrelated")
    )
    back = pins.where("trim(coalesce(node, '')) <> ''").groupBy(fold("node").alias("_k")).agg(
        F.min(F.trim("label")).alias("mapped_true"))
    return (
        both.withColumn("relation", relation)
        .join(back, fold("node_a") == F.col("_k"), "left")
        .select(
            "raw", "true", "node_a", "node_b", "relation", "mapped_true",
            weight(ACCURACY_WEIGHT, "relation").alias("accuracy_weight"),
            weight(HIERARCHY_WEIGHT, "relation").alias("hierarchy_weight"),
        )
    )


def join_evaluation(truth: DataFrame, obs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(run, cell_id, cluster, raw, confidence, status, true) for every evaluated cell.

    Cells outside ``obs`` are dropped; a cluster that a run does not annotate is
    unknown with low confidence.
    """
    clusters = obs.select("cluster").distinct()
    runs = annotations.select(F.collect_set("run")).scalar()
    full = (
        clusters.withColumn("_runs", runs)
        .select("cluster", F.explode("_runs").alias("run"))
        .join(annotations.withColumn("_hit", F.lit(True)), ["run", "cluster"], "left")
        .select(
            "run", "cluster",
            F.when(F.col("_hit"), F.coalesce("label", F.lit("unknown"))).otherwise("unknown").alias("raw"),
            F.when(F.col("_hit"), F.coalesce("confidence", F.lit("medium"))).otherwise("low").alias("confidence"),
            F.when(F.col("_hit"), F.coalesce("status", F.lit("decisive"))).otherwise("unknown").alias("status"),
            F.col("_hit").isNotNull().alias("annotated"),
        )
    )
    return truth.select("cell_id", F.col("true_type").alias("true")).join(obs.select("cell_id", "cluster"), "cell_id").join(full, "cluster")


def unknown_clusters(cells: DataFrame) -> DataFrame:
    """Clusters without an annotation, per run."""
    return cells.where(~F.col("annotated")).select("run", "cluster").distinct()


def delivered_label(cells: DataFrame, sub_labels: DataFrame, cell_subclusters: DataFrame) -> DataFrame:
    """A cell keeps its subcluster's own label where its cluster was analyzed and has one.

    ``sub_labels``: run, cluster, subcluster, label, outcome; ``cell_subclusters``:
    run, cell_id, subcluster.
    """
    named = sub_labels.where((F.col("outcome") == "analyzed") & (F.coalesce("label", F.lit("")) != "")).select(
        "run", "cluster", "subcluster", F.col("label").alias("_own"))
    return (
        cells.join(cell_subclusters.select("run", "cell_id", "subcluster"), ["run", "cell_id"], "left")
        .join(named, ["run", "cluster", "subcluster"], "left")
        .withColumn("raw", F.coalesce("_own", "raw"))
        .drop("_own", "subcluster")
    )


def score_cells(cells: DataFrame, relations: DataFrame) -> DataFrame:
    """Cells with relation, weights, mapped true label and the diagnostic confidence weight."""
    return cells.join(relations, ["raw", "true"]).withColumns(
        {"confidence_weight": weight(CONFIDENCE_WEIGHT, "confidence", 0.5), "is_accurate": F.col("accuracy_weight") > 0}
    )


def count_cells(cells: DataFrame) -> DataFrame:
    """Cell counts per (run, cluster, raw, confidence, status, true), stored once for all metrics."""
    return durable(cells.groupBy("run", "cluster", "raw", "confidence", "status", "true").agg(F.count("*").alias("n")))


def tally(counts: DataFrame, relations: DataFrame) -> DataFrame:
    """The counts with their relation; small, and stored because every metric reads it several times."""
    return durable(counts.join(relations, ["raw", "true"]))


def type_scores(scored: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Soft TP, FP, FN and F1 per true type.

    A miss counts against the type it was mistaken for only when that type occurs.
    """
    by = list(by)
    hit = F.col("hierarchy_weight") > 0
    own = scored.groupBy(*by, F.col("true").alias("type")).agg(
        F.sum(F.when(hit, F.col("n") * F.col("hierarchy_weight")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(~hit, F.col("n")).otherwise(0)).cast("double").alias("fn"),
    )
    lost = (
        scored.where(~hit & (F.col("mapped_true") != F.col("true")))
        .groupBy(*by, F.col("mapped_true").alias("type"))
        .agg(F.sum("n").cast("double").alias("fp"))
    )
    return f1(own.join(lost, [*by, "type"], "left").fillna(0.0, ["fp"]))


def f1(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1 to tp, fp, fn; empty ratios are 0."""
    return counts.selectExpr(
        "*", "coalesce(try_divide(tp, tp + fp), 0D) AS precision", "coalesce(try_divide(tp, tp + fn), 0D) AS recall",
    ).selectExpr("*", "coalesce(try_divide(2 * precision * recall, precision + recall), 0D) AS f1")


def soft_macro_f1(scored: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    return type_scores(scored, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1_soft"))


def cluster_purity(scored: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Per cluster: size, predicted label, dominant true type and its share, accurate cells."""
    keys = [*by, "cluster"]
    per_type = scored.groupBy(*keys, "true").agg(
        F.sum("n").alias("_n"), F.sum(F.when(F.col("accuracy_weight") > 0, F.col("n")).otherwise(0)).alias("_ok"),
        F.min("raw").alias("_raw"),
    )
    # Equal counts: the first name wins.
    w = W.partitionBy(*keys).orderBy(F.col("_n").desc(), "true")
    first = per_type.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        *keys, F.col("true").alias("top_true"), F.col("_n").alias("top_true_n"))
    return per_type.groupBy(*keys).agg(
        F.sum("_n").alias("n_cells"), F.min("_raw").alias("predicted"), F.sum("_ok").alias("accurate_cells"),
    ).join(first, keys).withColumn("purity", F.col("top_true_n") / F.col("n_cells"))


def evaluate_run(scored: DataFrame, hierarchy: bool = True) -> DataFrame:
    """One row per run: accuracy, hierarchy score, macro F1, purity, confidence counts."""
    n = F.sum("n")
    share = lambda c: F.round(F.sum(F.col("n") * F.col(c)) / n, 4)
    conf = lambda c: F.sum(F.when(F.col("confidence") == c, F.col("n")).otherwise(0))
    base = scored.groupBy("run").agg(
        n.alias("n_cells"),
        share("accuracy_weight").alias("accuracy"),
        share("hierarchy_weight").alias("hierarchy_score"),
        F.round(conf("low") / n, 4).alias("low_conf_rate"),
        conf("high").alias("n_high"), conf("medium").alias("n_medium"), conf("low").alias("n_low"),
        F.sum(F.when((F.col("relation") == "unmatched") & (F.col("raw") != "unknown"), F.col("n")).otherwise(0)).alias("n_unmatched"),
        F.count_distinct("cluster").alias("n_clusters"),
    )
    purity = cluster_purity(scored).groupBy("run").agg(F.round(F.avg("purity"), 4).alias("mean_cluster_purity"))
    macro = soft_macro_f1(scored).select("run", F.round("macro_f1_soft", 4).alias("macro_f1_soft"))
    return base.join(macro, "run").join(purity, "run").withColumn("kg_hierarchy", F.lit("used" if hierarchy else "skipped"))


def require_cells(evaluated: DataFrame) -> DataFrame:
    if evaluated.isEmpty():
        raise ValueError("no cell is in both the ground truth and the observed cells")
    return evaluated


def compare_runs(evaluated: DataFrame, runs: Sequence[str], metrics=("accuracy", "hierarchy_score", "macro_f1_soft", "mean_cluster_purity", "low_conf_rate")) -> DataFrame:
    """One row per metric, one column per run."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    long = evaluated.selectExpr("run", f"stack({len(metrics)}, {pairs}) AS (metric, value)")
    return long.groupBy("metric").pivot("run", list(runs)).agg(F.max("value"))


def ablation_delta(evaluated: DataFrame, full: str, without: str, line: float = 0.03) -> DataFrame:
    """Differences full - without, the verdict on accuracy, and a note when macro F1 disagrees."""
    side = lambda run: evaluated.where(F.col("run") == run).select(
        F.struct("accuracy", "hierarchy_score", "macro_f1_soft", "mean_cluster_purity", "n_low").alias("s"))
    base = side(full).withColumnRenamed("s", "_a").withColumn("_b", side(without).scalar())
    d = lambda c: F.round(F.col(f"_a.{c}") - F.col(f"_b.{c}"), 4)
    return base.select(
        d("accuracy").alias("accuracy"), d("hierarchy_score").alias("hierarchy_score"),
        d("macro_f1_soft").alias("macro_f1_soft"), d("mean_cluster_purity").alias("mean_cluster_purity"),
        (F.col("_a.n_low") - F.col("_b.n_low")).alias("n_low"),
    ).withColumn("passed", F.col("accuracy") >= line).withColumn(
        "note",
        F.when(~F.col("passed"), "accuracy gain below the line; macro F1 may only be spread evenly")
        .when(F.col("macro_f1_soft") < 0, "macro F1 favours the run without")
        .otherwise("n/a"),
    )


def first_entries(entries: DataFrame) -> DataFrame:
    """First table entry per predicted term: (predicted, mapped, relation)."""
    first = F.min_by(F.struct("true", "relation"), "position").alias("_e")
    return entries.groupBy("predicted").agg(first).select(
        "predicted", F.col("_e.true").alias("mapped"), F.col("_e.relation").alias("relation"))


def pair_tally(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """Older scoring: the relation comes from a predicted x true pair table."""
    counts = count_cells(cells)
    return durable(
        counts.join(first_entries(entries).withColumnRenamed("predicted", "raw"), "raw", "left")
        .withColumn("relation", F.coalesce("relation", F.lit("unmatched")))
        .withColumn("weight", weight(HIERARCHY_WEIGHT, "relation"))
        .withColumn("strict", F.col("relation").isin("exact", "synonym"))
    )


def evaluate_by_pair_table(pairs: DataFrame) -> DataFrame:
    """Strict and relaxed accuracy, soft macro F1 and mean purity per run, pair-table scoring."""
    n = F.sum("n")
    soft = F.when(F.col("weight") > 0, F.col("n") * F.col("weight")).otherwise(0.0)
    hit = F.col("weight") > 0
    wrong = hit & (F.col("mapped") != F.col("true"))
    base = pairs.groupBy("run").agg(
        n.alias("n_cells"),
        F.round(F.sum(F.when(F.col("strict"), F.col("n")).otherwise(0)) / n, 4).alias("strict_accuracy"),
        F.round(F.sum(F.col("n") * F.col("weight")) / n, 4).alias("relaxed_accuracy"),
    )
    types = pairs.groupBy("run", F.col("true").alias("type")).agg(
        F.sum(F.when(wrong, soft).when(~hit, F.col("n").cast("double")).otherwise(0.0)).alias("fn"))
    mapped = pairs.where(hit).groupBy("run", F.col("mapped").alias("type")).agg(
        F.sum(soft).alias("tp"), F.sum(F.when(wrong, soft).otherwise(0.0)).alias("fp"))
    macro = f1(types.join(mapped, ["run", "type"], "left").fillna(0.0, ["tp", "fp"])).groupBy("run").agg(
        F.round(F.avg("f1"), 4).alias("macro_f1_soft"))
    purity = cluster_purity(pairs.withColumn("accuracy_weight", F.col("strict").cast("double"))).groupBy("run").agg(
        F.round(F.avg("purity"), 4).alias("mean_cluster_purity"))
    return base.join(macro, "run").join(purity, "run")


def mapped_tally(scored: DataFrame) -> DataFrame:
    """Adds ``pred``: the true label the prediction maps to, else <other>."""
    known = F.when(F.col("raw") != "unknown", F.col("mapped_true"))
    return scored.withColumn("pred", F.coalesce(known, F.lit(OTHER)))


def confusion_matrix(scored: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Predicted x true counts; with ``types`` as columns, without in long form."""
    cells = mapped_tally(scored)
    if types is None:
        return cells.groupBy("run", "pred", "true").agg(F.sum("n").alias("n"))
    inside = lambda c: F.when(F.col(c).isin(list(types)), F.col(c)).otherwise(OTHER)
    return (
        cells.withColumns({"pred": inside("pred"), "true": inside("true")})
        .groupBy("run", "pred").pivot("true", [*types, OTHER]).agg(F.sum("n")).fillna(0)
    )


def per_type_metrics(scored: DataFrame) -> DataFrame:
    """Precision and recall per true type, with their counts."""
    named = scored.withColumn("_pred", F.coalesce("mapped_true", "raw"))
    ok = F.when(F.col("accuracy_weight") > 0, F.col("n")).otherwise(0)
    own = named.groupBy("run", F.col("true").alias("type")).agg(F.sum("n").alias("n_total"), F.sum(ok).alias("n_correct"))
    said = named.groupBy("run", F.col("_pred").alias("type")).agg(
        F.sum("n").alias("n_predicted"), F.sum(ok).alias("n_true_positive"))
    return own.join(said, ["run", "type"], "left").fillna(0, ["n_predicted", "n_true_positive"]).selectExpr(
        "*",
        "round(coalesce(try_divide(n_true_positive, n_predicted), 0D), 4) AS precision",
        "round(coalesce(try_divide(n_correct, n_total), 0D), 4) AS recall",
    )


def weighted_f1(scored: DataFrame) -> DataFrame:
    """F1 weighted by the support of each true type; off-vocabulary predictions go to <other>."""
    cells = mapped_tally(scored)
    ok = F.col("accuracy_weight") > 0
    own = cells.groupBy("run", F.col("true").alias("type")).agg(
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~ok, F.col("n")).otherwise(0)).alias("fn"),
        F.sum("n").alias("support"))
    said = cells.where(~ok).groupBy("run", F.col("pred").alias("type")).agg(F.sum("n").alias("fp"))
    scored_types = f1(own.join(said, ["run", "type"], "left").fillna(0, ["fp"]))
    return scored_types.groupBy("run").agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def top_confusions(scored: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent wrong (predicted, true) pairs per run."""
    pred = F.when(F.col("raw") == "unknown", "<unknown>").otherwise(F.coalesce("mapped_true", "raw"))
    wrong = scored.withColumn("predicted", pred).where(F.col("predicted") != F.col("true"))
    w = W.partitionBy("run").orderBy(F.col("n_wrong").desc(), "predicted", "true")
    return (
        wrong.groupBy("run", "predicted", "true").agg(F.sum("n").alias("n_wrong"))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    )


def unknown_rate(scored: DataFrame) -> DataFrame:
    unknown = (F.col("status") == "unknown") | (F.col("raw") == "unknown")
    return scored.groupBy("run").agg(
        (F.sum(F.when(unknown, F.col("n")).otherwise(0)) / F.sum("n")).alias("unknown_rate"))


def cluster_top_true(truth: DataFrame, obs: DataFrame) -> DataFrame:
    """Dominant true type of every cluster, its count and share."""
    counts = truth.join(obs, "cell_id").groupBy("cluster", F.col("true_type").alias("true")).agg(F.count("*").alias("n"))
    return dominant(counts)


def dominant(counts: DataFrame) -> DataFrame:
    """Top type per cluster from (cluster, true, n); equal counts: first name."""
    w = W.partitionBy("cluster").orderBy(F.col("n").desc(), "true")
    top = counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    total = counts.groupBy("cluster").agg(F.sum("n").alias("n_cells"))
    return top.join(total, "cluster").withColumn("share", F.col("n") / F.col("n_cells"))


def pure_clusters(tops: DataFrame, min_cells: int = 50, min_share: float = 0.90) -> DataFrame:
    return tops.where((F.col("n_cells") >= min_cells) & (F.col("share") >= min_share))


def draft_pins(labels: DataFrame, candidates: DataFrame, hints: dict[str, str]) -> DataFrame:
    """A node per true label: case-folded match, else hint, else first candidate; null means missing.

    ``candidates`` is the output of ``match_names``. The label ``unknown`` is skipped.
    """
    folded = candidates.where("match = 'casefold'").groupBy("label").agg(F.min("name").alias("_same"))
    first = candidates.groupBy("label").agg(F.min_by("name", "position").alias("_first"))
    table = F.create_map(*[F.lit(x) for kv in hints.items() for x in kv]) if hints else None
    hint = F.try_element_at(table, F.col("label")) if hints else F.lit(None).cast("string")
    return (
        labels.select("label").distinct().where(fold("label") != "unknown")
        .join(folded, "label", "left").join(first, "label", "left")
        .select("label", F.coalesce("_same", hint, "_first").alias("node"),
                F.when(F.col("_same").isNotNull(), "casefold").when(hint.isNotNull(), "hint")
                .when(F.col("_first").isNotNull(), "candidate").otherwise("missing").alias("basis"))
    )
