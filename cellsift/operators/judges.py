"""Judgements by rule, and their way onto the delivered labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.functions.fixed import ACCEPT, DECISIONS

# The thresholds of the rule judge.
DIFF_DECISIVE, RATIO_TIED, PCT2_HIGH, RATIO_HIGH, RATIO_MEDIUM = 3, 1.2, 0.6, 2.0, 1.01
UNKNOWN_GOOD, UNKNOWN_ACCEPTABLE, BATCH_ENTROPY, CP_P90 = 0.05, 0.20, 1.4, 0.05

_JUDGES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def judge(name: str):
    """Register a judge: metrics DataFrame in, decisions DataFrame out."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        _JUDGES[name] = fn
        return fn

    return add


def decide(name: str, metrics: DataFrame) -> DataFrame:
    """Run a registered judge; decisions outside the allowed names raise an error."""
    if name not in _JUDGES:
        raise KeyError(f"unknown judge {name!r}, known: {sorted(_JUDGES)}")
    out = _JUDGES[name](metrics)
    missing = [c for c in ("decision_point", "decision", "confidence") if c not in out.columns]
    if missing:
        raise ValueError(f"judge {name} lacks columns {missing}")
    allowed = F.lit(False)
    for point, (_, names) in DECISIONS.items():
        allowed = allowed | ((F.col("decision_point") == point) & F.col("decision").isin(names))
    return out.withColumn("decision", F.when(allowed, F.col("decision")).otherwise(F.raise_error("decision not allowed")))


def default_decisions(points: DataFrame) -> DataFrame:
    """The fixed accept decision of every point; an unknown point gets quality_good, low."""
    table = F.create_map(*[F.lit(x) for kv in ACCEPT.items() for x in kv])
    known = F.try_element_at(table, F.col("decision_point"))
    return points.withColumns(
        {"decision": F.coalesce(known, F.lit("quality_good")), "confidence": F.when(known.isNotNull(), "high").otherwise("low")})


def default_labels(entries: DataFrame) -> DataFrame:
    """First type with high confidence, or unknown with low."""
    ok = F.col("first_type").isNotNull() & (F.col("status") != "no_candidates")
    return entries.select(
        "cluster", F.when(ok, F.col("first_type")).otherwise("unknown").alias("label"),
        F.when(ok, "high").otherwise("low").alias("confidence"), F.when(ok, "decisive").otherwise("unknown").alias("status"))


def rule_gap(entries: DataFrame) -> DataFrame:
    """Gap decision per cluster from count difference, ratio and hierarchy."""
    none = F.col("first_type").isNull() | (F.col("status") == "no_candidates")
    related = F.coalesce("related", F.lit(False)) | F.coalesce("first_is_ancestor", F.lit(False))
    return entries.select(
        "cluster",
        F.when(none, "unknown")
        .when(F.col("count_diff") >= DIFF_DECISIVE, "first_decisive")
        .when(F.col("count_ratio") >= RATIO_HIGH, "ambiguous_true")
        .when(related, "ambiguous_parent_child")
        .when((F.col("count_ratio") < RATIO_TIED) & (F.col("second_count") > 0), "ambiguous_synonym")
        .otherwise("first_decisive").alias("decision"),
    )


def rule_disambiguate(gaps: DataFrame) -> DataFrame:
    """An ambiguous gap is confirmed, anything else becomes ambiguous_true."""
    kept = F.col("decision").startswith("ambiguous_")
    return gaps.select("cluster", F.when(kept, F.col("decision")).otherwise("ambiguous_true").alias("decision"))


def rule_labels(entries: DataFrame) -> DataFrame:
    """Confirm, downgrade or unknown, with label, confidence and status.

    Downgraded when the top markers are common inside and outside, or the first
    candidate barely leads.
    """
    none = F.col("first_type").isNull() | F.col("status").isin("no_candidates", "unknown")
    shared = (F.coalesce("max_top_pct1", F.lit(0.0)) > 0.5) & (F.coalesce("max_top_pct2", F.lit(0.0)) > PCT2_HIGH)
    down = shared | (F.coalesce("count_ratio", F.lit(0.0)) < RATIO_MEDIUM)
    return entries.select(
        "cluster",
        F.when(none, "label_unknown").when(down, "label_downgraded").otherwise("label_confirmed").alias("decision"),
        F.when(none, "unknown").otherwise(F.col("first_type")).alias("label"),
        F.when(none | down, "low").when(F.col("count_ratio") >= RATIO_HIGH, "high").otherwise("medium").alias("confidence"),
        F.when(none, "unknown").otherwise("decisive").alias("status"),
    )


def rule_refine(refined: DataFrame) -> DataFrame:
    """effective / ineffective / skipped from (cluster, status, outcome)."""
    return refined.select(
        "cluster",
        F.when((F.col("status") == "analyzed") & (F.col("outcome") == "analyzed"), "refine_effective")
        .when(F.col("status") == "analyzed", "refine_ineffective").otherwise("refine_skipped").alias("decision"))


def rule_session(facts: DataFrame) -> DataFrame:
    """Session decisions from one row: cp_p90, batch_entropy, n_unknown, n_clusters."""
    rate = F.col("n_unknown") / F.greatest("n_clusters", F.lit(1))
    rows = {
        "qc_threshold": F.when(F.col("cp_p90") > CP_P90, "threshold_set").otherwise("threshold_default"),
        "resolution_select": F.lit("resolution_chosen"),
        "clustering_quality": F.lit("clustering_accept"),
        "batch_effect": F.when(F.col("batch_entropy") >= BATCH_ENTROPY, "well_mixed").otherwise("batch_effect"),
        "de_method": F.lit("wilcoxon"),
        "marker_quality": F.lit("markers_accept"),
        "kg_match": F.lit("id_match_ok"),
        "unknown_cluster": F.when(F.col("n_unknown") <= 1, "single_unknown_type").otherwise("multiple_unknown_types"),
        "global_quality": F.when(rate <= UNKNOWN_GOOD, "quality_good").when(rate <= UNKNOWN_ACCEPTABLE, "quality_acceptable").otherwise("quality_poor"),
    }
    pairs = F.array(*[F.struct(F.lit(p).alias("decision_point"), d.alias("decision")) for p, d in rows.items()])
    return facts.select(F.explode(pairs).alias("_p")).select("_p.*", F.lit("high").alias("confidence"))


@judge("default")
def _default(metrics: DataFrame) -> DataFrame:
    return default_decisions(metrics)


@judge("rule")
def _rule(metrics: DataFrame) -> DataFrame:
    return rule_session(metrics)


def materialize_labels(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Label patches of one run from its latest label_confirm per cluster."""
    latest = (
        log.where("type = 'judgment' AND decision_point = 'label_confirm' AND coalesce(scope.cluster_id, '_none') NOT IN ('', '_none')")
        .groupBy(F.col("scope.cluster_id").alias("cluster"))
        .agg(F.max_by("output", "line").alias("_o"))
    )
    none = (F.col("_o.decision") == "label_unknown") | F.col("first_type").isNull()
    return latest.join(entries.select("cluster", "first_type"), "cluster", "left").select(
        "cluster",
        F.when(none, "unknown").otherwise(F.col("first_type")).alias("label"),
        F.when(none | (F.col("_o.decision") == "label_downgraded"), "low").otherwise(F.coalesce("_o.confidence", F.lit("medium"))).alias("confidence"),
        F.when(none, "unknown").otherwise("decisive").alias("status"),
    )


def require_labels(patches: DataFrame) -> DataFrame:
    if patches.isEmpty():
        raise ValueError("the log holds no label_confirm judgement, so there is no label to deliver")
    return patches


def patch_labels(final: DataFrame, patches: DataFrame) -> DataFrame:
    """Merge patches onto the annotations; new clusters are inserted, patched fields win."""
    fields = ("label", "confidence", "status")
    base = final.select("cluster", *[F.col(c).alias(f"_{c}") for c in fields], *[c for c in final.columns if c not in ("cluster", *fields)])
    return base.join(patches, "cluster", "full_outer").select(
        "cluster", *[F.coalesce(c, f"_{c}").alias(c) for c in fields], *[c for c in final.columns if c not in ("cluster", *fields)])


def label_summary(final: DataFrame) -> DataFrame:
    unknown = F.count_if(F.col("status") == "unknown")
    return final.agg(
        F.count("*").alias("n_clusters"), unknown.alias("n_unknown"), F.coalesce(F.try_divide(unknown.cast("double"), F.count("*")), F.lit(0.0)).alias("unknown_rate"),
        F.count_distinct(F.when(F.col("label") != "", F.col("label"))).alias("n_unique_labels"))


def overlay_entry(sources: Sequence[DataFrame], fields: Sequence[str]) -> DataFrame:
    """Per cluster the fields of the latest source that has the cluster; a null there wins too."""
    out = None
    for i, s in enumerate(sources):
        have = [c for c in fields if c in s.columns]
        part = s.select("cluster", F.struct(*have).alias(f"_s{i}"))
        out = part if out is None else out.join(part, "cluster", "full_outer")
    cols = []
    for f in fields:
        value = F.lit(None)
        for i, s in enumerate(sources):
            if f in s.columns:
                value = F.when(F.col(f"_s{i}").isNotNull(), F.col(f"_s{i}.{f}")).otherwise(value)
        cols.append(value.alias(f))
    return out.select("cluster", *cols)
