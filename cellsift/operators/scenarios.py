"""Test cases built from pure clusters, and the report on the decisions they drew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The eight cases: id, kind, labels to draw two clusters from, clusters kept, trap, expected, label of the merge.
CASES = [
    ("S-P1", "positive_unrelated", ["Xylem", "Root hair"], 2, "none", "ambiguous_true → route step5 → refine_effective", "xylem|root_hair"),
    ("S-P2", "positive_unrelated", ["Phloem", "Root endodermis"], 2, "none", "ambiguous_true → refine_effective", "phloem|root_endodermis"),
    ("S-P3", "positive_rare", ["Meristematic cell", "Stem cell niche"], 2, "trap3_small_sample", "ambiguous_true but check count_diff", "meristematic|stem_cell_niche"),
    ("S-N1", "negative_same_type", ["Pericycle"], 2, "counter_example", "first_decisive, no refine", "pericycle|pericycle"),
    ("S-N2", "negative_parent_child", ["Columella root cap", "Lateral root cap"], 2, "trap2_hierarchy", "ambiguous_parent_child, pick more specific, no step5", "columella|lateral_root_cap"),
    ("S-N3", "negative_same_type", ["Root cortex"], 2, "trap6_single_batch", "no batch_effect, no refine, first_decisive", "root_cortex|root_cortex"),
    ("S-H1", "positive_mid_difficulty", ["Root cortex", "Root hair"], 2, "none", "ambiguous_true → step5", "root_cortex|root_hair"),
    ("S-H2", "positive_superfusion", ["Root endodermis", "Root cortex", "Pericycle"], 3, "none", "ambiguous_true → step5, n_subclusters ≥ 2 expected", "endodermis|cortex|pericycle"),
]
HITS_NEEDED, HITS_OF, HITS_LEAST = 6, 8, 3


def build_scenarios(pure: DataFrame, cases: Sequence[tuple] = CASES) -> DataFrame:
    """(case_id, kind, trap, expected_text, merge_label, clusters, available).

    The j-th case that asks for a label gets that label's clusters 2j-1 and 2j, if
    it has that many; so no cluster is used twice and no loop is needed.
    """
    asked: dict[str, int] = {}
    wants = []
    for order, (cid, kind, labels, keep, trap, text, merged) in enumerate(cases):
        for part, label in enumerate(labels):
            asked[label] = asked.get(label, 0) + 1
            wants.append((order, cid, kind, keep, trap, text, merged, part, label, asked[label]))
    want = pure.sparkSession.createDataFrame(
        wants, "ord int, case_id string, kind string, keep int, trap string, expected_text string, merge_label string, part int, true string, turn int")
    w = W.partitionBy("true").orderBy("cluster")
    pool = pure.withColumn("_i", F.row_number().over(w)).select(
        "true", "cluster", ((F.col("_i") - 1) / 2).cast("int").alias("_t"), "_i")
    pairs = pool.groupBy("true", "_t").agg(F.array_sort(F.collect_list("cluster")).alias("_two")).where(F.size("_two") == 2)
    return (
        want.join(pairs.select("true", (F.col("_t") + 1).alias("turn"), "_two"), ["true", "turn"], "left")
        .groupBy("ord", "case_id", "kind", "keep", "trap", "expected_text", "merge_label")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "_two"))), lambda s: F.coalesce(s["_two"], F.array().cast("array<string>")))).alias("_all"))
        .select(
            "case_id", "kind", "trap", "expected_text", "merge_label", F.expr("slice(_all, 1, keep)").alias("clusters"),
            (F.size("_all") >= F.col("keep")).alias("available"),
        )
    )


def cluster_overrides(scenarios: DataFrame) -> DataFrame:
    """(case_id, cluster, merged cluster)."""
    return scenarios.select("case_id", F.explode("clusters").alias("cluster"), F.concat(F.lit("S1_"), "case_id").alias("merged_cluster"))


def expected_decision(text: str = "expected_text"):
    t = F.col(text)
    return (
        F.when(t.contains("first_decisive"), "first_decisive")
        .when(t.contains("parent_child"), "ambiguous_parent_child")
        .otherwise("ambiguous_true")
    )


def scenario_cases(scenarios: DataFrame, decisions: DataFrame) -> DataFrame:
    """Available cases with expected and taken decision."""
    return (
        scenarios.where("available").withColumn("expected", expected_decision())
        .join(decisions.select("case_id", "decision"), "case_id", "left")
        .withColumns({"negative": F.col("kind").startswith("negative_"), "correct": F.col("decision") == F.col("expected")})
    )


def scenario_report(cases: DataFrame) -> DataFrame:
    """Hits, negatives kept, and the pass line scaled to the available cases."""
    return cases.agg(
        F.count("*").alias("n_available"),
        F.count("correct").alias("n_judged"),
        F.count_if("correct").alias("n_correct"),
        F.count_if(F.col("negative") & F.col("correct").isNotNull()).alias("n_negative"),
        F.count_if(F.col("negative") & F.col("correct")).alias("n_negative_correct"),
    ).withColumn(
        # Halves round to even, as the pass line was registered.
        "needed", F.greatest(F.lit(HITS_LEAST), F.bround(F.lit(HITS_NEEDED) * F.col("n_available") / HITS_OF, 0).cast("int")),
    ).withColumns(
        {
            "hits_pass": F.when(F.col("n_judged") > 0, F.col("n_correct") >= F.col("needed")),
            "negatives_pass": F.when(F.col("n_negative") > 0, F.col("n_negative_correct") == F.col("n_negative")),
        }
    )
