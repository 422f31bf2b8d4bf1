"""Queries that score predicted labels: metrics, bootstrap, grid, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.operators import bootstrap as bs
from cellsift.operators import evaluate as ev
from cellsift.operators import scenarios as sn
from cellsift.operators import thresholds as th
from cellsift.operators.knowledge import match_names
from cellsift.operators.markers import gene_cluster_stats, pct_in_out
from cellsift.plans.inputs import (CELLS, EVAL, EXPR, NORM, PURITY, TYPE_F1, annotations, cells, cluster_genes,
                                   evaluated_cells, norm, obs, pins, relations, scored, with_sql)
from cellsift.plans.knowledge import GAP, RANKED, gaps
from cellsift.plans.inputs import CG, HITS, ORTH, ROWS
from cellsift.plans.quality import STATS, rounded
from cellsift.plans.registry import query
from cellsift.sources import guards

BASE = with_sql(EVAL)


@query("label_relation", BASE + """SELECT * FROM rl""")
def _(t):
    return relations(t)


@query("label_relation_no_hierarchy", BASE + """SELECT raw, "true", node_a, node_b, mapped_true, relation,
  CASE WHEN relation IN ('exact', 'synonym') THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS accuracy_weight, CASE WHEN relation IN ('exact', 'synonym') THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS hierarchy_weight FROM (
  SELECT *, CASE WHEN node_a IS NULL OR node_b IS NULL THEN 'unmatched' WHEN node_a = node_b AND raw = "true" THEN 'exact' WHEN node_a = node_b THEN 'synonym' ELSE 'unrelated' END AS relation,
    (SELECT min(label) FROM pins WHERE lower(pins.node) = lower(node_a)) AS mapped_true FROM
    (SELECT raw, "true", node_b, coalesce((SELECT r_name FROM region WHERE lower(r_name) = lower(raw)), (SELECT min(node) FROM pins WHERE lower(node) = lower(raw))) AS node_a FROM rp))""")
def _(t):
    return relations(t, hierarchy=False)


@query("join_evaluation", BASE + """SELECT run, cell_id, cluster, raw, confidence, status, "true" FROM ev""")
def _(t):
    return evaluated_cells(t).drop("annotated")


@query("unknown_clusters", BASE + """SELECT DISTINCT run, cluster FROM obs CROSS JOIN (SELECT DISTINCT run FROM ann) WHERE (run, cluster) NOT IN (SELECT (run, cluster) FROM ann)""")
def _(t):
    return ev.unknown_clusters(evaluated_cells(t))


@query("score_cells", BASE + """SELECT run, cell_id, cluster, raw, confidence, "true", relation, mapped_true, accuracy_weight, hierarchy_weight,
  CASE WHEN confidence IN ('high', 'medium') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence_weight, accuracy_weight > 0 AS is_accurate FROM sc""")
def _(t):
    return ev.score_cells(evaluated_cells(t), relations(t)).drop("annotated", "status", "node_a", "node_b")


@query("evaluate_run", with_sql(EVAL, TYPE_F1, PURITY) + """SELECT run, count(*) AS n_cells, round(avg(accuracy_weight), 4) AS accuracy, round(avg(hierarchy_weight), 4) AS hierarchy_score,
  round(avg((confidence = 'low')::INT), 4) AS low_conf_rate, count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (confidence = 'medium') AS n_medium,
  count(*) FILTER (confidence = 'low') AS n_low, count(*) FILTER (relation = 'unmatched' AND raw <> 'unknown') AS n_unmatched, count(DISTINCT cluster) AS n_clusters,
  (SELECT round(avg(f1), 4) FROM f WHERE f.run = sc.run) AS macro_f1_soft, (SELECT round(avg(purity), 4) FROM pu WHERE pu.run = sc.run) AS mean_cluster_purity, 'used' AS kg_hierarchy
  FROM sc GROUP BY run""")
def _(t):
    return ev.evaluate_run(scored(t))


@query("soft_macro_f1", with_sql(EVAL, TYPE_F1) + "SELECT run, round(avg(f1), 6) AS macro_f1_soft FROM f GROUP BY 1")
def _(t):
    return rounded(ev.soft_macro_f1(scored(t)))


@query("type_scores", with_sql(EVAL, TYPE_F1) + "SELECT run, type, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def _(t):
    return rounded(ev.type_scores(scored(t)))


@query("cluster_purity", with_sql(EVAL, PURITY) + """SELECT run, cluster, n_cells, predicted, accurate_cells, top_true, top_true_n, round(purity, 6) AS purity FROM pu""")
def _(t):
    return rounded(ev.cluster_purity(scored(t)))


@query("compare_runs", with_sql(EVAL, TYPE_F1, PURITY, """er AS (SELECT run, round(avg(accuracy_weight), 4) AS accuracy, round(avg(hierarchy_weight), 4) AS hierarchy_score,
    round(avg((confidence = 'low')::INT), 4) AS low_conf_rate, (SELECT round(avg(f1), 4) FROM f WHERE f.run = sc.run) AS macro_f1_soft,
    (SELECT round(avg(purity), 4) FROM pu WHERE pu.run = sc.run) AS mean_cluster_purity FROM sc GROUP BY run)""") + """
  SELECT metric, max(value) FILTER (run = 'default') AS "default", max(value) FILTER (run = 'rules') AS rules, max(value) FILTER (run = 'review') AS review
  FROM er UNPIVOT (value FOR metric IN (accuracy, hierarchy_score, macro_f1_soft, mean_cluster_purity, low_conf_rate)) GROUP BY 1""")
def _(t):
    return ev.compare_runs(ev.evaluate_run(scored(t)), ["default", "rules", "review"])


@query("ablation_delta", with_sql(EVAL, TYPE_F1, PURITY, """er AS (SELECT run, round(avg(accuracy_weight), 4) AS accuracy, round(avg(hierarchy_weight), 4) AS hierarchy_score,
    count(*) FILTER (confidence = 'low') AS n_low, (SELECT round(avg(f1), 4) FROM f WHERE f.run = sc.run) AS macro_f1_soft,
    (SELECT round(avg(purity), 4) FROM pu WHERE pu.run = sc.run) AS mean_cluster_purity FROM sc GROUP BY run)""") + """
  SELECT *, accuracy >= 0.03 AS passed, CASE WHEN accuracy < 0.03 THEN 'accuracy gain below the line; macro F1 may only be spread evenly'
    WHEN macro_f1_soft < 0 THEN 'macro F1 favours the run without' ELSE 'n/a' END AS note FROM (
  SELECT round(a.accuracy - b.accuracy, 4) AS accuracy, round(a.hierarchy_score - b.hierarchy_score, 4) AS hierarchy_score,
    round(a.macro_f1_soft - b.macro_f1_soft, 4) AS macro_f1_soft, round(a.mean_cluster_purity - b.mean_cluster_purity, 4) + 0.0 AS mean_cluster_purity, a.n_low - b.n_low AS n_low
  FROM er a, er b WHERE a.run = 'default' AND b.run = 'review')""")
def _(t):
    return ev.ablation_delta(ev.evaluate_run(scored(t)), "default", "review")


# Pair table of the older scoring: each nation name maps to its own label, each region to its first nation.
ENTRIES = """en AS (SELECT n_name AS predicted, 'N' || lower(substr(n_name, 2)) AS "true", CASE WHEN n_nationkey % 7 = 0 THEN 'subtype' ELSE 'synonym' END AS relation, n_nationkey AS position FROM nation
  UNION ALL SELECT r_name, 'N' || lower(substr(n_name, 2)), 'supertype', n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
  fe AS (SELECT predicted, arg_min("true", position) AS mapped, arg_min(relation, position) AS relation FROM en GROUP BY 1)"""


def _entries(t):
    truth, key = F.initcap("n_name").alias("true"), F.col("n_nationkey").alias("position")
    own = t.nation.select(F.col("n_name").alias("predicted"), truth, F.expr("IF(n_nationkey % 7 = 0, 'subtype', 'synonym')").alias("relation"), key)
    up = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("predicted"), truth, F.lit("supertype").alias("relation"), key)
    return own.unionAll(up)


@query("evaluate_by_pair_table", with_sql(EVAL, ENTRIES, """px AS (SELECT ev.*, fe.mapped, coalesce(fe.relation, 'unmatched') AS relation,
    (CASE fe.relation WHEN 'synonym' THEN 1.0 WHEN 'subtype' THEN 1.5 WHEN 'supertype' THEN 0.5 ELSE 0 END)::DOUBLE AS w FROM ev LEFT JOIN fe ON fe.predicted = ev.raw),
  tn AS (SELECT run, "true" AS type, sum(CASE WHEN w > 0 AND mapped <> "true" THEN w WHEN w = 0 THEN 1 ELSE 0 END) AS fn FROM px GROUP BY 1, 2),
  tp AS (SELECT run, mapped AS type, sum(w) AS tp, sum(CASE WHEN mapped <> "true" THEN w ELSE 0 END) AS fp FROM px WHERE w > 0 GROUP BY 1, 2),
  ff AS (SELECT run, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT run, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r
    FROM tn LEFT JOIN tp USING (run, type)))""", PURITY) + """
  SELECT run, count(*) AS n_cells, round(avg((relation = 'synonym')::INT), 4) AS strict_accuracy, round(avg(w), 4) AS relaxed_accuracy,
    (SELECT round(avg(f1), 4) FROM ff WHERE ff.run = px.run) AS macro_f1_soft, (SELECT round(avg(purity), 4) FROM pu WHERE pu.run = px.run) AS mean_cluster_purity FROM px GROUP BY run""")
def _(t):
    return ev.evaluate_by_pair_table(ev.pair_tally(evaluated_cells(t), _entries(t)))


@query("confusion_matrix", BASE + """SELECT run, CASE WHEN raw = 'unknown' THEN '<other>' ELSE coalesce(mapped_true, '<other>') END AS pred, "true", count(*) AS n FROM sc GROUP BY 1, 2, 3""")
def _(t):
    return ev.confusion_matrix(scored(t))


@query("confusion_matrix_wide", BASE + """SELECT run, CASE WHEN raw <> 'unknown' AND mapped_true IN ('Nation_1', 'Nation_2') THEN mapped_true ELSE '<other>' END AS pred,
  count(*) FILTER ("true" = 'Nation_1') AS "Nation_1", count(*) FILTER ("true" = 'Nation_2') AS "Nation_2", count(*) FILTER ("true" NOT IN ('Nation_1', 'Nation_2')) AS "<other>"
  FROM sc GROUP BY 1, 2""")
def _(t):
    return ev.confusion_matrix(scored(t), ["Nation_1", "Nation_2"])


@query("per_type_metrics", BASE + """SELECT run, type, n_total, n_correct, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_true_positive, 0) AS n_true_positive,
  round(coalesce(n_true_positive / nullif(n_predicted, 0), 0), 4) AS precision, round(n_correct / n_total, 4) AS recall FROM
  (SELECT run, "true" AS type, count(*) AS n_total, count(*) FILTER (accuracy_weight > 0) AS n_correct FROM sc GROUP BY 1, 2) LEFT JOIN
  (SELECT run, coalesce(mapped_true, raw) AS type, count(*) AS n_predicted, count(*) FILTER (accuracy_weight > 0) AS n_true_positive FROM sc GROUP BY 1, 2) USING (run, type)""")
def _(t):
    return ev.per_type_metrics(scored(t))


@query("weighted_f1", BASE + """SELECT run, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM (
  SELECT run, type, support, coalesce(tp / nullif(tp + coalesce(fp, 0), 0), 0) AS p, coalesce(tp / support, 0) AS r FROM
  (SELECT run, "true" AS type, count(*) AS support, count(*) FILTER (accuracy_weight > 0) AS tp FROM sc GROUP BY 1, 2) LEFT JOIN
  (SELECT run, CASE WHEN raw = 'unknown' THEN '<other>' ELSE coalesce(mapped_true, '<other>') END AS type, count(*) AS fp FROM sc WHERE accuracy_weight = 0 GROUP BY 1, 2) USING (run, type))) GROUP BY 1""")
def _(t):
    return rounded(ev.weighted_f1(scored(t)))


@query("top_confusions", BASE + """SELECT run, predicted, "true", n_wrong, rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n_wrong DESC, predicted, "true") AS rank FROM (
  SELECT run, CASE WHEN raw = 'unknown' THEN '<unknown>' ELSE coalesce(mapped_true, raw) END AS predicted, "true", count(*) AS n_wrong FROM sc GROUP BY 1, 2, 3) WHERE predicted <> "true") WHERE rank <= 5""")
def _(t):
    return ev.top_confusions(scored(t))


@query("unknown_rate", BASE + "SELECT run, round(avg((status = 'unknown' OR raw = 'unknown')::INT), 6) AS unknown_rate FROM sc GROUP BY 1")
def _(t):
    return rounded(ev.unknown_rate(scored(t)))


TOP = """tt AS (SELECT cluster, "true", n, n_cells, n / n_cells AS share FROM (SELECT cluster, true_type AS "true", n, total::BIGINT AS n_cells,
  row_number() OVER (PARTITION BY cluster ORDER BY n DESC, true_type) AS k FROM od) WHERE k = 1)"""


@query("cluster_top_true", with_sql(EVAL, TOP) + """SELECT cluster, "true", n, n_cells, round(share, 6) AS share FROM tt""")
def _(t):
    return rounded(ev.cluster_top_true(obs(t).drop("cluster"), obs(t).select("cell_id", "cluster")))


def _tops(t):
    return ev.cluster_top_true(obs(t).drop("cluster"), obs(t).select("cell_id", "cluster"))


@query("pure_clusters", with_sql(EVAL, TOP) + """SELECT cluster, "true", n, n_cells, round(share, 6) AS share FROM tt WHERE n_cells >= 5 AND share >= 0.75""")
def _(t):
    return rounded(ev.pure_clusters(_tops(t), 5, 0.75))


# Customers split further, so that a nation owns several pure clusters.
FINE_OBS = """fo AS (SELECT cell_id, cluster || '.' || (cell_id // 7 % 5) AS cluster, true_type FROM obs),
  fc AS (SELECT cluster, true_type AS "true", count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS n_cells,
    row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, true_type) AS k FROM fo GROUP BY 1, 2),
  pc AS (SELECT cluster, "true", row_number() OVER (PARTITION BY "true" ORDER BY cluster) AS i, count(*) OVER (PARTITION BY "true") AS m FROM fc
    WHERE k = 1 AND n_cells >= 3 AND n / n_cells >= 0.6)"""
CASES = [("A", "positive_unrelated", ["Nation_1", "Nation_2"], 2, "none", "ambiguous_true -> refine_effective", "one|two"),
         ("B", "negative_same_type", ["Nation_2"], 2, "counter_example", "first_decisive, no refine", "two|two"),
         ("C", "negative_parent_child", ["Nation_3", "Nation_1"], 2, "trap2", "ambiguous_parent_child, pick more specific", "three|one"),
         ("D", "positive_superfusion", ["Nation_4", "Nation_5", "Nation_1"], 3, "none", "ambiguous_true -> step5", "four|five|one")]


def _scenarios(t):
    fo = obs(t).withColumn("cluster", F.expr("cluster || '.' || CAST(floor(cell_id / 7) % 5 AS string)"))
    tops = ev.cluster_top_true(fo.drop("cluster"), fo.select("cell_id", "cluster"))
    return sn.build_scenarios(ev.pure_clusters(tops, 3, 0.6), CASES)


def _take(label, turn):
    return f"""coalesce((SELECT list(cluster ORDER BY cluster) FROM pc WHERE "true" = '{label}' AND i IN ({2 * turn - 1}, {2 * turn}) AND m >= {2 * turn}), [])"""


SCEN = with_sql(EVAL, FINE_OBS, f"""cs AS (
  SELECT 'A' AS case_id, 'positive_unrelated' AS kind, 'none' AS trap, 2 AS keep, 'ambiguous_true' AS expected, {_take('Nation_1', 1)} || {_take('Nation_2', 1)} AS c UNION ALL
  SELECT 'B', 'negative_same_type', 'counter_example', 2, 'first_decisive', {_take('Nation_2', 2)} UNION ALL
  SELECT 'C', 'negative_parent_child', 'trap2', 2, 'ambiguous_parent_child', {_take('Nation_3', 1)} || {_take('Nation_1', 2)} UNION ALL
  SELECT 'D', 'positive_superfusion', 'none', 3, 'ambiguous_true', {_take('Nation_4', 1)} || {_take('Nation_5', 1)} || {_take('Nation_1', 3)})""")


@query("build_scenarios", SCEN + "SELECT case_id, kind, trap, CASE case_id WHEN 'A' THEN 'one|two' WHEN 'B' THEN 'two|two' WHEN 'C' THEN 'three|one' ELSE 'four|five|one' END AS merge_label, array_to_string(c[1:keep], ',') AS clusters, len(c) >= keep AS available FROM cs")
def _(t):
    return _scenarios(t).drop("expected_text").withColumn("clusters", F.array_join("clusters", ","))


@query("cluster_overrides", SCEN + "SELECT case_id, unnest(c[1:keep]) AS cluster, 'S1_' || case_id AS merged_cluster FROM cs")
def _(t):
    return sn.cluster_overrides(_scenarios(t))


@query("scenario_report", SCEN + """, dc AS (SELECT *, CASE WHEN case_id IN ('A', 'C') THEN expected ELSE 'ambiguous_true' END AS decision FROM cs WHERE len(c) >= keep)
  SELECT *, CASE WHEN n_judged > 0 THEN n_correct >= needed END AS hits_pass, CASE WHEN n_negative > 0 THEN n_negative_correct = n_negative END AS negatives_pass FROM (
  SELECT count(*) AS n_available, count(decision) AS n_judged, count(*) FILTER (decision = expected) AS n_correct, count(*) FILTER (kind LIKE 'negative%') AS n_negative,
    count(*) FILTER (kind LIKE 'negative%' AND decision = expected) AS n_negative_correct, greatest(3, round_even(6 * count(*) / 8, 0)::INT) AS needed FROM dc)""")
def _(t):
    scen = _scenarios(t)
    taken = scen.withColumn("decision", F.when(F.col("case_id").isin("A", "C"), sn.expected_decision()).otherwise("ambiguous_true"))
    return sn.scenario_report(sn.scenario_cases(scen, taken))


@query("bootstrap_contributions", BASE + """SELECT run, cluster, type, sum(n)::DOUBLE AS n, sum(strict) AS strict, sum(relaxed) AS relaxed, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT run, cluster, "true" AS type, 1 AS n, accuracy_weight AS strict, hierarchy_weight AS relaxed, hierarchy_weight AS tp, 0::DOUBLE AS fp, (hierarchy_weight = 0)::INT::DOUBLE AS fn FROM sc
  UNION ALL SELECT run, cluster, mapped_true, 0, 0, 0, 0, 1, 0 FROM sc WHERE hierarchy_weight = 0 AND mapped_true <> "true" AND mapped_true IN (SELECT "true" FROM sc)) GROUP BY 1, 2, 3""")
def _(t):
    return bs.contributions(scored(t))


@query("cluster_bootstrap")
def _(t):
    return rounded(bs.cluster_bootstrap(bs.boot_metrics(scored(t), 1000)))


@query("bootstrap_deltas")
def _(t):
    return rounded(bs.bootstrap_deltas(bs.boot_metrics(scored(t), 1000)))


FEAT = """feat AS (SELECT g.cluster, first_type, second_type, first_count, second_count, coalesce(count_diff, 0) AS count_diff, coalesce(count_ratio, 0) AS count_ratio,
  coalesce(related, false) AS related, coalesce(max_top_pct2, 0) AS max_top_pct2, n_candidates FROM gap g LEFT JOIN
  (SELECT st.cluster, max(nnz_out / n_out) AS max_top_pct2 FROM st JOIN cg ON cg.cluster = st.cluster AND cg.gene = st.gene_id WHERE position <= 3 GROUP BY 1) USING (cluster))"""
FEATURES = with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP, NORM, STATS, FEAT)


def features(t):
    wanted = cluster_genes(t).where("position <= 3").withColumnRenamed("gene", "gene_id")
    asked = norm(t).join(wanted.select("gene_id").distinct(), "gene_id", "left_semi")
    top = pct_in_out(gene_cluster_stats(asked, cells(t)).join(wanted, ["cluster", "gene_id"]))
    return th.cluster_features(gaps(t), top)


@query("cluster_features", FEATURES + "SELECT * REPLACE (round(count_ratio, 6) AS count_ratio, round(max_top_pct2, 6) AS max_top_pct2) FROM feat")
def _(t):
    return rounded(features(t))


PREDICT = """CASE WHEN count_diff >= {d} THEN 'first_decisive' WHEN count_ratio >= 2 THEN 'ambiguous_true' WHEN related THEN 'ambiguous_parent_child'
    WHEN count_ratio < {r} AND second_count > 0 THEN 'ambiguous_synonym' ELSE 'first_decisive' END AS gap_decision,
  CASE WHEN max_top_pct2 > {p} OR count_ratio < {m} THEN 'label_downgraded' ELSE 'label_confirmed' END AS label_confirm,
  CASE WHEN max_top_pct2 > {p} OR count_ratio < {m} THEN 'low' WHEN count_ratio >= 2 THEN 'high' ELSE 'medium' END AS confidence"""


@query("rule_predict", FEATURES + "SELECT cluster, " + PREDICT.format(d=3, r=1.2, p=0.6, m=1.01) + " FROM feat")
def _(t):
    one = features(t).withColumns({"diff_decisive": F.lit(3), "ratio_tied": F.lit(1.2), "pct2_high": F.lit(0.6), "ratio_medium": F.lit(1.01)})
    return th.rule_predict(one).select("cluster", "gap_decision", "label_confirm", "confidence")


# The clusters of the features are market segments; their dominant nation is the truth.
SEG = """sg AS (SELECT cluster, "true" FROM (SELECT c_mktsegment AS cluster, 'N' || lower(substr(n_name, 2)) AS "true",
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, n_name) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, n_name) WHERE k = 1)"""
GRIDSQL = """tg AS (SELECT (row_number() OVER (ORDER BY d, r, p, m) - 1)::INT AS grid_id, d::DOUBLE AS diff_decisive, r::DOUBLE AS ratio_tied, p::DOUBLE AS pct2_high, m::DOUBLE AS ratio_medium
    FROM (SELECT unnest([1, 2, 3, 4, 5]) AS d), (SELECT unnest([1.05, 1.1, 1.15, 1.2, 1.25, 1.3]) AS r), (SELECT unnest([0.5, 0.6, 0.7, 0.8]) AS p),
    (SELECT unnest([1.0, 1.01, 1.02, 1.05, 1.08, 1.1, 1.15, 1.2, 1.3, 1.4, 1.5, 1.8, 2.0]) AS m)),
  gx AS (SELECT *, coalesce(fe.relation, 'unmatched') AS rel, (CASE fe.relation WHEN 'synonym' THEN 1.0 WHEN 'subtype' THEN 1.5 WHEN 'supertype' THEN 0.5 ELSE 0 END)::DOUBLE AS w,
    """ + PREDICT.format(d="diff_decisive", r="ratio_tied", p="pct2_high", m="ratio_medium") + """
    FROM feat JOIN sg USING (cluster) LEFT JOIN fe ON fe.predicted = first_type CROSS JOIN tg WHERE first_type IS NOT NULL),
  go AS (SELECT grid_id, "true" AS type, sum(CASE WHEN w > 0 AND mapped = "true" THEN w ELSE 0 END) AS tp, sum(CASE WHEN w > 0 AND mapped <> "true" THEN w WHEN w = 0 THEN 1 ELSE 0 END) AS fn FROM gx GROUP BY 1, 2),
  gl AS (SELECT grid_id, mapped AS type, sum(w) AS fp FROM gx WHERE w > 0 AND mapped <> "true" GROUP BY 1, 2),
  gf AS (SELECT grid_id, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) AS macro_f1 FROM (SELECT grid_id, coalesce(tp / nullif(tp + coalesce(fp, 0), 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r
    FROM go FULL JOIN gl USING (grid_id, type)) GROUP BY 1)"""


def _truth(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cluster"), F.initcap("n_name").alias("true_type"))
    return ev.cluster_top_true(named.drop("cluster"), named.drop("true_type"))


@query("threshold_search", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP, NORM, STATS, FEAT, SEG, ENTRIES, GRIDSQL) + """
  SELECT grid_id, diff_decisive, ratio_tied, pct2_high, ratio_medium, round(avg((rel IN ('exact', 'synonym'))::INT), 6) AS strict, round(avg(w), 6) AS relaxed,
    count(*) AS n_clusters, count(*) FILTER (confidence = 'low') AS n_low, round(any_value(macro_f1), 6) AS macro_f1 FROM gx JOIN gf USING (grid_id) GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return rounded(th.threshold_search(features(t), _truth(t), _entries(t), th.threshold_grid(t.spark)))


@query("threshold_baseline", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP, NORM, STATS, FEAT, SEG, ENTRIES, GRIDSQL) + """
  SELECT round(avg((rel IN ('exact', 'synonym'))::INT), 6) AS strict, round(avg(w), 6) AS relaxed, round(any_value(macro_f1), 6) AS macro_f1, count(*) AS n_clusters, 0 AS n_low
    FROM gx JOIN gf USING (grid_id) WHERE grid_id = 0""")
def _(t):
    return rounded(th.baseline(features(t), _truth(t), _entries(t)))


@query("draft_pins", """WITH lab AS (SELECT DISTINCT label FROM (SELECT lower(r_name) AS label FROM region UNION ALL SELECT substr(n_name, 1, 7) FROM nation UNION ALL SELECT 'Unknown' FROM region)),
  nm AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region),
  mt AS (SELECT label, min(name) FILTER (lower(name) = lower(label)) AS same, coalesce(min(name) FILTER (lower(name) = lower(label)), min(name)) AS first FROM lab JOIN nm ON contains(lower(name), lower(label)) GROUP BY 1)
  SELECT label, coalesce(same, CASE WHEN label = 'NATION_' THEN 'hinted' END, first) AS node,
    CASE WHEN same IS NOT NULL THEN 'casefold' WHEN label = 'NATION_' THEN 'hint' WHEN first IS NOT NULL THEN 'candidate' ELSE 'missing' END AS basis
  FROM lab LEFT JOIN mt USING (label) WHERE lower(label) <> 'unknown'""")
def _(t):
    lab = t.region.select(F.lower("r_name").alias("label")).unionAll(t.nation.select(F.substring("n_name", 1, 7))).unionAll(t.region.select(F.lit("Unknown")))
    nm = t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name"))
    return ev.draft_pins(lab, match_names(lab, nm), {"NATION_": "hinted"})


@query("expand_cluster_to_cells", BASE + "SELECT run, cell_id, label FROM obs JOIN ann USING (cluster)")
def _(t):
    return obs(t).select("cell_id", "cluster").join(annotations(t), "cluster").select("run", "cell_id", "label")


@query("delivered_label", BASE + """SELECT run, cell_id, cluster, CASE WHEN cluster::INT % 2 = 0 AND cell_id % 3 < 2 THEN 'sub' || (cell_id % 3) ELSE raw END AS raw FROM ev""")
def _(t):
    cells_ = evaluated_cells(t).select("run", "cell_id", "cluster", "raw")
    subs = cells_.select("run", "cell_id", F.expr("CAST(cell_id % 3 AS string)").alias("subcluster"))
    labels = annotations(t).select("run", "cluster").union(ev.unknown_clusters(evaluated_cells(t))).selectExpr(
        "run", "cluster", "explode(array('0', '1', '2')) AS subcluster").selectExpr(
        "*", "IF(subcluster = '2', '', 'sub' || subcluster) AS label", "IF(CAST(cluster AS INT) % 2 = 0, 'analyzed', 'skipped') AS outcome")
    return ev.delivered_label(cells_, labels, subs).select("run", "cell_id", "cluster", "raw")


@query("check_alignment", """SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_common, count(*) FILTER (b IS NULL) AS n_missing, count(*) FILTER (a IS NULL) AS n_extra
  FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders) ON a = b""")
def _(t):
    return guards.check_alignment(t.customer.select(F.col("c_custkey").alias("cell_id")), t.orders.select(F.col("o_custkey").alias("cell_id")))


@query("stale_clusters", "SELECT DISTINCT p_brand AS cluster FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) % 2 = 0)")
def _(t):
    # Current are the brands with an even number of lines.
    current = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.count("*").alias("n")).where("n % 2 = 0")
    return guards.stale_clusters(t.part.select(F.col("p_brand").alias("cluster")), current.select(F.col("p_brand").alias("cluster")))


@query("split_labels", "SELECT c_custkey AS cell_id, c_mktsegment FROM customer")
def _(t):
    return guards.split_labels(t.customer.withColumnRenamed("c_custkey", "cell_id"), ["c_mktsegment", "seurat_clusters"])[1]


@query("resolve_truth", BASE + """SELECT o.cell_id, p.node AS node_b FROM obs o JOIN pins p ON p.label = o.true_type""")
def _(t):
    return ev.resolve_truth(obs(t).select("cell_id", F.col("true_type").alias("true")), pins(t)).select("cell_id", "node_b")
