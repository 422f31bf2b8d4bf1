"""Queries on the run log, conversations, judges, overlap and diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.functions.fixed import DECISIONS
from cellsift.operators import candidates as cd
from cellsift.operators import judges as jd
from cellsift.operators import overlap as ov
from cellsift.operators import runlog as rl
from cellsift.plans.evaluation import FEAT, features
from cellsift.plans.inputs import (CELLS, CG, EXPR, HITS, LOG, NORM, ORTH, ROWS, cells, cluster_genes, hits, run_log,
                                   with_sql)
from cellsift.plans.knowledge import GAP, RANKED, gaps
from cellsift.plans.quality import STATS, rounded
from cellsift.plans.registry import query

L = with_sql(LOG)


@query("next_attempt", L + """SELECT run, key, attempt, key || '#' || attempt AS run_id, attempt <= 6 AS allowed FROM (
  SELECT run, split_part(run_id, '#', 1) AS key, max(split_part(run_id, '#', 2)::INT) + 1 AS attempt FROM lg WHERE run_id IS NOT NULL GROUP BY 1, 2)""")
def _(t):
    return rl.next_attempt(run_log(t))


@query("latest_exec", L + """SELECT run, split_part(run_id, '#', 1) AS key, max(seq) AS seq, arg_max(run_id, seq * 1000000 + line) AS run_id, arg_max(k % 12, seq * 1000000 + line) AS n_clusters
  FROM lg WHERE type = 'exec' GROUP BY 1, 2""")
def _(t):
    return rl.latest_exec(run_log(t)).select("run", "key", "seq", "run_id", F.get_json_object("metrics", "$.n_clusters").cast("long").alias("n_clusters"))


@query("orphan_refs", L + """SELECT run, line, run_ref FROM lg j WHERE type = 'judgment' AND NOT EXISTS (SELECT 1 FROM lg e WHERE e.run = j.run AND e.type = 'exec'
  AND e.run_id = j.run_ref AND e.run_id NOT LIKE '%#0' AND e.line < j.line)""")
def _(t):
    return rl.orphan_refs(run_log(t)).select("run", "line", "run_ref")


@query("asof_decision", L + """SELECT run, seq, line, run_id, current_point FROM (SELECT *, last_value(CASE WHEN type = 'judgment' THEN decision_point END IGNORE NULLS) OVER
  (PARTITION BY run ORDER BY seq, (type = 'exec')::INT, line ROWS UNBOUNDED PRECEDING) AS current_point FROM lg WHERE type IN ('exec', 'judgment')) WHERE type = 'exec'""")
def _(t):
    return rl.asof_decision(run_log(t))


@query("point_rounds", L + """SELECT run, decision_point, n_judgments, coalesce(n_execs, 0) AS n_execs, round(coalesce(n_execs, 0) / n_judgments, 6) AS execs_per_judgment FROM
  (SELECT run, decision_point, count(*) AS n_judgments FROM lg WHERE type = 'judgment' GROUP BY 1, 2) LEFT JOIN
  (SELECT run, current_point AS decision_point, count(*) AS n_execs FROM (SELECT *, last_value(CASE WHEN type = 'judgment' THEN decision_point END IGNORE NULLS) OVER
    (PARTITION BY run ORDER BY seq, (type = 'exec')::INT, line ROWS UNBOUNDED PRECEDING) AS current_point FROM lg WHERE type IN ('exec', 'judgment')) WHERE type = 'exec' GROUP BY 1, 2) USING (run, decision_point)""")
def _(t):
    return rounded(rl.point_rounds(run_log(t)))


_NEED = "CASE decision_point " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in DECISIONS.items()) + " END"
ISSUES = f"""vl AS (SELECT *, {_NEED} AS need, coalesce(lag(seq) OVER (PARTITION BY run ORDER BY line), 0) AS prev,
    max(CASE WHEN type = 'exec' AND run_id LIKE 'step4_rank.rank_candidates#%' THEN [seq, k % 12] END) OVER (PARTITION BY run ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nc FROM lg),
  pr AS (SELECT run, bool_or(type = 'session_start') AS ss, bool_or(type = 'session_end') AS se, bool_or(type = 'exec') AS ex,
    max(CASE WHEN type = 'exec' AND run_id LIKE 'step4_rank.rank_candidates#%' THEN [seq, k % 12] END) AS nc FROM lg GROUP BY 1),
  iss AS (SELECT run, line, 'error' AS level, 'seq not consecutive' AS message FROM vl WHERE seq <> prev + 1
    UNION ALL SELECT run, line, 'error', 'type invalid' FROM vl WHERE type = 'bogus'
    UNION ALL SELECT run, line, 'error', 'exec run_id invalid' FROM vl WHERE type = 'exec' AND run_id LIKE '%#0'
    UNION ALL SELECT run, line, 'error', 'decision_point invalid' FROM vl WHERE type = 'judgment' AND need IS NULL
    UNION ALL SELECT run, line, 'error', 'decision not allowed' FROM vl WHERE type = 'judgment' AND need IS NOT NULL AND decision = 'bogus'
    UNION ALL SELECT run, line, 'error', 'scope granularity' FROM vl WHERE type = 'judgment' AND need <> scope_type
    UNION ALL SELECT run, line, 'error', 'cluster_id missing' FROM vl WHERE type = 'judgment' AND need = 'cluster' AND cluster_id IS NULL
    UNION ALL SELECT run, line, 'error', 'cluster_id out of range' FROM vl WHERE type = 'judgment' AND need = 'cluster' AND cluster_id::INT >= nc[2]
    UNION ALL SELECT run, line, 'warning', 'input lacks path or value' FROM vl WHERE type = 'judgment' AND k % 11 = 0
    UNION ALL SELECT run, line, 'warning', 'output confidence missing' FROM vl WHERE type = 'judgment' AND confidence IS NULL
    UNION ALL SELECT run, line, 'error', 'reasoning empty' FROM vl WHERE type = 'judgment' AND trim(reasoning) = ''
    UNION ALL SELECT run, line, 'warning', 'final_summary missing' FROM vl WHERE type = 'session_end' AND v % 2 <> 0
    UNION ALL SELECT run, 0, 'error', 'session_end record missing' FROM pr WHERE ss AND NOT se
    UNION ALL SELECT run, 0, 'error', 'exec record missing' FROM pr WHERE ss AND NOT ex
    UNION ALL SELECT run, 0, 'warning', 'exec records without session_start' FROM pr WHERE NOT ss AND ex
    UNION ALL SELECT run, 0, 'warning', decision_point || ' does not cover all clusters' FROM (SELECT run, decision_point, count(DISTINCT cluster_id) AS c FROM lg
      WHERE decision_point IN ('candidate_gap', 'label_confirm') AND cluster_id IS NOT NULL GROUP BY 1, 2) JOIN pr USING (run) WHERE ss AND nc[2] > 0 AND c < nc[2]
    UNION ALL SELECT run, line, 'warning', 'run_ref names no earlier exec' FROM lg j JOIN pr USING (run) WHERE ss AND type = 'judgment' AND NOT EXISTS
      (SELECT 1 FROM lg e WHERE e.run = j.run AND e.type = 'exec' AND e.run_id = j.run_ref AND e.run_id NOT LIKE '%#0' AND e.line < j.line))"""


@query("validate_log", with_sql(LOG, ISSUES) + "SELECT run, line, level, message FROM iss")
def _(t):
    return rl.validate_log(run_log(t))


@query("log_verdict", with_sql(LOG, ISSUES) + """SELECT run, coalesce(e, 0) AS n_errors, coalesce(w, 0) AS n_warnings, (coalesce(e, 0) > 0)::INT AS code FROM (SELECT DISTINCT run FROM lg)
  LEFT JOIN (SELECT run, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w FROM iss GROUP BY 1) USING (run)""")
def _(t):
    log = run_log(t)
    return rl.log_verdict(log, rl.validate_log(log))


@query("valid_judgments", with_sql(LOG, ISSUES) + """SELECT run, line FROM lg j WHERE type = 'judgment' AND run_ref NOT LIKE '%#0' AND NOT EXISTS
  (SELECT 1 FROM iss WHERE iss.run = j.run AND iss.line = j.line AND level = 'error' AND message IN ('decision_point invalid', 'decision not allowed', 'scope granularity', 'cluster_id missing', 'reasoning empty'))""")
def _(t):
    return rl.valid_judgments(run_log(t).where("type = 'judgment'"))[0].select("run", "line")


@query("append_rows", L + """SELECT run, line, top + row_number() OVER (PARTITION BY run ORDER BY line) AS seq FROM lg JOIN (SELECT run, max(seq) AS top FROM lg GROUP BY 1) USING (run) WHERE type = 'judgment'""")
def _(t):
    log = run_log(t)
    return rl.append_rows(log, log.where("type = 'judgment'").drop("seq", "ts")).select("run", "line", "seq")


USE = """us AS (SELECT decision_point, path, count(*) AS n FROM (SELECT decision_point, 'step4_rank.per_cluster.' || (k % 9) || '.first_count' AS path FROM lg WHERE type = 'judgment'
    UNION ALL SELECT decision_point, 'step1_prepare.qc.' || (k % 4) FROM lg WHERE type = 'judgment') GROUP BY 1, 2),
  fu AS (SELECT decision_point, CASE WHEN path LIKE 'step4%' THEN 'step4_rank.<CLUSTER_ID>.first_count' ELSE path END AS path, sum(n)::BIGINT AS n FROM us GROUP BY 1, 2)"""
U = with_sql(LOG, USE)


@query("metric_usage", U + "SELECT * FROM us")
def _(t):
    return rl.metric_usage(run_log(t))


@query("usage_summary", U + """SELECT count(DISTINCT path) AS n_paths, count(DISTINCT decision_point) AS n_points, sum(n)::BIGINT AS n_citations,
  (SELECT count(*) FROM lg WHERE type = 'judgment') AS n_judgments FROM us""")
def _(t):
    return rl.usage_summary(run_log(t))


@query("fold_usage", U + "SELECT * FROM fu")
def _(t):
    return rl.fold_usage(rl.metric_usage(run_log(t)))


@query("core_paths", U + """SELECT path, sum(n)::BIGINT AS n, count(*) AS n_points FROM (SELECT *, row_number() OVER (PARTITION BY decision_point ORDER BY n DESC, path) AS r FROM us)
  GROUP BY 1 HAVING count(*) >= 7 OR min(r) <= 2""")
def _(t):
    return rl.core_paths(rl.metric_usage(run_log(t)), min_points=7, top=2)


@query("top_paths", U + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision_point ORDER BY n DESC, path) AS rank FROM fu) WHERE rank <= 3")
def _(t):
    return rl.top_paths(rl.fold_usage(rl.metric_usage(run_log(t))), 3)


@query("path_expansion", U + """, x AS (SELECT decision_point, count(DISTINCT path) AS n_raw, (SELECT count(DISTINCT path) FROM fu WHERE fu.decision_point = us.decision_point) AS n_folded FROM us GROUP BY 1),
  th AS (SELECT greatest(3, 2 * r[len(r) // 2 + 1]) AS th FROM (SELECT list_sort(list(n_raw / n_folded)) AS r FROM x))
  SELECT decision_point, n_raw, n_folded, round(n_raw / n_folded, 2) AS expansion_ratio, n_raw / n_folded > th AS heavy, round(th, 2) AS heavy_threshold FROM x, th""")
def _(t):
    return rl.path_expansion(rl.metric_usage(run_log(t)))


SCOPE = """'{' || CASE WHEN cluster_id IS NULL THEN '' ELSE '"cluster_id":"' || cluster_id || '",' END || '"type":"' || scope_type || '"}'"""
PAIRS = f"""sp AS (SELECT run, decision_point, {SCOPE} AS scope, count(*) AS n_versions, arg_min(decision, seq * 1000000 + line) AS d1, arg_max(decision, seq * 1000000 + line) AS d2,
    arg_min(run_ref, seq * 1000000 + line) AS r1, arg_max(run_ref, seq * 1000000 + line) AS r2 FROM lg WHERE type = 'judgment' GROUP BY 1, 2, 3)"""


@query("self_corrections", with_sql(LOG, PAIRS) + "SELECT run, decision_point, scope, n_versions, d1 AS first_decision, d2 AS last_decision, r1 AS first_ref, r2 AS last_ref, d1 <> d2 AS changed FROM sp WHERE n_versions >= 2")
def _(t):
    return rl.self_corrections(run_log(t)).select(
        "run", "decision_point", "scope", "n_versions", F.col("first.decision").alias("first_decision"), F.col("last.decision").alias("last_decision"),
        F.col("first.run_ref").alias("first_ref"), F.col("last.run_ref").alias("last_ref"), "changed")


@query("correction_versions", with_sql(LOG, PAIRS) + f"""SELECT run, decision_point, scope, line, seq, decision, run_ref FROM (SELECT *, {SCOPE} AS scope FROM lg WHERE type = 'judgment')
  JOIN (SELECT run, decision_point, scope FROM sp WHERE n_versions >= 2) USING (run, decision_point, scope)""")
def _(t):
    return rl.correction_versions(run_log(t)).drop("ts")


@query("correction_counts", with_sql(LOG, PAIRS) + """SELECT run, sum(n_versions)::BIGINT AS n_judgments, count(*) AS n_keys, count(*) FILTER (n_versions >= 2) AS n_pairs, count(*) FILTER (n_versions >= 2 AND d1 <> d2) AS n_changed FROM sp GROUP BY 1""")
def _(t):
    return rl.correction_counts(run_log(t))


def _tiers():
    from cellsift.functions.fixed import DECISION_RANK, DECISION_TIER

    case = lambda table, d: "CASE decision_point || '|' || " + d + " " + " ".join(
        f"WHEN '{p}|{n}' THEN {v}" for p, names in table.items() for n, v in names.items()) + " END"
    return case(DECISION_RANK, "d1"), case(DECISION_RANK, "d2"), case(DECISION_TIER, "d1"), case(DECISION_TIER, "d2"), ", ".join(f"'{p}'" for p in DECISION_TIER)


_r1, _r2, _t1, _t2, _tp = _tiers()
VERDICT = f"""ex AS (SELECT run, run_id, arg_max(value, line) AS value, arg_max(k, line) AS k, arg_max(v, line) AS v FROM lg WHERE type = 'exec' GROUP BY 1, 2),
  vd AS (SELECT sp.*, method, CASE WHEN d1 = d2 THEN 'no_change' WHEN method = 'ranking_based' THEN CASE WHEN {_r2} > {_r1} THEN 'improved' ELSE 'unchanged' END
      WHEN method = 'metric_based' AND (a.k IS NULL OR b.k IS NULL) THEN 'no_evidence'
      WHEN method = 'metric_based' THEN CASE WHEN (decision_point = 'clustering_quality' AND ((d1 = 'clustering_adjust' AND d2 = 'clustering_accept') OR b.value > a.value OR b.k % 5 < a.k % 5))
        OR (decision_point = 'marker_quality' AND b.v > a.v) OR (decision_point = 'refine_effect' AND b.value > a.value) THEN 'improved' ELSE 'unchanged' END
      WHEN decision_point IN ({_tp}) AND coalesce({_t2}, 1) > coalesce({_t1}, 1) THEN 'improved' ELSE 'unchanged' END AS verdict
    FROM (SELECT *, CASE WHEN decision_point IN ('label_confirm', 'candidate_gap', 'candidate_disambiguate') THEN 'ranking_based'
      WHEN decision_point IN ('clustering_quality', 'marker_quality', 'refine_effect') THEN 'metric_based' ELSE 'oracle_heuristic' END AS method FROM sp WHERE n_versions >= 2) sp
    LEFT JOIN ex a ON a.run = sp.run AND a.run_id = r1 LEFT JOIN ex b ON b.run = sp.run AND b.run_id = r2)"""


def _verdicts(t):
    log = run_log(t)
    return rl.correction_verdict(rl.self_corrections(log), log)


@query("correction_verdict", with_sql(LOG, PAIRS, VERDICT) + "SELECT run, decision_point, scope, method, verdict FROM vd")
def _(t):
    return _verdicts(t).select("run", "decision_point", "scope", "method", "verdict")


@query("improvement_rate", with_sql(LOG, PAIRS, VERDICT) + """SELECT run, decision_point, n_pairs, n_improved + n_unchanged AS n_scored, n_improved, n_unchanged, n_no_evidence, n_no_change,
  round(n_improved / nullif(n_improved + n_unchanged, 0), 3) AS conditional_rate, round(n_improved / n_pairs, 3) AS unconditional_rate FROM (
  SELECT run, decision_point, count(*) AS n_pairs, count(*) FILTER (verdict = 'improved') AS n_improved, count(*) FILTER (verdict = 'unchanged') AS n_unchanged,
    count(*) FILTER (verdict = 'no_evidence') AS n_no_evidence, count(*) FILTER (verdict = 'no_change') AS n_no_change FROM vd
  GROUP BY GROUPING SETS ((run, decision_point), (run), (decision_point), ()))""")
def _(t):
    return rl.improvement_rate(_verdicts(t))


TRAPS = """ms AS (SELECT cluster, 'candidate_gap' AS decision_point, (count_ratio <> 0 AND count_ratio < 1.2) OR count_diff < 3 OR related AS trap FROM feat
    UNION ALL SELECT cluster, 'candidate_disambiguate', count_ratio <> 0 AND count_ratio < 2 FROM feat UNION ALL SELECT cluster, 'refine_effect', n_candidates > 20 FROM feat
    UNION ALL SELECT cluster, 'label_confirm', coalesce(max_top_pct2 > 0.5, false) FROM feat UNION ALL SELECT cluster, 'qc_threshold', true FROM feat UNION ALL SELECT cluster, 'batch_effect', true FROM feat)"""
FEATSQL = [EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP, NORM, STATS, FEAT]


def _masks(feats):
    return rl.trap_mask(feats.withColumns({
        "outcome": F.when(F.col("n_candidates") > 20, "analyzed"), "max_top_pct1": F.lit(1.0)}))


@query("trap_mask", with_sql(*FEATSQL, TRAPS) + "SELECT * FROM ms")
def _(t):
    return _masks(features(t))


NUMBERED = """nm AS (SELECT CAST(k - 1 AS VARCHAR) AS cluster, decision_point, trap FROM ms JOIN (SELECT cluster, row_number() OVER (ORDER BY cluster) AS k FROM (SELECT DISTINCT cluster FROM ms)) USING (cluster)),
  fd AS (SELECT run, decision_point, cluster_id AS cluster, arg_min(decision, line) AS decision FROM lg WHERE type = 'judgment' AND cluster_id IS NOT NULL GROUP BY 1, 2, 3),
  tr AS (SELECT run, decision_point, trap, coalesce(decision, '<no_judgment>') AS decision, count(*) AS n FROM nm CROSS JOIN (SELECT DISTINCT run FROM lg WHERE type = 'judgment')
    LEFT JOIN fd USING (run, decision_point, cluster) GROUP BY 1, 2, 3, 4)"""


def _report(t):
    from pyspark.sql.window import Window as W

    from cellsift.session import durable

    feats = durable(features(t))
    masks = _masks(feats)
    # Clusters are numbered so that the log's cluster ids can name them; the window sees their names only.
    ids = feats.select("cluster", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy("cluster")) - 1).cast("string").alias("_id"))
    return rl.trap_report(masks.join(ids, "cluster").drop("cluster").withColumnRenamed("_id", "cluster"), run_log(t))


@query("trap_report", with_sql(*FEATSQL, TRAPS, LOG, NUMBERED) + "SELECT * FROM tr")
def _(t):
    return _report(t)


@query("trap_wins", with_sql(*FEATSQL, TRAPS, LOG, NUMBERED) + """SELECT count(*) FILTER (b > a + 1e-12) AS wins, count(*) AS applicable FROM (SELECT decision_point,
  max(h) FILTER (run = 'u0') AS a, max(h) FILTER (run = 'u1') AS b FROM (SELECT decision_point, run, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM tr WHERE trap GROUP BY 1, 2) GROUP BY 1)
  WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(t):
    return rl.trap_wins(_report(t), "u0", "u1")


def _conversation(t):
    call = "array(named_struct('id', CAST(turn AS STRING), 'name', IF(turn % 2 = 1, 'write_note', 'retrieve_notes'), 'args', substr(text, 1, 10)))"
    return t.conversations.selectExpr("conv_id", "turn", "role", "text AS content", f"IF(role = 'assistant', {call}, NULL) AS tool_calls")


@query("conversation_cost", """SELECT conv_id, sum(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END
    + CASE WHEN role = 'assistant' AND length(coalesce(text, '')) > 0 THEN greatest(1, length(substr(text, 1, 10)) // 4) ELSE 0 END)::BIGINT AS total_tokens,
  count(*) FILTER (role = 'assistant') AS tool_rounds, total_tokens <= 500 AS within_budget FROM conversations GROUP BY 1""")
def _(t):
    return rl.conversation_cost(_conversation(t), budget=500)


@query("wall_clock", L + """SELECT run, epoch(e::TIMESTAMP) - epoch(s::TIMESTAMP) AS wall_seconds FROM (SELECT run, arg_min(ts, line) FILTER (type = 'session_start') AS s, arg_max(ts, line) FILTER (type = 'session_end') AS e FROM lg GROUP BY 1)""")
def _(t):
    return rl.wall_clock(run_log(t)).select("run", "wall_seconds")


@query("tool_usage", "SELECT conv_id, CASE WHEN turn % 2 = 1 THEN 'write_note' ELSE 'retrieve_notes' END AS name, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1, 2")
def _(t):
    return rl.tool_usage(_conversation(t))


NOTES = """nu AS (SELECT conv_id, count(*) FILTER (role = 'assistant' AND turn % 2 = 1) AS n_writes, count(*) FILTER (role = 'assistant' AND turn % 2 = 0) AS n_reads,
  count(*) FILTER (role = 'assistant' AND (contains(lower(text), 'note') OR contains(lower(text), 'retrieve') OR contains(text, '笔记'))) AS n_mentions, count(*) AS n_records FROM conversations GROUP BY 1)"""


@query("note_usage", with_sql(NOTES) + "SELECT *, n_writes + n_reads >= 3 AS usage_pass FROM nu")
def _(t):
    return rl.note_usage(_conversation(t))


@query("smoke_flags", with_sql(NOTES) + """SELECT *, n_writes >= 1 AS write_pass, n_reads >= 1 AS read_pass, n_notes >= 1 AS persist_pass, n_writes >= 1 AND n_reads >= 1 AND n_notes >= 1 AS passed FROM
  (SELECT sum(n_writes)::BIGINT AS n_writes, sum(n_reads)::BIGINT AS n_reads, (SELECT count(*) FROM documents WHERE trim(coalesce(text, '')) <> '') AS n_notes FROM nu)""")
def _(t):
    return rl.smoke_flags(rl.note_usage(_conversation(t)), t.documents.withColumnRenamed("text", "content"))


@query("default_decisions", L + "SELECT run, line, decision_point, CASE decision_point " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in __import__("cellsift.functions.fixed", fromlist=["ACCEPT"]).ACCEPT.items())
    + " ELSE 'quality_good' END AS decision, CASE WHEN decision_point = 'bogus_point' THEN 'low' ELSE 'high' END AS confidence FROM lg WHERE type = 'judgment'")
def _(t):
    return jd.default_decisions(run_log(t).where("type = 'judgment'").select("run", "line", "decision_point"))


@query("default_labels", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP) + """SELECT cluster, coalesce(first_type, 'unknown') AS label, CASE WHEN first_type IS NULL THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN first_type IS NULL THEN 'unknown' ELSE 'decisive' END AS status FROM gap""")
def _(t):
    return jd.default_labels(gaps(t))


RULEGAP = """CASE WHEN first_type IS NULL THEN 'unknown' WHEN count_diff >= 3 THEN 'first_decisive' WHEN count_ratio >= 2 THEN 'ambiguous_true' WHEN related THEN 'ambiguous_parent_child'
  WHEN count_ratio < 1.2 AND second_count > 0 THEN 'ambiguous_synonym' ELSE 'first_decisive' END"""
GAPSQL = with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP)


@query("rule_gap", GAPSQL + f"SELECT cluster, {RULEGAP} AS decision FROM gap")
def _(t):
    return jd.rule_gap(gaps(t))


@query("rule_disambiguate", GAPSQL + f"SELECT cluster, CASE WHEN decision LIKE 'ambiguous%' THEN decision ELSE 'ambiguous_true' END AS decision FROM (SELECT cluster, {RULEGAP} AS decision FROM gap)")
def _(t):
    return jd.rule_disambiguate(jd.rule_gap(gaps(t)))


@query("rule_labels", with_sql(*FEATSQL) + """SELECT cluster, CASE WHEN first_type IS NULL THEN 'label_unknown' WHEN max_top_pct2 > 0.6 OR count_ratio < 1.01 THEN 'label_downgraded' ELSE 'label_confirmed' END AS decision,
  coalesce(first_type, 'unknown') AS label, CASE WHEN first_type IS NULL OR max_top_pct2 > 0.6 OR count_ratio < 1.01 THEN 'low' WHEN count_ratio >= 2 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN first_type IS NULL THEN 'unknown' ELSE 'decisive' END AS status FROM feat""")
def _(t):
    f = features(t).withColumns({"max_top_pct1": F.lit(1.0), "status": F.lit("has_candidates")})
    return jd.rule_labels(f)


@query("rule_session", with_sql(CELLS, "fx AS (SELECT 0.04 AS cp_p90, (SELECT count(*) FROM nation) AS n_clusters)") + """
  SELECT decision_point, decision, 'high' AS confidence FROM (VALUES ('qc_threshold', 'threshold_default'), ('resolution_select', 'resolution_chosen'), ('clustering_quality', 'clustering_accept'),
  ('de_method', 'wilcoxon'), ('marker_quality', 'markers_accept'), ('kg_match', 'id_match_ok')) v(decision_point, decision)
  UNION ALL SELECT 'batch_effect', CASE WHEN (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT batch, count(*) AS n FROM cells GROUP BY 1)) >= 1.4 THEN 'well_mixed' ELSE 'batch_effect' END, 'high'
  UNION ALL SELECT 'unknown_cluster', CASE WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_acctbal < 0) <= 1 THEN 'single_unknown_type' ELSE 'multiple_unknown_types' END, 'high'
  UNION ALL SELECT 'global_quality', CASE WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_acctbal < 0) / (SELECT count(*) FROM nation) <= 0.05 THEN 'quality_good'
    WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_acctbal < 0) / (SELECT count(*) FROM nation) <= 0.2 THEN 'quality_acceptable' ELSE 'quality_poor' END, 'high'""")
def _(t):
    from cellsift.operators.distribution import entropy

    h = entropy(cells(t).groupBy("batch").count(), "count")
    facts = h.select(F.lit(0.04).alias("cp_p90"), F.col("entropy").alias("batch_entropy")).withColumns({
        "n_unknown": t.customer.where("c_acctbal < 0").select(F.count_distinct("c_mktsegment")).scalar(), "n_clusters": t.nation.select(F.count("*")).scalar()})
    return jd.decide("rule", facts)


@query("rule_refine", "SELECT c_mktsegment || '.' || c_nationkey AS cluster, CASE WHEN count(*) >= 12 THEN 'refine_effective' WHEN count(*) >= 6 THEN 'refine_ineffective' ELSE 'refine_skipped' END AS decision FROM customer GROUP BY 1")
def _(t):
    sizes = t.customer.groupBy(F.expr("c_mktsegment || '.' || c_nationkey").alias("cluster")).count()
    return jd.rule_refine(sizes.selectExpr("cluster", "IF(count >= 6, 'analyzed', 'skipped') AS status", "IF(count >= 12, 'analyzed', 'analyzed_nosplit') AS outcome"))


PATCH = """pa AS (SELECT cluster_id AS cluster, arg_max(decision, line) AS decision, arg_max(coalesce(confidence, '-'), line) AS confidence FROM lg WHERE type = 'judgment' AND decision_point = 'label_confirm'
    AND run = 'u0' AND cluster_id IS NOT NULL GROUP BY 1),
  pt AS (SELECT cluster, CASE WHEN none THEN 'unknown' ELSE n_name END AS label, CASE WHEN none OR decision = 'label_downgraded' THEN 'low' WHEN confidence = '-' THEN 'medium' ELSE confidence END AS confidence,
    CASE WHEN none THEN 'unknown' ELSE 'decisive' END AS status FROM (SELECT *, decision = 'label_unknown' OR n_name IS NULL AS none FROM pa LEFT JOIN nation ON CAST(n_nationkey * 2 AS VARCHAR) = cluster)),
  fin AS (SELECT coalesce(pt.cluster, b.cluster) AS cluster, coalesce(pt.label, b.label) AS label, coalesce(pt.confidence, b.confidence) AS confidence, coalesce(pt.status, b.status) AS status FROM pt FULL JOIN
    (SELECT CAST(n_nationkey AS VARCHAR) AS cluster, r_name AS label, 'medium' AS confidence, 'decisive' AS status FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3) b ON b.cluster = pt.cluster)"""


def _patches(t):
    entries = t.nation.select(F.expr("CAST(n_nationkey * 2 AS STRING)").alias("cluster"), F.col("n_name").alias("first_type"))
    return jd.materialize_labels(run_log(t).where("run = 'u0'"), entries)


def _patched(t):
    base = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey > 3").select(
        F.col("n_nationkey").cast("string").alias("cluster"), F.col("r_name").alias("label"), F.lit("medium").alias("confidence"), F.lit("decisive").alias("status"))
    return jd.patch_labels(base, _patches(t))


@query("materialize_labels", with_sql(LOG, PATCH) + "SELECT * FROM pt")
def _(t):
    return _patches(t)


@query("patch_labels", with_sql(LOG, PATCH) + "SELECT * FROM fin")
def _(t):
    return _patched(t)


@query("label_summary", with_sql(LOG, PATCH) + "SELECT count(*) AS n_clusters, count(*) FILTER (status = 'unknown') AS n_unknown, round(count(*) FILTER (status = 'unknown') / count(*), 6) AS unknown_rate, count(DISTINCT label) AS n_unique_labels FROM fin")
def _(t):
    return rounded(jd.label_summary(_patched(t)))


@query("overlay_entry", """SELECT c.k AS cluster, CASE WHEN r.k IS NOT NULL THEN r.label WHEN n.k IS NOT NULL THEN n.label ELSE p.label END AS label, CASE WHEN n.k IS NOT NULL THEN n.status ELSE p.status END AS status
  FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION SELECT p_size FROM part) c
  LEFT JOIN (SELECT p_size AS k, min(p_name) AS label, 'part' AS status FROM part GROUP BY 1) p USING (k) LEFT JOIN (SELECT n_nationkey AS k, n_name AS label, 'nation' AS status FROM nation) n USING (k)
  LEFT JOIN (SELECT r_regionkey AS k, CASE WHEN r_regionkey = 2 THEN NULL ELSE r_name END AS label FROM region) r USING (k)""")
def _(t):
    part = t.part.groupBy(F.col("p_size").alias("cluster")).agg(F.min("p_name").alias("label"), F.lit("part").alias("status"))
    nation = t.nation.select(F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("label"), F.lit("nation").alias("status"))
    region = t.region.select(F.col("r_regionkey").alias("cluster"), F.expr("IF(r_regionkey = 2, NULL, r_name)").alias("label"))
    return jd.overlay_entry([part, nation, region], ["label", "status"])


# Overlap: customers as sets of brands would be many; nations as sets of part sizes are few.
SETS = """st AS (SELECT DISTINCT n_name AS cluster, p_size AS gene FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
  pr AS (SELECT a.cluster AS a, b.cluster AS b, (SELECT count(*) FROM st x JOIN st y USING (gene) WHERE x.cluster = a.cluster AND y.cluster = b.cluster) AS n_shared, a.k AS ka, b.k AS kb
    FROM (SELECT cluster, count(*) AS k FROM st GROUP BY 1) a JOIN (SELECT cluster, count(*) AS k FROM st GROUP BY 1) b ON a.cluster < b.cluster),
  ps AS (SELECT a, b, n_shared, n_shared / greatest(least(ka, kb), 1) AS overlap, n_shared / greatest(ka + kb - n_shared, 1) AS jaccard FROM pr)"""


def _sets(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("cluster"), F.col("p_size").alias("gene"))


@query("set_pairs", with_sql(SETS) + "SELECT a, b, n_shared, round(overlap, 6) AS overlap, round(jaccard, 6) AS jaccard FROM ps")
def _(t):
    return rounded(ov.set_pairs(_sets(t)))


@query("overlap_summary", with_sql(SETS) + "SELECT (SELECT count(DISTINCT cluster) FROM st) AS n_sets, round(avg(overlap), 6) AS mean_overlap, round(max(overlap), 6) AS max_overlap, round(avg(jaccard), 6) AS mean_jaccard FROM ps")
def _(t):
    return rounded(ov.overlap_summary(_sets(t)))


@query("overlap_matrix", with_sql(SETS) + "SELECT a, b, round(overlap, 6) AS overlap FROM ps UNION ALL SELECT b, a, round(overlap, 6) FROM ps UNION ALL SELECT DISTINCT cluster, cluster, 1.0::DOUBLE FROM st")
def _(t):
    return rounded(ov.overlap_matrix(_sets(t)))


@query("unique_fraction", with_sql(SETS) + "SELECT cluster, round(1 - count(*) FILTER (o > 1) / count(*), 6) AS frac_unique FROM st JOIN (SELECT gene, count(*) AS o FROM st GROUP BY 1) USING (gene) GROUP BY 1")
def _(t):
    return rounded(ov.unique_fraction(_sets(t)))


@query("unknown_overlap", with_sql(SETS) + """SELECT (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) AS n_unknown, round((SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) / (SELECT count(*) FROM nation), 6) AS frac_unknown,
  round(coalesce(avg(overlap), 0), 6) AS mean_overlap FROM ps WHERE a IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) AND b IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)""")
def _(t):
    g = t.nation.select(F.col("n_name").alias("cluster"), F.expr("IF(n_nationkey % 2 = 0, 'no_candidates', 'has_candidates')").alias("status"))
    return rounded(ov.unknown_overlap(g, _sets(t)))


MIX = """mx AS (SELECT cluster, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy, count(*) AS n_batches, max(n) / sum(n) AS max_fraction FROM (SELECT cluster, batch, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1)"""


@query("batch_mixing", with_sql(CELLS, MIX) + "SELECT cluster, round(entropy, 6) AS entropy, n_batches, round(max_fraction, 6) AS max_fraction FROM mx")
def _(t):
    return rounded(ov.batch_mixing(cells(t)))


CHI = """ct AS (SELECT c.cluster, b.batch, coalesce(n, 0) AS n, r * k / t AS e FROM (SELECT cluster, count(*) AS r FROM cells GROUP BY 1) c CROSS JOIN (SELECT batch, count(*) AS k FROM cells GROUP BY 1) b
  CROSS JOIN (SELECT count(*) AS t FROM cells) LEFT JOIN (SELECT cluster, batch, count(*) AS n FROM cells GROUP BY 1, 2) USING (cluster, batch))"""


@query("contingency_chi2", with_sql(CELLS, CHI) + """SELECT round(sum((n - e) ** 2 / e), 6) AS chi2, (count(DISTINCT cluster) - 1) * (count(DISTINCT batch) - 1) AS dof, count(DISTINCT cluster) AS n_clusters, count(DISTINCT batch) AS n_batches FROM ct""")
def _(t):
    return rounded(ov.contingency_chi2(cells(t)).drop("p", "yates"))


@query("mixing_index", with_sql(CELLS, MIX) + "SELECT round(avg(entropy) / log2((SELECT count(DISTINCT batch) FROM cells)), 6) AS mixing_index, (SELECT count(DISTINCT batch) FROM cells) AS n_batches FROM mx")
def _(t):
    return rounded(ov.mixing_index(cells(t)))


SUMMARY = """lb AS (SELECT *, coalesce(first_type, 'unknown') AS label FROM gap), pl AS (SELECT label, count(*) AS n FROM lb GROUP BY 1),
  ow AS (SELECT gene, count(DISTINCT cluster) AS o FROM cg GROUP BY 1 HAVING count(DISTINCT cluster) > 1)"""
SUMSQL = with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP, SUMMARY)


@query("global_summary", SUMSQL + """SELECT sum(n)::BIGINT AS n_clusters, sum(CASE WHEN label = 'unknown' THEN n ELSE 0 END)::BIGINT AS n_unknown, count(*) AS n_unique_labels,
  round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS label_entropy, round(sum(CASE WHEN label = 'unknown' THEN n ELSE 0 END) / sum(n), 6) AS unknown_rate, round(count(*) / sum(n), 6) AS label_diversity,
  round(2 ** (log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS effective_n_types, (SELECT round(avg(count_ratio), 6) FROM lb) AS mean_count_ratio, (SELECT count(*) FROM ow) AS n_shared_markers, (SELECT coalesce(max(o), 0) FROM ow) AS max_owners FROM pl""")
def _(t):
    return rounded(ov.global_summary(ov.delivered(gaps(t)), cluster_genes=cluster_genes(t)))


@query("label_clusters", SUMSQL + "SELECT label, string_agg(cluster, ',' ORDER BY cluster) AS clusters, round(count(*) / (SELECT count(*) FROM lb), 6) AS share FROM lb GROUP BY 1")
def _(t):
    return rounded(ov.label_clusters(ov.delivered(gaps(t))).withColumn("clusters", F.array_join("clusters", ",")))


@query("marker_reuse", with_sql(EXPR, CELLS, CG) + "SELECT gene, count(*) AS n_owners FROM cg GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return ov.marker_reuse(cluster_genes(t))


DIAG = MIX + """, dg AS (SELECT gap.cluster, coalesce(h, 0) / greatest(coalesce(m, 0), 1) AS hit_rate, n_candidates, first_count, second_count, first_count > second_count AS strictly_ahead, mx.entropy AS batch_entropy
  FROM gap LEFT JOIN (SELECT cluster, count(*) AS m, count(*) FILTER (gene IN (SELECT gene FROM hits)) AS h FROM cg GROUP BY 1) USING (cluster) LEFT JOIN mx USING (cluster))"""


def _diagnosis(t):
    return ov.cluster_diagnosis(cd.cluster_hits(cluster_genes(t), hits(t)), gaps(t), ov.batch_mixing(cells(t)))


@query("cluster_diagnosis", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP, DIAG) + "SELECT * REPLACE (round(hit_rate, 6) AS hit_rate, round(batch_entropy, 6) AS batch_entropy) FROM dg")
def _(t):
    return rounded(_diagnosis(t))


@query("cross_cluster", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP, SUMMARY, DIAG, CHI) + """SELECT (SELECT round(count(*) / sum(n), 6) FROM pl) AS label_uniqueness, (SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) FROM pl) AS annotation_entropy,
  round(avg(first_count - second_count), 6) AS mean_first_count_gap, round(avg(hit_rate), 6) AS mean_hit_rate, count(*) FILTER (n_candidates = 0) AS n_clusters_no_candidates,
  (SELECT round(avg((SELECT count(*) FROM cg x JOIN cg y USING (gene) WHERE x.cluster = a.cluster AND y.cluster = b.cluster) / least((SELECT count(*) FROM cg x WHERE x.cluster = a.cluster), (SELECT count(*) FROM cg y WHERE y.cluster = b.cluster))), 6) FROM (SELECT DISTINCT cluster FROM cg) a JOIN (SELECT DISTINCT cluster FROM cg) b ON a.cluster < b.cluster) AS mean_marker_overlap,
  (SELECT round(sum((n - e) ** 2 / e), 6) FROM ct) AS chi2 FROM dg""")
def _(t):
    return rounded(ov.cross_cluster(_diagnosis(t), ov.delivered(gaps(t)), cluster_genes(t), cells(t)))


@query("metadata_check", "SELECT 'scanpy_version' AS field UNION ALL SELECT 'kg_version' WHERE (SELECT count(*) FROM nation) < 100")
def _(t):
    meta = t.region.selectExpr("CASE r_regionkey WHEN 0 THEN 'kg_source' WHEN 1 THEN 'kg_version' WHEN 2 THEN 'organ' WHEN 3 THEN 'annotation_date' ELSE 'other' END AS field",
                               "IF(r_regionkey = 1, NULL, r_name) AS value")
    return ov.metadata_check(meta)
