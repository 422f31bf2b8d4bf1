"""The append-only run log: attempts, checks, citations, corrections, cost.

A log is run, line, seq, ts, type, session_id, run_id, parameters, metrics (JSON
text), decision_point, scope(type, cluster_id), run_ref, inputs(array of path,
value), output(decision, confidence, action), reasoning, final_summary. A run may
hold much of the log, so ordered passes go through ``running``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.functions.fixed import (DECISION_RANK, DECISION_TIER, DECISIONS, MAX_ATTEMPT, METRIC_DIRECTION,
                                      RECORD_TYPES, RUN_ID_PATTERN)
from cellsift.functions.scalars import fold_cluster_ids, token_estimate
from cellsift.operators.distribution import describe
from cellsift.operators.running import running

RANK_STEP = "step4_rank.rank_candidates"
COVERED = ("candidate_gap", "label_confirm")


def _map(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _enum(key: Column) -> Column:
    table = F.create_map(*[x for k, (_, names) in DECISIONS.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    return F.try_element_at(table, key)


def next_attempt(log: DataFrame) -> DataFrame:
    """Next run id per (run, step.op): highest attempt + 1; ``allowed`` is false beyond the cap."""
    parts = log.select("run", F.regexp_extract("run_id", r"^(.+)#(\d+)$", 1).alias("key"),
                       F.regexp_extract("run_id", r"^(.+)#(\d+)$", 2).alias("_n")).where("key <> ''")
    return parts.groupBy("run", "key").agg((F.max(F.col("_n").cast("int")) + 1).alias("attempt")).select(
        "run", "key", "attempt", F.concat_ws("#", "key", F.col("attempt").cast("string")).alias("run_id"),
        (F.col("attempt") <= MAX_ATTEMPT).alias("allowed"))


def latest_exec(log: DataFrame, after: int | None = None) -> DataFrame:
    """Metrics of the highest-seq execution per (run, step.op), optionally after a seq."""
    execs = log.where("type = 'exec' AND run_id IS NOT NULL")
    if after is not None:
        execs = execs.where(F.col("seq") > after)
    key = F.substring_index("run_id", "#", 1)
    return execs.groupBy("run", key.alias("key")).agg(
        F.max("seq").alias("seq"), F.max_by(F.struct("run_id", "metrics"), F.struct("seq", "line")).alias("_m")
    ).select("run", "key", "seq", "_m.run_id", "_m.metrics")


def orphan_refs(log: DataFrame) -> DataFrame:
    """Judgements whose run_ref names no execution seen earlier in their run."""
    seen = log.where((F.col("type") == "exec") & F.col("run_id").rlike(RUN_ID_PATTERN)).groupBy(
        "run", F.col("run_id").alias("run_ref")).agg(F.min("line").alias("_first"))
    judged = log.where("type = 'judgment' AND run_ref IS NOT NULL").select("run", "line", "run_ref")
    return judged.join(seen, ["run", "run_ref"], "left").where("_first IS NULL OR _first > line").drop("_first")


def asof_decision(log: DataFrame) -> DataFrame:
    """Executions with the latest judgement at or before them in seq order (judgement first on ties)."""
    told = log.where("type IN ('exec', 'judgment') AND seq IS NOT NULL").select(
        "run", "seq", "line", "type", "run_id",
        (F.col("type") == "exec").cast("int").alias("_e"),
        F.when(F.col("type") == "judgment", F.coalesce("decision_point", F.lit("unknown"))).alias("_dp"),
    )
    seen = running(told, ["run"], ["seq", "_e", "line"], {"current_point": ("last", "_dp")})
    return seen.where("type = 'exec'").select("run", "seq", "line", "run_id", "current_point")


def point_rounds(log: DataFrame) -> DataFrame:
    """Per decision point: executions under it, judgements, executions per judgement."""
    execs = asof_decision(log).where("current_point IS NOT NULL").groupBy("run", F.col("current_point").alias("decision_point")).agg(
        F.count("*").alias("n_execs"))
    judged = log.where("type = 'judgment'").groupBy("run", F.coalesce("decision_point", F.lit("unknown")).alias("decision_point")).agg(
        F.count("*").alias("n_judgments"))
    return judged.join(execs, ["run", "decision_point"], "left").withColumn("n_execs", F.coalesce("n_execs", F.lit(0))).withColumn(
        "execs_per_judgment", F.col("n_execs") / F.col("n_judgments"))


def validate_log(log: DataFrame, mode: str = "auto") -> DataFrame:
    """(run, line, level, message) for every broken rule; line 0 is about the run as a whole."""
    ok_seq = F.when(F.col("seq") >= 1, F.col("seq"))
    ranked = F.when(
        (F.col("type") == "exec") & F.col("run_id").startswith(RANK_STEP + "#"),
        F.get_json_object("metrics", "$.n_clusters").try_cast("int"))
    seen = running(
        log.withColumns({"_seq": ok_seq, "_n": F.when(ranked >= 0, F.struct(F.col("seq").alias("s"), ranked.alias("n")))}),
        ["run"], ["line"], {"_prev": ("last", "_seq", "before"), "_last_n": ("max", "_n", "before")},
    )
    dp, decision = F.col("decision_point"), F.col("output.decision")
    need = _map({k: v[0] for k, v in DECISIONS.items()}, dp)
    cid = F.col("scope.cluster_id")
    is_exec, is_judgment = F.col("type") == "exec", F.col("type") == "judgment"
    known_dp = need.isNotNull()
    clustered = is_judgment & known_dp & F.col("scope").isNotNull() & (need == "cluster")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules: list[tuple[Column, str, str]] = [
        (blank("ts"), "error", "ts missing"),
        (F.col("_seq").isNull(), "error", "seq invalid"),
        (F.col("_seq") != F.coalesce("_prev", F.lit(0)) + 1, "error", "seq not consecutive"),
        (~F.coalesce(F.col("type").isin(RECORD_TYPES), F.lit(False)), "error", "type invalid"),
        (is_exec & ~F.coalesce(F.col("run_id").rlike(RUN_ID_PATTERN), F.lit(False)), "error", "exec run_id invalid"),
        (is_exec & F.col("parameters").isNull(), "error", "exec parameters missing"),
        (is_exec & F.col("metrics").isNull(), "error", "exec metrics missing"),
        (is_judgment & ~known_dp, "error", "decision_point invalid"),
        (is_judgment & known_dp & ~F.coalesce(F.array_contains(_enum(dp), decision), F.lit(False)), "error", "decision not allowed"),
        *[(is_judgment & F.col(c).isNull(), "error", f"judgment {c} missing") for c in ("scope", "run_ref", "output", "reasoning")],
        (is_judgment & F.col("scope").isNotNull() & ~F.coalesce(F.col("scope.type").isin("session", "cluster"), F.lit(False)),
         "error", "scope type invalid"),
        (is_judgment & known_dp & F.col("scope").isNotNull() & ~F.col("scope.type").eqNullSafe(need), "error", "scope granularity"),
        (clustered & blank("scope.cluster_id"), "error", "cluster_id missing"),
        (clustered & cid.rlike("^[0-9]+$") & (cid.try_cast("int") >= F.col("_last_n.n")), "error", "cluster_id out of range"),
        (is_judgment & F.col("inputs").isNull(), "error", "inputs not a list"),
        (is_judgment & F.exists(F.coalesce("inputs", F.array().cast("array<struct<path:string,value:string>>")),
                                lambda i: i["path"].isNull() | i["value"].isNull()), "warning", "input lacks path or value"),
        (is_judgment & F.col("output").isNotNull() & F.col("output.confidence").isNull(), "warning", "output confidence missing"),
        (is_judgment & F.col("output").isNotNull() & F.col("output.action").isNull(), "warning", "output action missing"),
        (is_judgment & blank("reasoning"), "error", "reasoning empty"),
        ((F.col("type") == "session_start") & F.col("session_id").isNull(), "error", "session_id missing"),
        ((F.col("type") == "session_end") & F.col("final_summary").isNull(), "warning", "final_summary missing"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(lv).alias("level"), F.lit(m).alias("message"))) for c, lv, m in rules]))
    per_line = seen.select("run", "line", F.explode(found).alias("_i")).select("run", "line", "_i.*")

    has = lambda t: F.count_if(F.col("type") == t) > 0
    per_run = log.groupBy("run").agg(
        *[has(t).alias(t) for t in ("session_start", "session_end", "exec")],
        F.max(F.when(ranked >= 0, F.struct("seq", ranked.alias("n")))).alias("_n"),
    )
    e2e = F.lit(mode == "e2e") if mode in ("e2e", "mini") else F.col("session_start")
    coverage = (
        log.where((F.col("type") == "judgment") & F.col("decision_point").isin(*COVERED) & F.col("scope.cluster_id").rlike("^[0-9]+$"))
        .groupBy("run", "decision_point").agg(F.count_distinct("scope.cluster_id").alias("_c"))
    )
    runs = per_run.withColumn("_e2e", e2e)
    session = F.array_compact(F.array(
        *[F.when(F.col("_e2e") & ~F.col(t), F.struct(F.lit("error").alias("level"), F.lit(f"{t} record missing").alias("message")))
          for t in ("session_start", "session_end", "exec")],
        F.when(~F.col("_e2e") & F.col("exec") & ~F.col("session_start"),
               F.struct(F.lit("warning").alias("level"), F.lit("exec records without session_start").alias("message"))),
    ))
    zero = F.lit(0).cast("long").alias("line")
    whole = runs.select("run", zero, F.explode(session).alias("_i")).select("run", "line", "_i.*")
    short = coverage.join(runs.where("_e2e AND _n.n > 0").select("run", F.col("_n.n").alias("_k")), "run").where("_c < _k").select(
        "run", zero, F.lit("warning").alias("level"), F.concat("decision_point", F.lit(" does not cover all clusters")).alias("message"))
    orphans = orphan_refs(log).join(runs.where("_e2e").select("run"), "run", "left_semi").select(
        "run", "line", F.lit("warning").alias("level"), F.lit("run_ref names no earlier exec").alias("message"))
    return per_line.unionByName(whole).unionByName(short).unionByName(orphans)


def log_verdict(log: DataFrame, issues: DataFrame) -> DataFrame:
    """Per run: errors, warnings, exit code."""
    n = issues.groupBy("run").agg(
        F.count_if(F.col("level") == "error").alias("n_errors"), F.count_if(F.col("level") == "warning").alias("n_warnings"))
    return log.select("run").distinct().join(n, "run", "left").fillna(0).withColumn("code", (F.col("n_errors") > 0).cast("int"))


def valid_judgments(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be appended, their issues): the row rules of validate_log before a seq exists."""
    issues = validate_log(staged.withColumn("seq", F.col("line")), "mini").where(
        "line > 0 AND level = 'error' AND message NOT LIKE 'seq%'")
    bad_ref = staged.where(~F.coalesce(F.col("run_ref").rlike(RUN_ID_PATTERN), F.lit(False)) & (F.col("type") == "judgment")).select(
        "run", "line", F.lit("error").alias("level"), F.lit("run_ref invalid").alias("message"))
    issues = issues.unionByName(bad_ref)
    return staged.join(issues.select("run", "line").distinct(), ["run", "line"], "left_anti"), issues


def append_rows(log: DataFrame, rows: DataFrame, ts: Column | None = None) -> DataFrame:
    """Give new rows the UTC time and the next seqs of their run, in line order."""
    top = log.groupBy("run").agg(F.max("seq").alias("_top"))
    numbered = running(rows.withColumn("_one", F.lit(1).cast("long")), ["run"], ["line"], {"_k": ("sum", "_one")})
    stamp = ts if ts is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return numbered.join(top, "run", "left").withColumns(
        {"seq": F.coalesce("_top", F.lit(0)) + F.col("_k"), "ts": stamp}).drop("_top", "_k", "_one")


def cited(log: DataFrame) -> DataFrame:
    """(run, decision_point, path) for every cited input."""
    return log.where("type = 'judgment' AND coalesce(decision_point, '') <> ''").select(
        "run", "decision_point", F.explode("inputs").alias("_i")).select(
        "run", "decision_point", F.col("_i.path").alias("path")).where("coalesce(path, '') <> ''")


def metric_usage(log: DataFrame) -> DataFrame:
    """(decision_point, path, n)."""
    return cited(log).groupBy("decision_point", "path").agg(F.count("*").alias("n"))


def usage_summary(log: DataFrame) -> DataFrame:
    """Judgements, distinct cited paths, decision points that cite."""
    judged = log.where("type = 'judgment'").select(F.count("*")).scalar()
    return cited(log).agg(
        F.count_distinct("path").alias("n_paths"), F.count_distinct("decision_point").alias("n_points"), F.count("*").alias("n_citations")
    ).withColumn("n_judgments", judged)


def fold_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("decision_point", fold_cluster_ids("path").alias("path")).agg(F.sum("n").alias("n"))


def core_paths(usage: DataFrame, min_points: int = 2, top: int = 20) -> DataFrame:
    """Paths cited at min_points or more points, or among the top of one; most cited first."""
    w = W.partitionBy("decision_point").orderBy(F.col("n").desc(), "path")
    best = usage.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("path").distinct()
    per_path = usage.groupBy("path").agg(F.sum("n").alias("n"), F.count_distinct("decision_point").alias("n_points"))
    return per_path.join(best.withColumn("_top", F.lit(True)), "path", "left").where(
        (F.col("n_points") >= min_points) | F.col("_top")).select("path", "n", "n_points").orderBy(F.col("n").desc(), "path")


def top_paths(usage: DataFrame, k: int = 10) -> DataFrame:
    w = W.partitionBy("decision_point").orderBy(F.col("n").desc(), "path")
    return usage.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def path_expansion(usage: DataFrame) -> DataFrame:
    """Raw against folded distinct paths per point; heavy above max(3, 2 x median ratio)."""
    per = usage.groupBy("decision_point").agg(
        F.count_distinct("path").alias("n_raw"), F.count_distinct(fold_cluster_ids("path")).alias("n_folded"),
    ).withColumn("_x", F.col("n_raw") / F.col("n_folded"))
    # One row per decision point: a short list. Its upper middle value is the median.
    ratios = per.select(F.array_sort(F.collect_list("_x")).alias("r")).select(F.expr(
        "IF(size(r) >= 2, greatest(3D, 2 * element_at(r, CAST(floor(size(r) / 2) AS INT) + 1)), 3D)")).scalar()
    return per.withColumn("_t", ratios).select(
        "decision_point", "n_raw", "n_folded", F.round("_x", 2).alias("expansion_ratio"), (F.col("_x") > F.col("_t")).alias("heavy"),
        F.round("_t", 2).alias("heavy_threshold"))


def scope_key(scope: str = "scope") -> Column:
    """Canonical text of a scope: sorted keys, nulls left out."""
    return F.to_json(F.struct(F.col(f"{scope}.cluster_id"), F.col(f"{scope}.type")))


def self_corrections(log: DataFrame) -> DataFrame:
    """First and last judgement of every (run, point, scope) that was judged at least twice."""
    one = F.struct(F.col("output.decision").alias("decision"), "run_ref", "seq", "ts")
    order = F.struct("seq", "ts", "line")
    return (
        log.where("type = 'judgment'")
        .groupBy("run", F.coalesce("decision_point", F.lit("")).alias("decision_point"), scope_key().alias("scope"))
        .agg(F.count("*").alias("n_versions"), F.min_by(one, order).alias("first"), F.max_by(one, order).alias("last"))
        .where("n_versions >= 2")
        .withColumn("changed", ~F.col("first.decision").eqNullSafe(F.col("last.decision")))
    )


def correction_versions(log: DataFrame) -> DataFrame:
    """All versions of the corrected judgements, in long form."""
    pairs = self_corrections(log).select("run", "decision_point", "scope")
    return log.where("type = 'judgment'").select(
        "run", F.coalesce("decision_point", F.lit("")).alias("decision_point"), scope_key().alias("scope"), "seq", "ts", "line",
        F.col("output.decision").alias("decision"), "run_ref").join(pairs, ["run", "decision_point", "scope"], "left_semi")


def correction_counts(log: DataFrame) -> DataFrame:
    """Per run: judgements, distinct keys, keys judged again, keys whose decision changed."""
    keys = log.where("type = 'judgment'").groupBy("run", "decision_point", scope_key().alias("scope")).agg(F.count("*").alias("_n"))
    base = keys.groupBy("run").agg(F.sum("_n").alias("n_judgments"), F.count("*").alias("n_keys"))
    again = self_corrections(log).groupBy("run").agg(F.count("*").alias("n_pairs"), F.count_if("changed").alias("n_changed"))
    return base.join(again, "run", "left").fillna(0)


def correction_verdict(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """improved / unchanged / no_evidence / no_change per corrected judgement, and the method used."""
    execs = log.where("type = 'exec' AND run_id IS NOT NULL").groupBy("run", "run_id").agg(F.max_by("metrics", "line").alias("m"))
    side = lambda end: execs.select("run", F.col("run_id").alias(f"_{end}_ref"), F.col("m").alias(f"_{end}_m"))
    both = (
        pairs.withColumns({"_first_ref": F.col("first.run_ref"), "_last_ref": F.col("last.run_ref")})
        .join(side("first"), ["run", "_first_ref"], "left").join(side("last"), ["run", "_last_ref"], "left")
    )
    a, b, dp = F.col("first.decision"), F.col("last.decision"), F.col("decision_point")
    pairs_of = lambda table: {f"{p}\t{d}": t for p, names in table.items() for d, t in names.items()}
    rank = lambda d: _map(pairs_of(DECISION_RANK), F.concat_ws("\t", dp, d))
    tier = lambda d: F.coalesce(_map(pairs_of(DECISION_TIER), F.concat_ws("\t", dp, d)), F.lit(1))

    def moved(path: str, way: str) -> Column:
        old = F.get_json_object("_first_m", f"$.{path}").try_cast("double")
        new = F.get_json_object("_last_m", f"$.{path}").try_cast("double")
        return F.coalesce(new > old if way == "up" else new < old, F.lit(False))

    metric = F.lit(False)
    for point, rules in METRIC_DIRECTION.items():
        for path, way in rules:
            metric = metric | ((dp == point) & moved(path, way))
    accepted = (dp == "clustering_quality") & (a == "clustering_adjust") & (b == "clustering_accept")
    method = (
        F.when(dp.isin(*DECISION_RANK), "ranking_based").when(dp.isin(*METRIC_DIRECTION), "metric_based").otherwise("oracle_heuristic")
    )
    said = lambda c: F.when(F.coalesce(c, F.lit(False)), "improved").otherwise("unchanged")
    verdict = (
        F.when(~F.col("changed"), "no_change")
        .when(method == "ranking_based", said(rank(b) > rank(a)))
        .when((method == "metric_based") & (F.col("_first_m").isNull() | F.col("_last_m").isNull()), "no_evidence")
        .when(method == "metric_based", said(accepted | metric))
        .otherwise(said(dp.isin(*DECISION_TIER) & (tier(b) > tier(a))))
    )
    unknown = ~F.coalesce(F.array_contains(_enum(dp), a) & F.array_contains(_enum(dp), b), F.lit(False))
    return both.select(*pairs.columns, method.alias("method"), verdict.alias("verdict"), unknown.alias("unlisted_decision"))


def improvement_rate(verdicts: DataFrame) -> DataFrame:
    """Counts and rates by run x point, by run, by point and overall; absent keys are null."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    scored = n("improved") + n("unchanged")
    return verdicts.groupingSets([["run", "decision_point"], ["run"], ["decision_point"], []], "run", "decision_point").agg(
        F.count("*").alias("n_pairs"), scored.alias("n_scored"), n("improved").alias("n_improved"), n("unchanged").alias("n_unchanged"),
        n("no_evidence").alias("n_no_evidence"), n("no_change").alias("n_no_change"),
        F.round(F.try_divide(n("improved").cast("double"), scored), 3).alias("conditional_rate"),
        F.round(F.try_divide(n("improved").cast("double"), F.count("*")), 3).alias("unconditional_rate"),
    )


TRAP_POINTS = ("candidate_gap", "candidate_disambiguate", "refine_effect", "label_confirm", "qc_threshold", "batch_effect")


def trap_mask(clusters: DataFrame) -> DataFrame:
    """(cluster, decision_point, trap): clusters where the point is easy to get wrong.

    ``clusters``: cluster, count_ratio, count_diff, related, outcome, max_top_pct1, max_top_pct2.
    """
    ratio, diff = F.coalesce("count_ratio", F.lit(0.0)), F.coalesce("count_diff", F.lit(0))
    no = F.lit(False)
    masks = {
        "candidate_gap": ((ratio != 0) & (ratio < 1.2)) | (diff < 3) | F.coalesce("related", no),
        "candidate_disambiguate": (ratio != 0) & (ratio < 2),
        "refine_effect": F.coalesce(F.col("outcome") == "analyzed", no),
        "label_confirm": F.coalesce((F.col("max_top_pct1") > 0.5) & (F.col("max_top_pct2") > 0.5), no),
        "qc_threshold": F.lit(True),
        "batch_effect": F.lit(True),
    }
    pairs = F.array(*[F.struct(F.lit(p).alias("decision_point"), masks[p].alias("trap")) for p in TRAP_POINTS])
    return clusters.select("cluster", F.explode(pairs).alias("_p")).select("cluster", "_p.*")


def trap_report(masks: DataFrame, log: DataFrame) -> DataFrame:
    """Decision counts per run, point and trap flag; the first decision of a cluster counts."""
    first = (
        log.where((F.col("type") == "judgment") & F.col("decision_point").isin(*TRAP_POINTS) & (F.coalesce("scope.cluster_id", F.lit("")) != ""))
        .groupBy("run", "decision_point", F.col("scope.cluster_id").alias("cluster"))
        .agg(F.min_by("output.decision", "line").alias("decision"))
    )
    runs = log.where("type = 'judgment'").select("run").distinct()
    # All cells of the report: masks are one row per cluster and point, runs are joined through their own list.
    listed = masks.groupBy("decision_point", "trap").agg(F.collect_list("cluster").alias("_c"))
    counted = first.join(masks, ["cluster", "decision_point"]).groupBy("run", "decision_point", "trap", "decision").agg(F.count("*").alias("n"))
    judged = counted.groupBy("run", "decision_point", "trap").agg(F.sum("n").alias("_n"))
    slots = listed.select(F.collect_list(F.struct("decision_point", "trap", F.size("_c").alias("_size")))).scalar()
    silent = (
        runs.withColumn("_s", slots).select("run", F.explode("_s").alias("_x")).select("run", "_x.*")
        .join(judged, ["run", "decision_point", "trap"], "left")
        .select("run", "decision_point", "trap", F.lit("<no_judgment>").alias("decision"), (F.col("_size") - F.coalesce("_n", F.lit(0))).alias("n"))
        .where("n > 0")
    )
    return counted.unionByName(silent)


def trap_wins(report: DataFrame, a: str, b: str) -> DataFrame:
    """At how many points run b decides with more entropy than run a on trap clusters."""
    from cellsift.operators.distribution import entropy

    h = entropy(report.where("trap").where(F.col("run").isin(a, b)), "n", ["decision_point", "run"])
    wide = h.groupBy("decision_point").agg(
        F.max(F.when(F.col("run") == a, F.col("entropy"))).alias("_a"), F.max(F.when(F.col("run") == b, F.col("entropy"))).alias("_b")
    ).where("_a IS NOT NULL AND _b IS NOT NULL")
    return wide.agg(F.count_if(F.col("_b") > F.col("_a")).alias("wins"), F.count("*").alias("applicable"))


def conversation_cost(conversation: DataFrame, budget: int = 400_000) -> DataFrame:
    """Per conversation: token estimate over text and tool arguments, tool rounds, budget verdict."""
    args = F.aggregate(
        F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,args:string>>")),
                    lambda c: token_estimate(c["args"])), F.lit(0).cast("long"), lambda a, x: a + x)
    return conversation.groupBy("conv_id").agg(
        F.sum(token_estimate("content") + args).alias("total_tokens"),
        F.count_if((F.col("role") == "assistant") & (F.size("tool_calls") > 0)).alias("tool_rounds"),
    ).withColumn("within_budget", F.col("total_tokens") <= budget)


def wall_clock(log: DataFrame) -> DataFrame:
    """Seconds from a run's first session_start to its last session_end."""
    at = F.to_timestamp(F.col("ts"))
    return log.groupBy("run").agg(
        F.min_by(F.when(F.col("type") == "session_start", at), F.when(F.col("type") == "session_start", F.col("line"))).alias("started"),
        F.max_by(F.when(F.col("type") == "session_end", at), F.when(F.col("type") == "session_end", F.col("line"))).alias("ended"),
    ).withColumn("wall_seconds", F.when(F.col("started").isNotNull(), F.unix_micros("ended") - F.unix_micros("started")) / 1e6)


def tool_usage(conversation: DataFrame) -> DataFrame:
    """(conv_id, name, n): tool calls of the assistant."""
    return conversation.where("role = 'assistant'").select("conv_id", F.explode("tool_calls").alias("_t")).groupBy(
        "conv_id", F.col("_t.name").alias("name")).agg(F.count("*").alias("n"))


def note_usage(conversation: DataFrame, threshold: int = 3) -> DataFrame:
    """Per conversation: note writes, reads, mentions of notes in text, pass flag."""
    calls = lambda n: F.sum(F.when(F.col("role") == "assistant", F.size(F.filter(
        F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,args:string>>")), lambda c: c["name"] == n))).otherwise(0))
    mention = (F.col("role") == "assistant") & F.col("content").rlike("笔记|(?i)note|retrieve")
    return conversation.groupBy("conv_id").agg(
        calls("write_note").alias("n_writes"), calls("retrieve_notes").alias("n_reads"), F.count_if(mention).alias("n_mentions"),
        F.count("*").alias("n_records"),
    ).withColumn("usage_pass", F.col("n_writes") + F.col("n_reads") >= threshold)


def smoke_flags(usage: DataFrame, notes: DataFrame, writes: int = 1, reads: int = 1) -> DataFrame:
    """Pass flags over all conversations: writes, reads, notes that persisted."""
    kept = notes.where("trim(coalesce(content, '')) <> ''").select(F.count("*")).scalar()
    return usage.agg(F.sum("n_writes").alias("n_writes"), F.sum("n_reads").alias("n_reads")).withColumn("n_notes", kept).withColumns(
        {"write_pass": F.col("n_writes") >= writes, "read_pass": F.col("n_reads") >= reads, "persist_pass": F.col("n_notes") >= writes}
    ).withColumn("passed", F.col("write_pass") & F.col("read_pass") & F.col("persist_pass"))
