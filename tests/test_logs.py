import json

import pytest
from pyspark.sql import functions as F

from cellsift.operators import judges as jd
from cellsift.operators import retrieval as rt
from cellsift.operators import runlog as rl
from cellsift.sources.readers import LOG_SCHEMA

FIELDS = [c.split()[0] for c in LOG_SCHEMA.replace("struct<type:string,cluster_id:string>", "x").replace("array<struct<path:string,value:string>>", "x").replace(
    "struct<decision:string,confidence:string,action:string>", "x").split(", ")]


def log(spark, *records):
    rows = []
    for i, r in enumerate(records, 1):
        full = dict.fromkeys(FIELDS)
        full.update({"ts": "2026-01-01T00:00:0%dZ" % i, "seq": i}, **r)
        rows.append(("r", i, *[full[f] for f in FIELDS]))
    return spark.createDataFrame(rows, "run string, line bigint, " + LOG_SCHEMA)


START, END = {"type": "session_start", "session_id": "s"}, {"type": "session_end", "final_summary": "{}"}


def run(n=None, op="step4_rank.rank_candidates#1"):
    return {"type": "exec", "run_id": op, "parameters": "{}", "metrics": json.dumps({"n_clusters": n} if n else {})}


def judged(dp="kg_match", decision="id_match_ok", scope=("session", None), ref="step4_rank.rank_candidates#1", **more):
    return {"type": "judgment", "decision_point": dp, "scope": scope, "run_ref": ref, "inputs": [("a.b", "1")],
            "output": (decision, "high", "proceed"), "reasoning": "because", **more}


def issues(df, mode="auto"):
    return {(r["level"], r["message"]) for r in rl.validate_log(df, mode).collect()}


def code(df, mode="auto"):
    return rl.log_verdict(df, rl.validate_log(df, mode)).first()["code"]


def test_log_modes(spark):
    bad = log(spark, START, run(5), judged(scope=("cluster", "1")), END)
    assert ("error", "scope granularity") in issues(bad) and code(bad) == 1
    good = log(spark, START, run(5), judged(), END)
    assert issues(good) == set() and code(good) == 0
    alone = log(spark, judged())
    assert code(alone) == 0 and code(alone, "mini") == 0
    assert {m for _, m in issues(alone, "e2e")} >= {"session_start record missing", "session_end record missing", "exec record missing"}
    assert issues(log(spark, run(5), judged())) == {("warning", "exec records without session_start")}
    both = issues(log(spark, judged(decision="bogus", scope=("cluster", "1"))), "mini")
    assert {("error", "decision not allowed"), ("error", "scope granularity")} <= both


def test_log_rules(spark):
    got = issues(log(spark, START, run(3), judged("candidate_gap", "first_decisive", ("cluster", "7")), judged("label_confirm", "label_confirmed", ("cluster", None), ref="x.y#1"),
                     {**judged(), "seq": 9, "reasoning": " "}, END))
    assert {m for _, m in got} == {"cluster_id out of range", "cluster_id missing", "run_ref names no earlier exec", "seq not consecutive", "reasoning empty", "candidate_gap does not cover all clusters"}


def test_attempts_and_latest(spark):
    df = log(spark, run(1, "a.b#5"), run(2, "a.b#6"), run(3, "a.c#1"))
    got = {r["key"]: (r["run_id"], r["allowed"]) for r in rl.next_attempt(df).collect()}
    assert got == {"a.b": ("a.b#7", False), "a.c": ("a.c#2", True)}
    assert {r["key"]: r["run_id"] for r in rl.latest_exec(df).collect()} == {"a.b": "a.b#6", "a.c": "a.c#1"}
    assert [r["seq"] for r in rl.append_rows(df, log(spark, judged(), judged())).orderBy("seq").collect()] == [4, 5]


def test_asof_takes_the_judgement_first_on_ties(spark):
    df = log(spark, run(1), judged("kg_match"), {**run(2), "seq": 2}, run(3))
    assert [(r["line"], r["current_point"]) for r in rl.asof_decision(df).orderBy("line").collect()] == [(1, None), (3, "kg_match"), (4, "kg_match")]


def test_corrections(spark):
    m = lambda v: {"type": "exec", "parameters": "{}", "metrics": json.dumps({"silhouette_overall": {"mean": v}})}
    df = log(spark, {**m(0.1), "run_id": "a.b#1"}, {**m(0.3), "run_id": "a.b#2"},
             judged("clustering_quality", "clustering_accept", ref="a.b#1"), judged("clustering_quality", "clustering_adjust", ref="a.b#2"),
             judged("candidate_gap", "ambiguous_true", ("cluster", "1")), judged("candidate_gap", "first_decisive", ("cluster", "1")),
             judged("candidate_gap", "first_decisive", ("cluster", "2")), judged("candidate_gap", "first_decisive", ("cluster", "2")),
             judged("marker_quality", "markers_accept", ref="q.r#1"), judged("marker_quality", "markers_fail", ref="q.r#2"),
             judged("qc_threshold", "threshold_set"), judged("qc_threshold", "threshold_default"))
    got = {(r["decision_point"], r["scope"]): r["verdict"] for r in rl.correction_verdict(rl.self_corrections(df), df).collect()}
    assert got == {("clustering_quality", '{"type":"session"}'): "improved", ("candidate_gap", '{"cluster_id":"1","type":"cluster"}'): "improved",
                   ("candidate_gap", '{"cluster_id":"2","type":"cluster"}'): "no_change", ("marker_quality", '{"type":"session"}'): "no_evidence",
                   ("qc_threshold", '{"type":"session"}'): "unchanged"}
    total = rl.improvement_rate(rl.correction_verdict(rl.self_corrections(df), df)).where("run IS NULL AND decision_point IS NULL").first()
    assert (total["n_pairs"], total["n_scored"], total["conditional_rate"], total["unconditional_rate"]) == (5, 3, 0.667, 0.4)


def test_folding_and_expansion(spark):
    usage = spark.createDataFrame([("p", f"a.per_cluster.{i}.x", 1) for i in range(8)] + [("q", "b", 3)], "decision_point string, path string, n int")
    assert {r["path"] for r in rl.fold_usage(usage).collect()} == {"a.<CLUSTER_ID>.x", "b"}
    got = {r["decision_point"]: (r["n_raw"], r["n_folded"], r["heavy"]) for r in rl.path_expansion(usage).collect()}
    assert got == {"p": (8, 1, False), "q": (1, 1, False)}


def test_cost_and_tools(spark):
    rows = [("c", "system", "x" * 9, None), ("c", "user", "", None), ("c", "assistant", None, [("1", "write_note", "abcdefgh")]), ("c", "assistant", "my note", None)]
    conv = spark.createDataFrame(rows, "conv_id string, role string, content string, tool_calls array<struct<id:string,name:string,args:string>>")
    got = rl.conversation_cost(conv, 5).first()
    assert (got["total_tokens"], got["tool_rounds"], got["within_budget"]) == (2 + 2 + 1, 1, True)
    use = rl.note_usage(conv).first()
    assert (use["n_writes"], use["n_reads"], use["n_mentions"], use["usage_pass"]) == (1, 0, 1, False)
    clock = rl.wall_clock(log(spark, START, run(1), END)).first()
    assert clock["wall_seconds"] == 2.0


def test_judges(spark):
    entries = spark.createDataFrame([("0", "t", "has_candidates", 2.5, 0.9, 0.1), ("1", "t", "has_candidates", 1.0, 0.9, 0.1), ("2", "t", "has_candidates", 1.5, 0.9, 0.7), ("3", None, "no_candidates", None, None, None)],
                                    "cluster string, first_type string, status string, count_ratio double, max_top_pct1 double, max_top_pct2 double")
    got = {r["cluster"]: (r["decision"], r["confidence"]) for r in jd.rule_labels(entries).collect()}
    assert got == {"0": ("label_confirmed", "high"), "1": ("label_downgraded", "low"), "2": ("label_downgraded", "low"), "3": ("label_unknown", "low")}
    patches = jd.materialize_labels(log(spark, judged("label_confirm", "label_unknown", ("cluster", "0")), judged("label_confirm", "label_downgraded", ("cluster", "0")),
                                        judged("label_confirm", "label_confirmed", ("cluster", "3"))), entries)
    assert {r["cluster"]: tuple(r)[1:] for r in patches.collect()} == {"0": ("t", "low", "decisive"), "3": ("unknown", "low", "unknown")}
    final = spark.createDataFrame([("0", "old", "high", "decisive"), ("9", "keep", "high", "decisive")], "cluster string, label string, confidence string, status string")
    assert {r["cluster"]: r["label"] for r in jd.patch_labels(final, patches).collect()} == {"0": "t", "3": "unknown", "9": "keep"}
    with pytest.raises(ValueError):
        jd.require_labels(patches.limit(0))
    points = spark.createDataFrame([("kg_match",), ("qc_threshold",)], "decision_point string")
    assert {r["decision"] for r in jd.decide("default", points).collect()} == {"id_match_ok", "threshold_default"}
    jd.judge("broken")(lambda m: m.select("decision_point", F.lit("nope").alias("decision"), F.lit("low").alias("confidence")))
    with pytest.raises(Exception, match="not allowed"):
        jd.decide("broken", points).collect()


def test_retrieval(spark):
    notes = spark.createDataFrame([("note-0001", ["a"], "silhouette 0.15 聚类质量差"), ("note-0002", ["b"], "marker genes 很好"), ("note-0003", ["a", "b"], "聚类")], "doc_id string, tags array<string>, text string")
    got = rt.bm25_topk(notes, "聚类质量", 3).collect()
    assert got[0]["doc_id"] == "note-0001" and got[0]["score"] > 0 and len(got) == 3
    assert [r["doc_id"] for r in rt.bm25_topk(notes, "marker", 5, ["b"]).collect()] == ["note-0002", "note-0003"]
    named = notes.withColumnsRenamed({"doc_id": "note_id", "text": "content"}).withColumns({c: F.lit("") for c in ("ts", "session_id", "project_id")})
    assert rt.next_note_id(named).first()[0] == "note-0004"
    with pytest.raises(ValueError):
        rt.add_note(named, "  ")
    from cellsift.functions.scalars import tokens

    toks = notes.limit(1).select(tokens("text")).first()[0]
    assert toks == ["silhouette", "0", "15", "聚", "类", "质", "量", "差"]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, x array<double>")
    assert [(r["id"], r["score"]) for r in rt.cosine_topk(vec, [2.0, 0.0], 2).collect()] == [(1, 1.0), (3, 0.7071)]


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Map(dict):
    calls = 0

    def exists(self):
        return bool(self)

    def iterator(self):
        return iter(list(self.items()))

    containsKey, getValue = dict.__contains__, dict.__getitem__

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_open_ranges_cost_few_state_calls():
    import numpy as np
    import pandas as pd

    from cellsift.streaming import logs as st

    step, seqs, left = st._Missing(None), np.random.default_rng(0).permutation(np.arange(1, 30_001)), 0
    step._top, step._open = _Value(), _Map()
    seen = set()
    for part in np.split(seqs[:29_000], [7_000, 16_000, 23_000]):
        for events in step.handleInputRows(("r",), iter([pd.DataFrame({"seq": part})]), None):
            left += int(((events["last"] - events["first"] + 1) * np.where(events["event"] == "missing", 1, -1)).sum())
        seen |= set(part.tolist())
        assert left == max(seen) - len(seen)
    assert step._open.calls < 20
