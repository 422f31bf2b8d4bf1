import json
import os

import pytest
from pyspark.sql import functions as F

from cellsift.operators.markers import filter_markers
from cellsift.sources import readers as rd
from cellsift.sources import sinks as sk
from cellsift.streaming import logs as st


def test_jsonl_keeps_and_counts_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"seq": 1, "type": "exec"}\n\nnot json\n{"seq": 2}\n')
    rows = rd.read_jsonl(spark, str(tmp_path / "a.jsonl"), rd.LOG_SCHEMA).cache()
    assert tuple(rd.count_bad(rows).first()) == (2, 1)
    good, bad = rd.split_bad(rows)
    assert good.count() == 2 and bad.first()[0] == "not json"


def test_fasta_blast_homology(spark, tmp_path):
    (tmp_path / "q.fa").write_text(">lcl|AT1G01010 first\nMK\nLV\n>AT1G99999\nAA>A\n>lcl|AT1G01020\nCC\n")
    fasta = rd.read_fasta(spark, str(tmp_path / "q.fa"))
    assert [(r["header"], r["sequence"]) for r in fasta.orderBy("position").collect()] == [("lcl|AT1G01010 first", "MKLV"), ("AT1G99999", "AA>A"), ("lcl|AT1G01020", "CC")]
    var = spark.createDataFrame([("AT1G01010",), ("AT1G01020",)], "gene string")
    kept = rd.filter_fasta(fasta, var, var.limit(1))
    assert [r["gene"] for r in kept.collect()] == ["AT1G01010"]
    assert tuple(rd.fasta_metrics(fasta, var, var.where("gene = 'AT1G01010'")).first())[:3] == (3, 2, 1)
    rd.write_fasta(kept, str(tmp_path / "out"))
    assert rd.read_fasta(spark, str(tmp_path / "out")).first()["sequence"] == "MKLV"
    text = ["# c", "", "AT1G01010\tlcl|Os06g0650100 x\t85.5\t210\t1e-40", "b\tdbj|x\tn/a\t1\t1", "c\td\t50\t1\t1", "c\te\t40\t1\t1", "short\tx"]
    got = rd.parse_blast_tabular(spark.createDataFrame([(t,) for t in text], "value string"), "oryza_sativa").collect()
    assert {(r["gene"], r["ref_gene"], r["score"], r["mapping_type"]) for r in got} == {
        ("AT1G01010", "Os06g0650100", 85.5, "blastp_top_hit"), ("c", "d", 50.0, "blastp_multiple_hits"), ("c", "e", 40.0, "blastp_multiple_hits")}
    h = lambda t, p: {"type": t, "target": {"id": "Os1", "species": "oryza_sativa", **({"perc_id": p, "perc_pos": 95.0} if p else {})}}
    bodies = [json.dumps({"data": [{"homologies": [h("ortholog_one2one", 85.0)]}]}), json.dumps([{"homologies": [h("within_species_paralog", 9.0), h("ortholog_one2many", 70.0)]}]), json.dumps({"homologies": [h("ortholog_one2one", None)]})]
    got = rd.parse_homology_json(spark.createDataFrame([(f"g{i}", b) for i, b in enumerate(bodies)], "gene string, body string")).orderBy("gene").collect()
    assert [(r["gene"], r["score"], r["mapping_type"]) for r in got] == [("g0", 85.0, "ensembl_one2one"), ("g1", 70.0, "ensembl_one2many")]
    assert got[0]["raw"]["perc_pos"] == "95.0"


def test_json_documents(spark, tmp_path):
    def put(name, doc):
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
        return str(tmp_path / name)

    rec = [{"ref_species": "zea_mays", "ref_gene_id": "Zm1", "score": 80.0}]
    for key in ("cross_species_map", "ortholog_map"):
        pairs, refs, warn = rd.load_ortholog_map(spark, put(f"{key}.json", {key: {"g": rec}, "reference_species": ["zea_mays"]}))
        assert tuple(pairs.first())[:3] == ("g", "zea_mays", "Zm1") and refs == ["zea_mays"] and warn == []
    pairs, refs, warn = rd.load_ortholog_map(spark, str(tmp_path / "nothing.json"))
    assert pairs.count() == 0 and len(warn) == 1
    good = {"annotations": {"0": {"label": "a", "confidence": "high", "status": "decisive", "extra": {"x": 1}}}}
    assert rd.load_annotations(spark, put("f.json", good)).first()["label"] == "a"
    with pytest.raises(ValueError, match="judgement"):
        rd.load_annotations(spark, put("g.json", {"annotations": {"0": {"label": "a"}}}))
    assert [tuple(r) for r in rd.load_pins(spark, put("p.json", {"gt_ontology": {"A": " x ", "B": None, "C": ""}})).collect()] == [("A", "x")]
    assert rd.load_aliases(spark, put("a.json", {"aliases": {"A": "x"}})).count() == 1


def test_csv_inputs(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("cell,n,type\nc1,1,Root\n,2,Skip\nc2,3,Leaf\n")
    assert rd.read_ground_truth(spark, str(tmp_path / "gt.csv"), 2).count() == 2
    with pytest.raises(ValueError, match="expected 5"):
        rd.read_ground_truth(spark, str(tmp_path / "gt.csv"), 5)
    (tmp_path / "bad.csv").write_text("cell,n,type\nc1,1,\n")
    with pytest.raises(Exception, match="no cell type"):
        rd.read_ground_truth(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "obs.csv").write_text("cell_id,leiden\n c1 ,0\nc1,2\n,3\n")
    assert [tuple(r) for r in rd.read_keyed_csv(spark, str(tmp_path / "obs.csv"), "cell_id", ["leiden"]).collect()] == [("c1", "2")]
    with pytest.raises(ValueError, match="leiden2"):
        rd.read_keyed_csv(spark, str(tmp_path / "obs.csv"), "cell_id", ["leiden2"])


def test_sinks_round_trip(spark, tmp_path):
    de = spark.createDataFrame([("a", "g1", 1, 1.0, 0.1, 0.1, 0.9, 0.8, 0.1, 0.7), ("a", "g2", 2, 1.0, 0.1, 0.1, 0.9, 0.1, 0.1, 0.0)],
                               "cluster string, gene_id string, rank int, logfc double, pval double, pval_adj double, auc double, pct1 double, pct2 double, pct1_minus_pct2 double")
    sk.write_markers(str(tmp_path / "m"), filter_markers(de))
    assert spark.read.option("header", True).csv(str(tmp_path / "m/markers_csv")).columns == sk.MARKER_COLUMNS
    doc = spark.read.json(str(tmp_path / "m/markers_json")).first()
    assert doc["cluster"] == "a" and [m["gene_id"] for m in doc["markers"]] == ["g1"]
    expr = spark.createDataFrame([("c", "g", 1.0)], "cell_id string, gene_id string, count double")
    sk.write_prepared(str(tmp_path / "p"), expr.select("cell_id"), expr.select("gene_id"), expr)
    assert spark.read.parquet(str(tmp_path / "p/expr")).count() == 1
    conv = spark.createDataFrame([("assistant", None, None, [("1", "write_note", "{}")])], rd.CONVERSATION_SCHEMA)
    sk.write_conversation(str(tmp_path / "c"), conv)
    sk.write_conversation(str(tmp_path / "c"), conv, append=True)
    back = rd.read_conversation(spark, str(tmp_path / "c"))
    assert back.count() == 2 and back.first()["content"] == "" and back.first()["tool_calls"][0]["name"] == "write_note"


RECORDS = [("r", 1, "a.b#1", 5), ("r", 2, "a.b#2", 6), ("r", 5, "a.c#1", 7), ("s", 1, "a.b#1", 8), ("s", 3, "a.b#3", 9)]


def _write_log(folder):
    for n, (run, seq, rid, v) in enumerate(RECORDS):
        lines = [json.dumps({"run": run, "seq": seq, "type": "exec", "run_id": rid, "metrics": str(v)}),
                 json.dumps({"run": run, "type": "judgment", "decision_point": "kg_match", "inputs": [{"path": "p", "value": "1"}]})]
        (folder / f"{n}.json").write_text("\n".join(lines + (["broken"] if n == 0 else [])) + "\n")
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))


def _drain(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    _write_log(folder)
    tail = lambda: st.tail_log(spark, str(folder), files_per_batch=2)
    seen = {"good": 0, "bad": 0}
    q = st.split_batches(tail(), lambda d, n: seen.__setitem__("good", seen["good"] + d.count()), lambda d, n: seen.__setitem__("bad", seen["bad"] + d.count()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert seen == {"good": 10, "bad": 1}
    usage = _drain(spark, st.stream_usage(tail()), "usage", "complete", tmp_path)
    assert [tuple(r) for r in usage.collect()] == [("kg_match", "p", 5)]
    latest = _drain(spark, st.stream_latest(tail()), "latest", "complete", tmp_path)
    assert {(r["run"], r["key"]): (r["seq"], r["record"]["metrics"]) for r in latest.collect()} == {("r", "a.b"): (2, "6"), ("r", "a.c"): (5, "7"), ("s", "a.b"): (3, "9")}


def test_stream_gaps_keeps_state_between_batches(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    _write_log(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = _drain(spark, st.stream_gaps(st.tail_log(spark, str(folder), files_per_batch=2)), "gaps", "append", tmp_path)
        assert {tuple(r) for r in got.collect()} == {("r", 5, 3), ("s", 3, 2)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_log_lines_keep_their_place(spark, tmp_path):
    from cellsift.operators.runlog import validate_log

    folder = tmp_path / "r1"
    folder.mkdir()
    rows = [1, 3, 2, 2]
    text = "\n".join('{"type": "session_start", "ts": "t", "session_id": "s", "seq": %d}' % q for q in rows)
    (folder / "log.jsonl").write_text(text + "\nnot json\n")
    log = rd.read_log(spark, str(folder / "log.jsonl"))
    assert [(r["line"], r["seq"]) for r in log.orderBy("line").collect()] == [(1, 1), (2, 3), (3, 2), (4, 2)]
    assert [r["line"] for r in rd.bad_log_lines(spark, str(folder)).collect()] == [5]
    issues = validate_log(log).where("message = 'seq not consecutive'")
    assert sorted(r["line"] for r in issues.collect()) == [2, 3, 4]


def test_last_file_wins(spark, tmp_path):
    for name, n in (("a", 3), ("b", 400)):
        (tmp_path / f"{name}.csv").write_text("key,v\n" + "\n".join(f"k{i % 3},{name}{i}" for i in range(n)) + "\n")
    got = {r["key"]: r["v"] for r in rd.read_keyed_csv(spark, str(tmp_path), "key", ["v"]).collect()}
    assert got == {"k0": "b399", "k1": "b397", "k2": "b398"}


def test_gaps_of_a_large_shuffled_batch(spark, tmp_path):
    import random

    folder = tmp_path / "in" / "r1"
    folder.mkdir(parents=True)
    seqs = [s for s in range(1, 25_001) if s != 777]
    random.Random(0).shuffle(seqs)
    (folder / "log.jsonl").write_text("".join('{"seq": %d, "run": "r1"}\n' % s for s in seqs))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = _drain(spark, st.stream_gaps(st.tail_log(spark, str(folder))), "gaps2", "append", tmp_path)
    assert [tuple(r) for r in got.collect()] == [("r1", 778, 777)]


def test_markers_are_read_when_none_was_kept(spark, tmp_path):
    kind = "cluster string, gene_id string, logfc double, pval double, pval_adj double, auc double, pct1 double, pct2 double, pct1_minus_pct2 double, status string, marker_rank int"
    row = ("a", "g", 1.0, 0.5, 0.5, 0.5, 0.1, 0.1, 0.0, "dropped", None)
    sk.write_markers(str(tmp_path / "some"), spark.createDataFrame([row, (*row[:9], "kept", 1)], kind))
    sk.write_markers(str(tmp_path / "none"), spark.createDataFrame([row], kind))
    rows, nested = rd.read_markers(spark, str(tmp_path / "some"))
    assert rows.count() == 2 and nested.select("cluster", "markers.gene_id").first() == ("a", ["g"])
    rows, nested = rd.read_markers(spark, str(tmp_path / "none"))
    assert [(r["cluster"], r["status"]) for r in rows.collect()] == [("a", "dropped")] and nested.select("cluster", "markers.gene_id").count() == 0
