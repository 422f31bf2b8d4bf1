"""Registered queries against their SQL: a cross-section by default, everything with ORACLE=all."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = ["describe", "histogram", "select_variable_genes", "gene_cluster_stats", "filter_markers", "rank_candidates", "match_names", "evaluate_run",
        "weighted_f1", "threshold_search", "validate_log", "improvement_rate", "set_pairs", "contingency_chi2", "knn_join", "silhouette",
        "adjacent_agreement", "bm25_topk", "parse_homology_json"]
NAMES = [n for n in entry.queries() if n in entry.oracle_sql()] if os.environ.get("ORACLE") == "all" else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) == ""


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bootstrap_mean_is_near_the_plain_score(spark):
    boot = {(r["run"], r["metric"]): r for r in entry.queries()["cluster_bootstrap"](spark, "/root/testdata/sf0.01").collect()}
    plain = {r["run"]: r["accuracy"] for r in entry.queries()["evaluate_run"](spark, "/root/testdata/sf0.01").collect()}
    for run, acc in plain.items():
        row = boot[(run, "strict")]
        assert abs(row["mean"] - acc) < 0.03 and row["ci_low"] <= acc <= row["ci_high"]
