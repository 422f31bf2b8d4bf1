import pytest
from pyspark.sql import functions as F

from cellsift.functions import scalars as sc
from cellsift.operators import candidates as cd
from cellsift.operators import evaluate as ev
from cellsift.operators import knowledge as kg
from cellsift.operators import mapping as mp
from cellsift.operators import overlap as ov
from cellsift.plans import catalog
from cellsift.plans.inputs import kg_rows
from cellsift.plans.registry import Tables

HIT = "gene string, cell_type string, organ string, confidence double, source string, source_path string, ortholog_ref_species string"


@pytest.mark.parametrize("organs, want", [
    (["Root"], "root"), (["Stem|Root|Leaf"], "root"), (["Root|Root Tip"], "root"), (["Unknown", "Root"], "root"),
    (["Root", "Stem"], "partial"), (["Root", "Stem|Rootstock"], "partial"), (["Liver|Heart"], "mismatch"), (["Root Tip"], "mismatch"),
    (["Unknown", "Liver"], "mismatch"), ([], "unknown"), (["Unknown"], "unknown"), ([None, "", "   "], "unknown"),
])
def test_organ_status(spark, organs, want):
    df = spark.createDataFrame([(organs,)], "o array<string>")
    assert df.select(sc.organ_status("o", "root")).first()[0] == want


def test_organ_status_reads_all_rows_of_a_gene(spark):
    folder, seen = "/root/testdata/sf0.001", {}
    for r in kg_rows(Tables(spark, folder)).select("gene", "organ").collect():
        tokens = {x.strip().lower() for x in (r["organ"] or "").split("|")} - {"", "unknown"}
        seen.setdefault(r["gene"], set()).update({"asia" in tokens} if tokens else ())
    want = {g: "partial" if len(s) > 1 else "unknown" if not s else "root" if True in s else "mismatch" for g, s in seen.items()}
    assert {r["gene"]: r["status"] for r in catalog.QUERIES["organ_status"](spark, folder).collect()} == want

def test_organ_status_needs_a_target():
    with pytest.raises(ValueError):
        sc.organ_status("o", " ")


def test_path_stats_and_candidates(spark):
    hits = spark.createDataFrame([
        ("g1", "t", "Root", 0.9, "s", "direct", None), ("g1", "t", "Root", 0.7, None, "ortholog", "zea_mays"),
        ("g2", "t", "Root", 0.5, "s", "ortholog", "zea_mays"), ("g3", "u", "Leaf", 1.0, "s", "direct", None)], HIT)
    row = cd.path_hit_stats(hits).first()
    assert tuple(row) == (2, 2, 1, 1)
    genes = spark.createDataFrame([("0", "g1", 1), ("0", "g2", 2), ("0", "g3", 3), ("0", "g4", 4)], "cluster string, gene string, position int")
    got = {r["cell_type"]: r for r in cd.rank_candidates(genes, hits, "root").collect()}
    t = got["t"]
    assert (t["rank"], t["marker_count"], t["supporting_markers"], t["sources"]) == (1, 2, ["g1", "g2"], ["?", "s"])
    assert t["mean_confidence"] == pytest.approx(0.7) and t["source_paths"] == ["direct", "ortholog"] and t["source_species"] == ["zea_mays"]
    assert got["u"]["organ_status"] == "mismatch"
    assert {r["organ_status"] for r in cd.rank_candidates(genes, hits, None).collect()} == {"unknown"}
    assert "source_paths" not in cd.rank_candidates(genes, hits.drop("source_path"), "root").columns
    assert tuple(cd.cluster_hits(genes, hits).first())[1:] == (4, 3, 2, 2, 1)


def test_gap_metrics(spark):
    cand = spark.createDataFrame([("0", "root", 8, 0.9, 1), ("0", "leaf", 2, 0.4, 2)], "cluster string, cell_type string, marker_count int, mean_confidence double, rank int")
    anc = spark.createDataFrame([("leaf", "plant")], "name string, ancestor string")
    clusters = spark.createDataFrame([("0",), ("1",)], "cluster string")
    got = {r["cluster"]: r for r in cd.gap_metrics(cand, clusters, anc).collect()}
    a = got["0"]
    assert (a["count_ratio"], a["count_diff"], a["n_tied_at_first"], a["frac_support_first"], a["related"], a["n_shared_ancestors"]) == (4.0, 6, 1, 0.8, False, 0)
    assert got["1"]["status"] == "no_candidates" and got["1"]["first_count"] == 0
    up = spark.createDataFrame([("leaf", "root")], "name string, ancestor string")
    r = cd.gap_metrics(cand, clusters, up).where("cluster = '0'").first()
    assert r["related"] and r["first_is_ancestor"]


def test_match_names_limit_and_order(spark):
    labels = spark.createDataFrame([("Root Hair",), ("none",)], "label string")
    names = spark.createDataFrame([(n,) for n in ["root hair", "long root hair cell", "xroot hairx", "root"]], "name string")
    got = [(r["name"], r["match"]) for r in kg.match_names(labels, names, 2).orderBy("position").collect()]
    assert got == [("root hair", "casefold"), ("long root hair cell", "contains")]


def test_coverage_bounds(spark):
    df = spark.createDataFrame([(500,), (499,), (50,), (49,)], "n_genes_with_type int")
    got = [(r["tier"], r["strategy"]) for r in kg.coverage_tier(df).collect()]
    assert got == [("high", "single_species"), ("medium", "mixed"), ("medium", "mixed"), ("low", "cross_species_only")]


def test_match_names_without_limit_gives_all(spark):
    labels = spark.createDataFrame([("cell",), ("none",)], "label string")
    names = spark.createDataFrame([(f"cell {i:03d}",) for i in range(300)] + [("Cell",)], "name string")
    got = kg.match_names(labels, names).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 302))
    assert [r["name"] for r in got] == ["Cell"] + [f"cell {i:03d}" for i in range(300)]


def test_routing(spark):
    rows = [("t", "Plant", "single_species", None), ("t", "Plant", "cross_species_only", ["zea_mays", "oryza_sativa"]), ("t", "Plant", "cross_species_only", []), (None, None, None, None)]
    got = mp.routing(spark.createDataFrame(rows, "target_species string, target_species_type string, recommended_strategy string, refs array<string>")).collect()
    assert [r["map_needed"] for r in got] == [False, True, True, False]
    assert got[1]["references"] == ["zea_mays", "oryza_sativa"] and got[2]["references"] == ["zea_mays", "oryza_sativa", "arabidopsis_thaliana"]


def test_mapping(spark):
    rec = spark.createDataFrame([("g", "oryza_sativa", "Os1", 90.0), ("g", "zea_mays", "Zm1", 40.0), ("g", "zea_mays", "Zm2", 35.0), ("g", "x", "low", 10.0)], "gene string, ref_species string, ref_gene string, score double")
    assert [r["ref_gene"] for r in mp.collapse_best(rec).orderBy("position").collect()] == ["Os1", "Zm1"]
    assert mp.limit_references(["a", "b", "c", "d"]) == (["a", "b", "c"], ["more than 3 reference species, kept ['a', 'b', 'c']"])
    one = spark.createDataFrame([("a",), ("b",)], "gene_id string")
    two = spark.createDataFrame([("b",), ("a",), ("a",)], "gene_id string")
    key = lambda d, refs: mp.reuse_key(d, "t", refs, "s").first()[0]
    assert key(one, ["x", "y"]) == key(two, ["y", "x"]) != key(one.limit(1), ["x", "y"])
    with pytest.raises(KeyError):
        mp.map_genes("nowhere", rec)


def test_species_names(spark):
    df = spark.createDataFrame([("homo_sapiens", "Animal"), ("zea_mays", "Plant"), ("populus_alba_var_pyramidalis", "Plant"), ("new_thing", "Plant")], "id string, kind string")
    got = [(r[0], r[1]) for r in df.select(kg.normalize_species("id", F.col("kind")), kg.blast_prefix("id")).collect()]
    assert got == [("Human", "Homo_sapiens"), ("zea_mays", "Zea_mays"), ("populus_alba_var_pyramidalis", "Populus_alba_var_pyramidalis"), ("new_thing", "New_Thing")]
    assert kg.flatten_species(["a,b", "b;c"]) == ["a", "b", "c"]


PINS = [("Root hair", "trichoblast"), ("Root epidermis", "root epidermis"), ("Root stele", "root stele"), ("Root cortex", "root cortex"), ("Empty", None)]
ALIASES = [("trichoblast", "trichoblast"), ("root hair", "trichoblast"), ("root hair cell", "trichoblast"), ("root stele", "root stele"), ("root procambium", "root procambium")]


@pytest.mark.parametrize("pred, true, want, flat", [
    ("trichoblast", "Root hair", "synonym", "synonym"), ("trichoblast", "Root epidermis", "subtype", "unrelated"),
    ("root epidermis", "Root hair", "supertype", "unrelated"), ("trichoblast", "Root cortex", "unrelated", "unrelated"),
    ("root stele", "Root stele", "synonym", "synonym"), ("root meristem", "Root cortex", "unmatched", "unmatched"), ("unknown", "Root cortex", "unmatched", "unmatched"),
    ("root stele", "Unknown", "unmatched", "unmatched"), ("root procambium", "Root cortex", "unrelated", "unrelated"), ("TRICHOBLAST", "Root hair", "synonym", "synonym"),
    ("root stele", "Empty", "unmatched", "unmatched"),
])
def test_label_relation(spark, pred, true, want, flat):
    pairs = spark.createDataFrame([(pred, true)], "raw string, true string")
    pins = spark.createDataFrame(PINS, "label string, node string")
    aliases = spark.createDataFrame(ALIASES, "alias string, node string")
    nodes = spark.createDataFrame([(n,) for n in ["trichoblast", "root epidermis", "root stele", "root cortex", "root procambium"]], "name string")
    anc = kg.ancestors(nodes, spark.createDataFrame([("trichoblast", "root epidermis")], "child string, parent string"))
    assert ev.label_relation(pairs, pins, aliases, nodes, anc).first()["relation"] == want
    assert ev.label_relation(pairs, pins, aliases).first()["relation"] == flat


def test_cell_evaluation(spark):
    pins = spark.createDataFrame([("Lateral Root Cap", "lateral root cap"), ("Root stele", "root stele"), ("Root cortex", "root cortex")], "label string, node string")
    aliases = spark.createDataFrame([], "alias string, node string")
    nodes = pins.select(F.col("node").alias("name"))

    def run(obs, truth, ann):
        cells = ev.join_evaluation(spark.createDataFrame(truth, "cell_id string, true_type string"), spark.createDataFrame(obs, "cell_id string, cluster string"),
                                   spark.createDataFrame([("r", *a) for a in ann], "run string, cluster string, label string, confidence string, status string"))
        counts = ev.count_cells(cells)
        return cells, ev.evaluate_run(ev.tally(counts, ev.label_relation(counts, pins, aliases, nodes))).first()

    cap = "lateral root cap"
    cells, got = run([("a", "0"), ("b", "1"), ("c", "2")], [(k, "Lateral Root Cap") for k in "abc"],
                     [("0", cap, "low", "decisive"), ("1", "unknown", "low", "unknown"), ("2", cap, "high", "decisive")])
    assert (got["accuracy"], got["hierarchy_score"], got["low_conf_rate"], got["n_low"]) == (0.6667, 0.6667, 0.6667, 2)
    _, got = run([("a", "0"), ("b", "0")], [("a", "Root stele"), ("b", "Root cortex")], [("0", "root stele", "high", "decisive")])
    assert got["accuracy"] == 0.5
    cells, got = run([("a", "0"), ("b", "7")], [("a", "Root stele"), ("b", "Root cortex")], [("0", "root stele", "high", "decisive")])
    assert [tuple(r) for r in ev.unknown_clusters(cells).collect()] == [("r", "7")]
    sub = spark.createDataFrame([("r", "5", "0", cap, "analyzed"), ("r", "5", "1", "root stele", "analyzed")], "run string, cluster string, subcluster string, label string, outcome string")
    base = spark.createDataFrame([("r", "c0", "5", "x"), ("r", "c1", "5", "x"), ("r", "c2", "5", "x")], "run string, cell_id string, cluster string, raw string")
    own = spark.createDataFrame([("r", "c0", "0"), ("r", "c1", "1")], "run string, cell_id string, subcluster string")
    assert {r["cell_id"]: r["raw"] for r in ev.delivered_label(base, sub, own).collect()} == {"c0": cap, "c1": "root stele", "c2": "x"}


def test_draft_pins(spark):
    labels = spark.createDataFrame([("Root hair",), ("Unknown",), ("Root epidermis",), ("lost",)], "label string")
    hints = {"Root hair": "trichoblast", "Root epidermis": "root epidermis"}
    none = spark.createDataFrame([], "label string, name string, match string, position int")
    got = {r["label"]: r["node"] for r in ev.draft_pins(labels, none, hints).collect()}
    assert got == {"Root hair": "trichoblast", "Root epidermis": "root epidermis", "lost": None}
    same = spark.createDataFrame([("Root hair", "root hair", "casefold", 1)], "label string, name string, match string, position int")
    assert ev.draft_pins(labels, same, hints).where("label = 'Root hair'").first()["node"] == "root hair"


def test_overlap(spark):
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3), ("c", 9), ("d", None)], "cluster string, gene int")
    got = {(r["a"], r["b"]): (r["overlap"], r["jaccard"]) for r in ov.set_pairs(sets).collect()}
    assert got[("a", "b")] == (1.0, pytest.approx(2 / 3)) and got[("a", "c")] == (0.0, 0.0) and len(got) == 6
    assert {r["cluster"]: r["frac_unique"] for r in ov.unique_fraction(sets).collect()} == {"a": pytest.approx(1 / 3), "b": 0.0, "c": 1.0, "d": 1.0}
    one = ov.overlap_summary(sets.where("cluster = 'a'")).first()
    assert tuple(one) == (1, 0.0, 0.0, 0.0)
    m = {(r["a"], r["b"]): r["overlap"] for r in ov.overlap_matrix(sets).collect()}
    assert all(m[(a, b)] == m[(b, a)] for a, b in m) and m[("a", "a")] == 1.0


def test_chi2_two_by_two_uses_yates(spark):
    rows = [("x", "p")] * 12 + [("x", "q")] * 5 + [("y", "p")] * 3 + [("y", "q")] * 9
    got = ov.contingency_chi2(spark.createDataFrame(rows, "cluster string, batch string")).first()
    n, a, b, c, d = 29, 12, 5, 3, 9
    want = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert got["yates"] and got["chi2"] == pytest.approx(want) and 0 < got["p"] < 1
    one = ov.contingency_chi2(spark.createDataFrame([("x", "p")], "cluster string, batch string")).first()
    assert one["chi2"] is None and one["p"] is None


def test_match_names_equals_search(spark, monkeypatch):
    """Short and long labels, copies, other scripts, a run that most names hold; candidates stay near the matches."""
    import random

    from pyspark.sql import Observation

    from cellsift.operators import hot

    monkeypatch.setattr(hot, "LEAST", 10)
    rng = random.Random(2)
    some = lambda k: "".join(rng.choice("abAé日😀 .-") for _ in range(k))
    names = [some(rng.randint(0, 30)) for _ in range(300)] + ["root cap cell", "Root Cap", "cap"] + [f"common {i} end" for i in range(60)] + [None, ""]
    labels = [some(rng.randint(1, 4)) for _ in range(60)] + [" root CAP ", "cap", "mmo", "common", "c", "nowhere at all", "", None, "  "]
    seen = Observation("candidates")
    got = kg.match_names(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in names], "name string"), seen=seen).collect()
    want = {(a, b) for a in set(labels) if a and a.strip() for b in set(names) if b is not None and a.strip().lower() in b.lower()}
    assert {(r["label"], r["name"]) for r in got} == want and len(got) == len(want)
    assert len(want) <= seen.get["rows"] <= 3 * len(want)


def test_low_counts_equal_the_rule(spark):
    import random

    from cellsift.operators import thresholds as th

    rng = random.Random(6)
    rows = [(rng.choice([0.0, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9, rng.random()]), rng.choice([0.0, 1.0, 1.01, 1.1, 2.0, 3.0, 1 + rng.random()])) for _ in range(200)]
    grid = th.threshold_grid(spark)
    got = {r["grid_id"]: r["n_low"] for r in th.low_counts(spark.createDataFrame(rows, "max_top_pct2 double, count_ratio double"), grid).collect()}
    for r in grid.collect():
        assert got[r["grid_id"]] == sum(p > r["pct2_high"] or m < r["ratio_medium"] for p, m in rows)
    none = th.low_counts(spark.createDataFrame([], "max_top_pct2 double, count_ratio double"), grid)
    assert none.where("n_low = 0").count() == grid.count()
