import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellsift.operators import ann, blocks
from cellsift.operators import bootstrap as bs
from cellsift.operators import embedding as em
from cellsift.operators import hot
from cellsift.operators import neighbors as nb
from cellsift.operators import refine as rf
from cellsift.operators.components import principal_components
from cellsift.plans import catalog


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.5, (60, 4)) for c in (0, 3, 8)])
    x[100:120] = x[100]  # copies
    return x


@pytest.fixture(scope="module")
def points(spark, cloud):
    return spark.createDataFrame([(i, [float(v) for v in r], str(i // 60)) for i, r in enumerate(cloud)], "id bigint, x array<double>, cluster string")


@pytest.mark.parametrize("pivots, block", [(1, 4096), (6, 16)])
def test_knn_equals_brute_force(points, cloud, pivots, block):
    got = nb.knn_join(points, 5, pivots=pivots, block=block).toPandas()
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, :5]
    for i, part in got.groupby("id"):
        assert np.sort(part["dist"]) == pytest.approx(want[i], abs=1e-9)
        assert part["nbr"].is_unique and i not in set(part["nbr"])


def test_modularity_and_components_of_two_triangles(spark):
    one = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in one] + [(b, a, 1.0) for a, b in one], "src int, dst int, weight double")
    lab = spark.createDataFrame([(i, str(i // 3)) for i in range(7)], "id int, cluster string")
    assert nb.modularity(e, lab).first()[0] == pytest.approx(5 / 14)
    comp = {r["id"]: r["component"] for r in nb.connected_components(e, lab).collect()}
    assert comp == {**{i: 0 for i in range(6)}, 6: 6}
    assert nb.clustering_coefficient(e, lab.where("id < 6")).first()[0] == pytest.approx((4 * 1 + 2 / 3) / 6)
    const = lab.where("id < 6").withColumn("value", F.lit(1.0))
    assert nb.autocorrelation(e, const).first()["morans_i"] is None
    long = [(i, i + 1) for i in range(40)]
    chain = spark.createDataFrame([(a, b) for a, b in long] + [(b, a) for a, b in long], "src int, dst int")
    assert nb.connected_components(chain, spark.range(41).select(F.col("id").cast("int").alias("id"))).select("component").distinct().count() == 1


def test_agreement_of_identical_labels(spark):
    rows = [(i, r, str(i % 3)) for i in range(30) for r in ("1", "2")]
    lab = spark.createDataFrame(rows, "id int, resolution string, cluster string")
    got = em.adjacent_agreement(lab, ["1", "2"]).first()
    assert got["ari"] == pytest.approx(1) and got["nmi"] == pytest.approx(1)
    assert all(r["stable"] for r in em.persistence(lab, "1").collect())
    with pytest.raises(ValueError):
        em.choose_resolution(lab, None)
    with pytest.raises(ValueError):
        em.choose_resolution(lab, "7")


def test_silhouette_sample_and_singletons(spark, points, cloud):
    assert em.silhouette(points, max_n=50).count() == 50
    lab = np.repeat([0, 1, 2], 60)
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(-1))
    i = 70
    a = d[i][lab == 1].sum() / 59
    b = min(d[i][lab == 0].mean(), d[i][lab == 2].mean())
    got = em.silhouette(points, block=32).where("id = 70").first()
    assert (got["a"], got["b"], got["silhouette"]) == (pytest.approx(a), pytest.approx(b), pytest.approx((b - a) / max(a, b)))
    tiny = spark.createDataFrame([(0, [0.0], "x"), (1, [1.0], "y"), (2, [1.5], "y")], "id int, x array<double>, cluster string")
    assert em.silhouette(tiny).where("id = 0").first()["silhouette"] == 0


def test_pca_finds_the_main_direction(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=300)
    x = np.abs(np.column_stack([t + 5, t + 5 + rng.normal(0, 0.1, 300), rng.normal(3, 0.2, 300)]))
    i, j = np.indices(x.shape)
    df = spark.createDataFrame(pd.DataFrame({"cell_id": i.ravel(), "gene_id": [f"g{v}" for v in j.ravel()], "norm": x.ravel()}))
    found = principal_components(em.sparse_scaled(df, 300), 3)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert [r["ratio"] for r in found.ratios().orderBy("pc").collect()] == pytest.approx(want / want.sum(), rel=1e-6)
    assert found.scores.count() == 300 and {r["gene_id"] for r in found.top_loadings().where("pc = 1 AND rank <= 2").collect()} == {"g0", "g1"}
    ratios = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.15), (4, 0.05)], "pc int, ratio double")
    assert tuple(em.variance_summary(ratios).first()) == (1, 2, 3, 2)


def test_subclusters_split_the_obvious(points):
    lab = points.select("id", F.lit("p").alias("cluster"))
    subs = rf.subcluster(points, lab, lab, k=2, min_cells=50, rounds=8)
    sizes = sorted(r["count"] for r in subs.groupBy("sub").count().collect())
    assert sum(sizes) == 180 and len(sizes) == 2
    out = rf.subcluster_outcomes(lab, lab, subs, 50).first()
    assert out["outcome"] == "analyzed" and sum(out["sub_sizes"]) == 180
    assert rf.subcluster_outcomes(lab, lab, subs, 500).first()["reason"] == "n_cells_below_min"


def test_subcluster_delivery(spark):
    subs = spark.createDataFrame([("p", "c0", "0"), ("p", "c1", "1"), ("p", "c2", "0")], "parent string, id string, sub string")
    first = spark.createDataFrame([("p", "0", "columella root cap cell"), ("p", "1", None)], "parent string, cluster string, first_type string")
    _, names = rf.subcluster_delivery(subs, first)
    assert {r["subcluster"]: r["label"] for r in names.collect()} == {"0": "columella root cap cell", "1": "unknown"}


def test_doublets_score_higher(spark):
    rng = np.random.default_rng(1)
    base = np.zeros((120, 20))
    base[:60, :10] = rng.poisson(6, (60, 10))
    base[60:, 10:] = rng.poisson(6, (60, 10))
    mixed = base[:10] + base[60:70]
    x = np.vstack([base, mixed])
    i, j = np.nonzero(x)
    df = spark.createDataFrame(pd.DataFrame({"cell_id": [f"c{v:03d}" for v in i], "gene_id": [f"g{v}" for v in j], "count": x[i, j]}))
    got = rf.doublet_scores(df, k=10, pcs=3).where("NOT simulated").toPandas().set_index("id")["score"]
    assert got[[f"c{v}" for v in range(120, 130)]].mean() > 2 * got[[f"c{v:03d}" for v in range(120)]].mean()


def test_bootstrap_draws_and_verdict(spark):
    rows = [("a", str(c), "x", "t", 10, 1.0, 1.0, None) for c in range(8)] + [("b", str(c), "x", "t", 10, 0.0, 0.0, None) for c in range(8)]
    sc = spark.createDataFrame(rows, "run string, cluster string, raw string, true string, n int, accuracy_weight double, hierarchy_weight double, mapped_true string")
    d = bs.draws(sc, 50, 1)
    assert all(r["s"] == 8 for r in d.groupBy("run", "draw").agg(F.sum("copies").alias("s")).collect())
    assert d.exceptAll(bs.draws(sc, 50, 1)).count() == 0
    boots = bs.boot_metrics(sc, 50, 1)
    assert {r["verdict"] for r in bs.bootstrap_deltas(boots, 50).collect()} == {"R4"}
    assert bs.cluster_bootstrap(boots, 50).where("run = 'a' AND metric = 'strict'").first()["ci_low"] == 1.0


def test_components_of_all_lines(spark, tmp_path):
    """Parts 5 and 1002, suppliers 1 and 280, part 3 and supplier 3 stay apart; no line has the quantity and discount of a subset."""
    pairs = [(5, 1), (6, 1), (1002, 2), (7, 2), (3, 4), (8, 3), (9, 280), (9, 41), (10, 41), (10, 41), (11, 12)]
    rows = [(p, s, 1.0, 0.0) for p, s in pairs]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["id"]: r["component"] for r in catalog.QUERIES["connected_components"](spark, str(tmp_path)).collect()}
    want = {x: x for p, s in pairs for x in (f"p{p}", f"s{s}")}
    for _ in want:
        for p, s in pairs:
            want[f"p{p}"] = want[f"s{s}"] = min(want[f"p{p}"], want[f"s{s}"])
    assert got == want and len(set(got.values())) == 6


def test_components_with_hubs(spark, monkeypatch):
    """A hub of many leaves, chains that hang on it, and small parts apart."""
    monkeypatch.setattr(hot, "LEAST", 8)
    rng = np.random.default_rng(3)
    pairs = [(5_000, i) for i in range(3_000)] + [(i, i + 1) for i in range(6_000, 6_200)] + [(6_000, 17)] + [
        tuple(map(int, p)) for p in rng.integers(10_000, 12_000, (1_200, 2))]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    edges = spark.createDataFrame(pairs, "src int, dst int").repartition(7)
    nodes = spark.createDataFrame([(x,) for x in [*parent, -1]], "id int")
    got = {r["id"]: r["component"] for r in nb.connected_components(edges, nodes).collect()}
    low = {}
    for x in parent:
        low[root(x)] = min(x, low.get(root(x), x))
    assert got == {**{x: low[root(x)] for x in parent}, -1: -1}


@pytest.mark.parametrize("least", [64, 4])
def test_components_of_many_links(spark, monkeypatch, least):
    """Dense groups, joined by few links: the stars get two links a node at most, and every other link still counts."""
    monkeypatch.setattr(hot, "LEAST", least)
    rng, sizes, stars = np.random.default_rng(5), [], nb._stars
    monkeypatch.setattr(nb, "_stars", lambda links: sizes.append(links.count()) or stars(links))
    groups = [[f"{kind}{g}_{i}" for kind in "ps" for i in range(30)] for g in range(8)]
    pairs = [(str(a), str(b)) for g in groups for a, b in zip(rng.choice(g[:30], 700), rng.choice(g[30:], 700))]
    pairs += [("p0_7", "s1_9"), ("s1_5", "s2_5"), ("p2_20", "p3_20"), ("p5_3", "s6_3")]
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(5)
    ids = sorted({x for p in pairs for x in p} | {"z"})
    got = {r["id"]: r["component"] for r in nb.connected_components(edges, spark.createDataFrame([(x,) for x in ids], "id string")).collect()}
    team = {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    want = {x: min(y for y in ids if y != "z" and team[int(y[1])] == team[int(x[1])]) for x in ids if x != "z"}
    assert got == {**want, "z": "z"} and max(sizes) <= 2 * len(ids)


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST", 5)
    rows = [(1, i) for i in range(40)] + [(2, 0), (None, 1), (None, 2), (3, 3)] + [(None, i) for i in range(10, 30)] + [(9, i) for i in range(50)]
    left, right = spark.createDataFrame(rows, "k int, v int"), spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (4, "d")], "k int, w string")
    table = {1: "a", 2: "b", None: "n"}
    got = sorted(map(tuple, hot.hot_join(left, right, ["k"]).collect()), key=repr)
    assert got == sorted([(k, v, table.get(k)) for k, v in rows], key=repr)
    got = sorted(map(tuple, hot.hot_join(left, right, ["k"], "inner").collect()), key=repr)
    assert got == sorted([(k, v, table[k]) for k, v in rows if k in table], key=repr)
    plan = hot.hot_join(left, right, ["k"])._jdf.queryExecution().toString()
    assert "Cartesian" not in plan


@pytest.mark.parametrize("fitted,leaf", [(16_384, 64), (64, 40)])
def test_approximate_neighbors(spark, monkeypatch, fitted, leaf):
    """Recall against all distances, also where leaves must be cut further; copies, nulls."""
    monkeypatch.setattr(ann, "FITTED", fitted)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 1.0, (300, 8)) for c in (0, 4, 9)])
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 8), (9_999, None)]
    got = ann.knn_approx(spark.createDataFrame(rows, "id long, x array<double>"), 5, leaf=leaf).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got.dist, d[got.id, got.nbr], atol=1e-9) and (got.groupby("id").size() == 5).all()
    # By distance, since copies tie.
    kth = np.sort(d, axis=1)[:, 4]
    assert (got.dist <= kth[got.id] + 1e-9).mean() > 0.9 and got.id.nunique() == 900


def test_approximate_neighbors_without_structure(spark):
    """Random directions: no small share of the rows holds the neighbours, and recall is reached all the same."""
    x = np.random.default_rng(2).normal(size=(6_000, 48))
    got = ann.knn_approx(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>"), 10, leaf=16).toPandas()
    d = np.sqrt(np.maximum(blocks.squares(x, x), 0))
    np.fill_diagonal(d, np.inf)
    kth = np.partition(d, 9, axis=1)[:, 9]
    assert len(got) == 60_000 and (got.dist <= kth[got.id] + 1e-9).mean() > 0.9
    assert (got.sort_values(["id", "dist"])["rank"].to_numpy().reshape(-1, 10) == np.arange(1, 11)).all()


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-3, 1e4), (1e15, 0.0), (1e25, 0.0)])
def test_short_numbers_lose_no_pair(scale, shift):
    rng = np.random.default_rng(6)
    a, b = (rng.normal(size=(n, 5)) * scale + shift for n in (64, 200))
    b[:8] = a[:8]
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    far = np.sort(d, axis=1)[:, 6]
    far[:8], far[8:16] = 0.0, np.inf
    i, j = blocks.Side(b, np.arange(200)).near(a, far)
    found = set(zip(i.tolist(), j.tolist()))
    assert found >= set(zip(*map(np.ndarray.tolist, np.nonzero(d <= far[:, None])))) and len(found) <= 2 * (8 * 200 + 56 * 8)


def test_blocks_send_only_neighbors_back(spark):
    """What a row finds is merged by block: one row a neighbour, not one a neighbour and tile."""
    x = np.random.default_rng(8).normal(size=(700, 12))
    points = spark.createDataFrame([(f"r{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, x array<double>").localCheckpoint()
    got = blocks.nearest(points, 4, block=20).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(got) == 2_800
    assert {(r.id, r.rank): r.nbr for r in got.itertuples()} == {(f"r{i:03d}", n + 1): f"r{j:03d}" for i in range(700) for n, j in enumerate(np.argsort(d[i])[:4])}


def test_approximate_neighbors_of_few(spark):
    none = spark.createDataFrame([], "id long, x array<double>")
    assert ann.knn_approx(none).collect() == []
    two = spark.createDataFrame([("a", [0.0]), ("b", [3.0])], "id string, x array<double>")
    assert sorted(map(tuple, ann.knn_approx(two, 4).collect())) == [("a", "b", 3.0, 1), ("b", "a", 3.0, 1)]


def sparse_rows(seed, cells, features, per_cell, groups):
    """A matrix whose cells favour the features of their group; feature 0 is in every cell."""
    rng, rows = np.random.default_rng(seed), {}
    for c in range(cells):
        rows[c, 0] = rng.normal(2, 1)
        for f in rng.integers(1, features, per_cell):
            rows[c, int(f)] = rng.normal(0, 0.3)
        for f in range(1 + 10 * (c % groups), 11 + 10 * (c % groups)):
            rows[c, f] = rng.normal(4.0 + c % groups, 0.5)
    return [(c, f"f{f}", float(v)) for (c, f), v in rows.items()]


def test_components_equal_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST", 50)
    rows = sparse_rows(2, 250, 400, 12, 4)
    found = principal_components(spark.createDataFrame(rows, "c int, f string, v double").repartition(6), 4, "c", "f", "v")
    a = np.zeros((250, 400))
    for c, f, v in rows:
        a[c, int(f[1:])] = v
    values, vectors = np.linalg.eigh(np.cov(a.T))
    assert found.variances[:3] == pytest.approx(values[::-1][:3], rel=1e-4) and found.total_variance == pytest.approx(values.sum())
    w = np.zeros((400, 4))
    for r in found.loadings.collect():
        w[int(r["f"][1:])] = r["w"]
    assert np.allclose(np.abs((w[:, :3] * vectors[:, ::-1][:, :3]).sum(0)), 1, atol=1e-3)
    assert (w[np.abs(w).argmax(0), np.arange(4)] > 0).all()
    x = {r["id"]: r["x"] for r in found.scores.collect()}
    assert np.allclose([x[c] for c in range(250)], a @ w, atol=1e-8)


def test_components_of_many_features(spark):
    """200,000 features: loadings orthonormal, scores with the stated variances, no feature list."""
    rows = sparse_rows(3, 1_500, 200_000, 140, 5)
    assert len({f for _, f, _ in rows}) > 120_000
    found = principal_components(spark.createDataFrame(pd.DataFrame(rows, columns=["c", "f", "v"])), 4, "c", "f", "v", rounds=2)
    w = np.array([r["w"] for r in found.loadings.select("w").collect()])
    assert np.allclose(w.T @ w, np.eye(4), atol=1e-8)
    x = np.array([r["x"] for r in found.scores.select("x").collect()])
    assert np.allclose(np.cov(x.T), np.diag(found.variances), rtol=1e-4, atol=1e-4 * found.variances[0])
    top = {r["f"] for r in found.loadings.select("f", F.abs(F.get("w", F.lit(0))).alias("a")).orderBy(F.desc("a")).limit(5).collect()}
    assert top <= {f"f{i}" for i in range(1, 51)}


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "cell_id int, gene_id string, scaled_raw double")
    found = principal_components(none)
    assert found.variances == [] and found.scores.collect() == [] and found.loadings.collect() == []
    one = principal_components(spark.createDataFrame([(1, "a", 2.0), (1, None, 1.0), (None, "a", 1.0), (2, "a", None)], none.schema))
    assert one.variances == [] and [tuple(r) for r in one.scores.collect()] == [(1, [])]
    same = principal_components(spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0)], none.schema))
    assert same.variances == pytest.approx([2.0]) and sorted(r["x"][0] for r in same.scores.collect()) == pytest.approx([2.0, 4.0])


@pytest.mark.parametrize("block", [16, 4096])
def test_ties_of_copies_go_to_the_smaller_id(spark, block):
    rng = np.random.default_rng(3)
    x = np.vstack([np.ones((300, 3)), rng.normal(0, 1e-4, (60, 3)) + 4, rng.normal(0, 3, (140, 3))])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(f"r{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, x array<double>")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 12)
    np.fill_diagonal(d, np.inf)
    want = {(f"r{i:03d}", n + 1): f"r{j:03d}" for i in range(len(x)) for n, j in enumerate(np.argsort(d[i], kind="stable")[:7])}
    got = nb.knn_join(df, 7, block=block).collect()
    assert {(r["id"], r["rank"]): r["nbr"] for r in got} == want
    assert max(abs(r["dist"] - d[int(r["id"][1:]), int(r["nbr"][1:])]) for r in got) < 1e-9
    assert nb.knn_join(df.limit(0), 7).count() == 0


def test_trustworthiness_ranks_ties_by_id(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    x[20:70] = x[20]  # equally far from everything
    y = rng.normal(size=(150, 2))
    df = spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))], "id int, x array<double>, y array<double>")

    def ranks(p):
        d = np.round(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)), 12)
        np.fill_diagonal(d, np.inf)
        return np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) + 1

    high, low = ranks(x), ranks(y)
    np.fill_diagonal(low, 150)
    k, n = 5, 150.0
    want = 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(high - k, 0)[low <= k].sum()
    assert em.trustworthiness(df, k).first()[0] == pytest.approx(want, abs=1e-12)


def test_doublets_read_the_matrix_once(spark):
    """Every row of the matrix is computed once, and cells keep their names whatever these are."""
    rng = np.random.default_rng(3)
    x = rng.poisson(2, (90, 12))
    i, j = np.nonzero(x)
    reads = spark.sparkContext.accumulator(0)

    def seen(v):
        reads.add(1)
        return v

    df = spark.createDataFrame(pd.DataFrame({"cell_id": [f"sim{v}" for v in i], "gene_id": [f"g{v}" for v in j], "count": x[i, j].astype(float)}))
    got = rf.doublet_scores(df.withColumn("count", F.udf(seen, "double").asNondeterministic()("count")), ratio=0.5, k=6, pcs=3).toPandas()
    assert sorted(got[~got["simulated"]]["id"]) == sorted({f"sim{v}" for v in i}) and got["simulated"].sum() == 45
    assert reads.value == len(i)


def test_nearest_in_wide_tiles(spark):
    """Tiles of up to 62 blocks: a row of 880 blocks travels 15 times, not 55, and finds what brute force finds."""
    assert blocks.tile(880, 2048, 10, 1_800_000, blocks.MASK) == 62
    x = np.random.default_rng(5).random((1500, 2))
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(1500), "x": x.tolist()})).localCheckpoint()
    got = blocks.nearest(points, 4, block=20).toPandas().sort_values(["id", "rank"])
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 12)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (got["nbr"].to_numpy().reshape(1500, 4) == want).all()


def test_distinct_pairs_stay(spark):
    """Rows said to be distinct give the same components, and their sums by cell leave a task once a cell."""
    rows = [(c, f"f{f}", float((c * 7 + f * 3) % 11 + 1)) for c in range(60) for f in range(9)]
    df = spark.createDataFrame(rows, "c int, f string, v double").repartition(4, "c")
    one = principal_components(df, 3, "c", "f", "v")
    two = principal_components(df, 3, "c", "f", "v", distinct=True)
    assert np.allclose(one.variances, two.variances)
    a, b = (np.array([r["x"] for r in got.scores.orderBy("id").collect()]) for got in (one, two))
    assert np.allclose(a, b)
