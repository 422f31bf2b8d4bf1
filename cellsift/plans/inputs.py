"""The generic inputs (matrix, cells, graph, log, ...) read off the driver's tables.

Each input is given twice: as a DataFrame function, and as the SQL of a common
table expression for the counterpart query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.operators.normalize import normalize_log
from cellsift.plans.registry import Tables

PATTERNS = {"mt": "Brand#1", "cp": "Brand#2"}


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# Matrix: customer x brand, quantity as the count.
EXPR = """expr AS (SELECT o_custkey AS cell_id, p_brand AS gene_id, sum(l_quantity) AS count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
FINE = EXPR.replace("expr AS", "fine AS", 1).replace("p_brand AS gene_id", "p_brand || '/' || p_type AS gene_id")
NORM = """norm AS (SELECT cell_id, gene_id, count, ln(1 + count / total * 1e4) AS norm
  FROM expr JOIN (SELECT cell_id, sum(count) AS total FROM expr GROUP BY 1) USING (cell_id))"""
CELLS = """cells AS (SELECT c_custkey AS cell_id, c_mktsegment AS cluster, 'b' || c_nationkey AS batch,
  'r' || n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
METRICS = """metrics AS (SELECT cell_id, count(*) AS n_genes, sum(count) AS total_counts,
  100 * sum(CASE WHEN gene_id LIKE 'Brand#1%' THEN count ELSE 0 END) / sum(count) AS pct_mt,
  100 * sum(CASE WHEN gene_id LIKE 'Brand#2%' THEN count ELSE 0 END) / sum(count) AS pct_cp
  FROM expr WHERE count > 0 GROUP BY 1)"""
LONG = """long AS (SELECT variable, value FROM (SELECT n_genes::DOUBLE AS n_genes, total_counts, pct_mt, pct_cp FROM metrics)
  UNPIVOT (value FOR variable IN (n_genes, total_counts, pct_mt, pct_cp)))"""


def matrix(t: Tables, fine: bool = False) -> DataFrame:
    gene = F.concat_ws("/", "p_brand", "p_type") if fine else F.col("p_brand")
    return (
        t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
        .join(t.part.select(F.col("p_partkey").alias("l_partkey"), gene.alias("gene_id")), "l_partkey")
        .join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cell_id")), "l_orderkey")
        .groupBy("cell_id", "gene_id")
        .agg(F.sum("l_quantity").alias("count"))
    )


def norm(t: Tables, fine: bool = False) -> DataFrame:
    return normalize_log(matrix(t, fine))


def cells(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cell_id"),
        F.col("c_mktsegment").alias("cluster"),
        F.concat(F.lit("b"), "c_nationkey").alias("batch"),
        F.concat(F.lit("r"), "n_regionkey").alias("region"),
    )


def metrics(t: Tables) -> DataFrame:
    from cellsift.operators.qc import qc_metrics

    return qc_metrics(matrix(t), PATTERNS)


def n_cells(t: Tables) -> int:
    return t.customer.count()


# Graph: a gene is a brand seen in a region (its species), a type is a nation.
# An edge exists where the brand's mean undiscounted share from that nation is high.
ROWS = """ge AS (SELECT DISTINCT p_brand || '@' || lower(r_name) AS gene_id, p_brand AS name, lower(r_name) AS species,
    CASE WHEN r_regionkey < 3 THEN 'Plant' ELSE 'Animal' END AS species_type, 'm' || right(p_brand, 1) AS marker_resource,
    'd' || r_regionkey AS dataset FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  ont AS (SELECT 'O:' || n_nationkey AS ontology_id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'Unknown'
      WHEN n_nationkey % 3 = 1 THEN r_name ELSE r_name || '|ASIA' END AS organ, 'Plant' AS species_type, 'cell' AS type
    FROM nation JOIN region ON n_regionkey = r_regionkey),
  mo AS (SELECT p_brand || '@' || lower(r_name) AS gene_id, 'O:' || n_nationkey AS ontology_id,
      CASE WHEN n_nationkey = 7 THEN NULL ELSE round(avg(1 - l_discount), 6) END AS relation_confidence,
      CASE WHEN right(p_brand, 1) = '1' THEN NULL ELSE 's' || right(p_brand, 1) END AS info_source
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY p_brand, r_name, n_nationkey HAVING round(avg(1 - l_discount), 6) >= 0.95),
  rel AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT r_name, 'WORLD' FROM region),
  rws AS (SELECT g.name AS gene, g.species, g.species_type AS gene_type, o.name AS cell_type, o.organ, o.ontology_id, o.species_type,
    o.type AS ontology_type, relation_confidence AS confidence, info_source AS source
    FROM mo JOIN ge g USING (gene_id) JOIN ont o USING (ontology_id))"""
# Brand#n has the ortholog Brand#(26 - n) in the species of region n mod 5.
ORTH = """orth AS (SELECT DISTINCT p_brand AS gene, lower(r_name) AS ref_species, 'Brand#' || (26 - substr(p_brand, 7)::INT) AS ref_gene
  FROM part JOIN region ON r_regionkey = substr(p_brand, 7)::INT % 5)"""
# Marker list of a cluster: its eight brands with most quantity.
CG = """cg AS (SELECT cluster, gene, position FROM (SELECT cluster, gene_id AS gene,
  row_number() OVER (PARTITION BY cluster ORDER BY sum(count) DESC, gene_id) AS position
  FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2))"""
HITS = """hits AS (SELECT gene, cell_type, organ, ontology_id, species_type, ontology_type, coalesce(confidence, 1) AS confidence, source,
    'direct' AS source_path, NULL AS ref_gene, NULL AS ref_species FROM rws WHERE species = 'asia'
  UNION ALL SELECT o.gene, cell_type, organ, ontology_id, species_type, ontology_type, coalesce(confidence, 1), source, 'ortholog', o.ref_gene, o.ref_species
    FROM rws JOIN orth o ON rws.gene = o.ref_gene AND rws.species = o.ref_species)"""


def _sold(t: Tables) -> DataFrame:
    """Brand, nation and region of every line; the dimension tables are joined last."""
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        t.lineitem.select("l_partkey", "l_suppkey", "l_discount")
        .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("p_brand", "s_nationkey")
        .agg(F.avg(1 - F.col("l_discount")).alias("share"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("gene_id", F.concat("p_brand", F.lit("@"), F.lower("r_name")))
    )


def kg_gene(t: Tables) -> DataFrame:
    return _sold(t).select(
        "gene_id", F.col("p_brand").alias("name"), F.lower("r_name").alias("species"),
        F.when(F.col("r_regionkey") < 3, "Plant").otherwise("Animal").alias("species_type"),
        F.expr("'m' || right(p_brand, 1)").alias("marker_resource"), F.expr("'d' || r_regionkey").alias("dataset"),
    ).distinct()


def kg_ontology(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.expr("'O:' || n_nationkey").alias("ontology_id"), F.col("n_name").alias("name"),
        F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN r_name ELSE r_name || '|ASIA' END").alias("organ"),
        F.lit("Plant").alias("species_type"), F.lit("cell").alias("type"),
    )


def kg_marker_of(t: Tables) -> DataFrame:
    return _sold(t).withColumn("share", F.round("share", 6)).where("share >= 0.95").select(
        "gene_id", F.expr("'O:' || n_nationkey").alias("ontology_id"),
        F.expr("IF(n_nationkey = 7, NULL, share)").alias("relation_confidence"),
        F.expr("IF(right(p_brand, 1) = '1', NULL, 's' || right(p_brand, 1))").alias("info_source"),
    )


def kg_relation(t: Tables) -> DataFrame:
    up = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return up.unionAll(t.region.select("r_name", F.lit("WORLD")))


def kg_rows(t: Tables) -> DataFrame:
    from cellsift.operators.knowledge import marker_rows

    return marker_rows(kg_gene(t), kg_marker_of(t), kg_ontology(t))


def orthologs(t: Tables) -> DataFrame:
    b = t.part.select("p_brand").distinct()
    return b.join(t.region, F.col("r_regionkey") == F.expr("CAST(substr(p_brand, 7) AS INT) % 5")).select(
        F.col("p_brand").alias("gene"), F.lower("r_name").alias("ref_species"),
        F.expr("'Brand#' || (26 - CAST(substr(p_brand, 7) AS INT))").alias("ref_gene"))


def cluster_genes(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window as W

    sums = matrix(t).join(cells(t), "cell_id").groupBy("cluster", F.col("gene_id").alias("gene")).agg(
        F.sum("count").alias("s"))
    w = W.partitionBy("cluster").orderBy(F.col("s").desc(), "gene")
    return sums.select("cluster", "gene", F.row_number().over(w).alias("position"))


def hits(t: Tables) -> DataFrame:
    from cellsift.operators.knowledge import all_hits, lookup_markers, lookup_via_orthologs

    genes, rows = t.part.select(F.col("p_brand").alias("gene")).distinct(), kg_rows(t)
    return all_hits(
        lookup_markers(genes, rows, species="asia"), lookup_via_orthologs(genes, orthologs(t), rows))


# Ground truth and three runs of predicted labels on a nation-like clustering of the customers.
EVAL = """obs AS (SELECT c_custkey AS cell_id, CAST((c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) % 25 AS VARCHAR) AS cluster,
    'N' || lower(substr(n_name, 2)) AS true_type, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  od AS (SELECT cluster, n_name, r_name, true_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS total,
    row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, n_name) AS k FROM obs GROUP BY 1, 2, 3, 4),
  ann AS (SELECT 'default' AS run, cluster, n_name AS label, 'high' AS confidence, 'decisive' AS status FROM od WHERE k = 1
    UNION ALL SELECT 'rules', cluster, CASE WHEN n / total < 0.75 THEN r_name ELSE n_name END, CASE WHEN n / total < 0.75 THEN 'low' ELSE 'medium' END, 'decisive' FROM od WHERE k = 1
    UNION ALL SELECT 'review', o.cluster, CASE WHEN o.cluster = '3' THEN 'unknown' WHEN o.cluster::INT % 5 = 0 THEN coalesce(s.n_name, o.n_name) ELSE o.true_type END,
      CASE WHEN o.cluster = '3' THEN 'low' ELSE 'medium' END, CASE WHEN o.cluster = '3' THEN 'unknown' ELSE 'decisive' END
      FROM od o LEFT JOIN (SELECT * FROM od WHERE k = 2) s USING (cluster) WHERE o.k = 1 AND o.cluster <> '7'),
  pins AS (SELECT 'N' || lower(substr(n_name, 2)) AS label, CASE WHEN n_nationkey % 6 = 5 THEN r_name ELSE n_name END AS node FROM nation JOIN region ON n_regionkey = r_regionkey),
  anc AS (SELECT n_name AS name, r_name AS ancestor FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'WORLD' FROM nation
    UNION ALL SELECT r_name, 'WORLD' FROM region),
  ev AS (SELECT r.run, o.cell_id, o.cluster, CASE WHEN a.run IS NULL THEN 'unknown' ELSE a.label END AS raw, coalesce(a.confidence, 'low') AS confidence,
    coalesce(a.status, 'unknown') AS status, o.true_type AS "true" FROM obs o CROSS JOIN (SELECT DISTINCT run FROM ann) r
    LEFT JOIN ann a ON a.run = r.run AND a.cluster = o.cluster),
  rp AS (SELECT p.raw, p."true", nb.node AS node_b, CASE WHEN lower(raw) <> 'unknown' THEN na.name END AS node_a FROM (SELECT DISTINCT raw, "true" FROM ev) p
    LEFT JOIN pins nb ON nb.label = p."true"
    LEFT JOIN (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT 'WORLD') na ON lower(na.name) = lower(p.raw)),
  rl AS (SELECT raw, "true", node_a, node_b, mapped_true, relation, CASE WHEN relation IN ('exact', 'synonym', 'subtype') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy_weight,
    (CASE relation WHEN 'exact' THEN 1.0 WHEN 'synonym' THEN 1.0 WHEN 'subtype' THEN 1.5 WHEN 'supertype' THEN 0.5 ELSE 0 END)::DOUBLE AS hierarchy_weight FROM (
    SELECT *, (SELECT min(label) FROM pins WHERE lower(pins.node) = lower(node_a)) AS mapped_true, CASE WHEN node_a IS NULL OR node_b IS NULL THEN 'unmatched' WHEN node_a = node_b AND raw = "true" THEN 'exact'
      WHEN node_a = node_b THEN 'synonym' WHEN EXISTS (SELECT 1 FROM anc WHERE name = node_a AND ancestor = node_b) THEN 'subtype'
      WHEN EXISTS (SELECT 1 FROM anc WHERE name = node_b AND ancestor = node_a) THEN 'supertype' ELSE 'unrelated' END AS relation FROM rp)),
  sc AS (SELECT * FROM ev JOIN rl USING (raw, "true"))"""
TYPE_F1 = """ty AS (SELECT run, "true" AS type, sum(hierarchy_weight) AS tp, (count(*) FILTER (hierarchy_weight = 0))::DOUBLE AS fn FROM sc GROUP BY 1, 2),
  fp AS (SELECT run, mapped_true AS type, count(*)::DOUBLE AS fp FROM sc WHERE hierarchy_weight = 0 AND mapped_true <> "true" GROUP BY 1, 2),
  f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT run, type, tp, fn, coalesce(fp, 0) AS fp,
    coalesce(tp / nullif(tp + coalesce(fp, 0), 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM ty LEFT JOIN fp USING (run, type)))"""
PURITY = """pt AS (SELECT run, cluster, "true", count(*) AS n, count(*) FILTER (accuracy_weight > 0) AS ok, min(raw) AS raw FROM sc GROUP BY 1, 2, 3),
  pu AS (SELECT run, cluster, sum(n)::BIGINT AS n_cells, min(raw) AS predicted, sum(ok)::BIGINT AS accurate_cells,
    arg_max("true", n * 1000 - k) AS top_true, max(n) AS top_true_n, max(n) / sum(n) AS purity FROM
    (SELECT *, row_number() OVER (PARTITION BY run, cluster ORDER BY "true") AS k FROM pt) GROUP BY 1, 2)"""


def obs(t: Tables) -> DataFrame:
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cell_id"),
        F.expr("CAST((c_nationkey + IF(c_custkey % 4 = 0, 1, 0)) % 25 AS string)").alias("cluster"),
        F.initcap("n_name").alias("true_type"), "n_name", "r_name")


def annotations(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window as W

    counts = obs(t).groupBy("cluster", "n_name", "r_name", "true_type").agg(F.count("*").alias("n"))
    total = counts.groupBy("cluster").agg(F.sum("n").alias("total"))
    w = W.partitionBy("cluster").orderBy(F.col("n").desc(), "n_name")
    two = (
        counts.withColumn("k", F.row_number().over(w)).where("k <= 2").join(total, "cluster").groupBy("cluster")
        .agg(F.max(F.expr("IF(k = 1, struct(n_name, r_name, true_type, n / total AS share), NULL)")).alias("a"),
             F.max(F.expr("IF(k = 2, n_name, NULL)")).alias("second"))
    )
    runs = two.selectExpr("cluster", """stack(3, 'default', a.n_name, 'high', 'decisive',
        'rules', IF(a.share < 0.75, a.r_name, a.n_name), IF(a.share < 0.75, 'low', 'medium'), 'decisive',
        'review', CASE WHEN cluster = '3' THEN 'unknown' WHEN CAST(cluster AS INT) % 5 = 0 THEN coalesce(second, a.n_name) ELSE a.true_type END,
          IF(cluster = '3', 'low', 'medium'), IF(cluster = '3', 'unknown', 'decisive')) AS (run, label, confidence, status)""")
    return runs.where("NOT (run = 'review' AND cluster = '7')")


def pins(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.initcap("n_name").alias("label"), F.expr("IF(n_nationkey % 6 = 5, r_name, n_name)").alias("node"))


def evaluated_cells(t: Tables) -> DataFrame:
    from cellsift.operators.evaluate import join_evaluation

    return join_evaluation(obs(t), obs(t), annotations(t))


def relations(t: Tables, hierarchy: bool = True, counts: DataFrame | None = None) -> DataFrame:
    from cellsift.operators.evaluate import label_relation
    from cellsift.operators.knowledge import ancestors

    pairs = (evaluated_cells(t) if counts is None else counts).select("raw", "true").distinct()
    aliases = t.region.select(F.lower("r_name").alias("alias"), F.col("r_name").alias("node"))
    nodes = t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name")).union(
        t.region.select(F.lit("WORLD"))).distinct()
    if not hierarchy:
        return label_relation(pairs, pins(t), aliases)
    return label_relation(pairs, pins(t), aliases, nodes, ancestors(nodes, kg_relation(t)))


def scored(t: Tables) -> DataFrame:
    from cellsift.operators.evaluate import count_cells, tally

    counts = count_cells(evaluated_cells(t))
    return tally(counts, relations(t, counts=counts))


# Run log: every event is a log record of its user's run.
def _decision_sql(k: str) -> str:
    """The decision of an event: one of its point's names, or 'bogus'."""
    from cellsift.functions.fixed import DECISIONS

    cases = []
    for dp, (_, names) in DECISIONS.items():
        n = len(names) + (1 if dp in ("qc_threshold", "candidate_gap") else 0)
        picks = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(names))
        cases.append(f"WHEN '{dp}' THEN CASE {k} % {n} {picks} ELSE 'bogus' END")
    return "CASE dp " + " ".join(cases) + " ELSE 'bogus' END"


def _point_sql(k: str) -> str:
    from cellsift.functions.fixed import DECISIONS

    return f"CASE {k} % 15 " + " ".join(f"WHEN {i} THEN '{dp}'" for i, dp in enumerate(DECISIONS)) + " ELSE 'bogus_point' END"


_LOG_FIELDS = """'u' || (user_id // 50) AS run, event_id AS line, k, v,
    CASE WHEN k = 0 THEN 'session_start' WHEN k = 1 THEN 'session_end' WHEN k = 2 THEN 'bogus' WHEN event_type IN ('view', 'error') THEN 'exec' ELSE 'judgment' END AS type"""
LOG = f"""raw AS (SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v, value FROM events),
  lg0 AS (SELECT {_LOG_FIELDS}, value, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, {_point_sql('k')} AS dp FROM raw),
  lg AS (SELECT run, line, k, v, type, ts, value, row_number() OVER (PARTITION BY run ORDER BY line) + CASE WHEN k > 95 THEN 1 ELSE 0 END AS seq,
    CASE WHEN type = 'exec' THEN CASE WHEN k % 3 = 0 THEN 'step4_rank.rank_candidates#' ELSE 'step1_prepare.leiden_cluster#' END || (k % 8) END AS run_id,
    CASE WHEN type = 'judgment' THEN dp END AS decision_point, CASE WHEN type = 'judgment' THEN CASE WHEN k % 2 = 0 THEN 'session' ELSE 'cluster' END END AS scope_type,
    CASE WHEN type = 'judgment' AND k % 5 <> 0 THEN CAST(k % 9 AS VARCHAR) END AS cluster_id,
    CASE WHEN type = 'judgment' THEN CASE WHEN k % 3 = 0 THEN 'step4_rank.rank_candidates#' ELSE 'step1_prepare.leiden_cluster#' END || (v % 8) END AS run_ref,
    CASE WHEN type = 'judgment' THEN {_decision_sql('v')} END AS decision, CASE WHEN type = 'judgment' AND k % 7 <> 0 THEN 'high' END AS confidence,
    CASE WHEN type = 'judgment' THEN CASE WHEN k % 13 = 0 THEN '  ' ELSE 'because' END END AS reasoning FROM lg0)"""


def run_log(t: Tables) -> DataFrame:
    from cellsift.operators.running import running

    raw = t.events.select(
        F.expr("'u' || floor(user_id / 50)").alias("run"), F.col("event_id").alias("line"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor("value").alias("v"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    typed = raw.withColumns({
        "type": F.expr("""CASE WHEN k = 0 THEN 'session_start' WHEN k = 1 THEN 'session_end' WHEN k = 2 THEN 'bogus'
            WHEN event_type IN ('view', 'error') THEN 'exec' ELSE 'judgment' END"""),
        "dp": F.expr(_point_sql("k")), "_one": F.lit(1).cast("long")})
    numbered = running(typed, ["run"], ["line"], {"_k": ("sum", "_one")})
    step = "IF(k % 3 = 0, 'step4_rank.rank_candidates#', 'step1_prepare.leiden_cluster#')"
    return numbered.selectExpr(
        "run", "line", "k", "v", "_k + IF(k > 95, 1, 0) AS seq", "ts", "type",
        "IF(type = 'session_start', run, NULL) AS session_id",
        f"IF(type = 'exec', {step} || (k % 8), NULL) AS run_id",
        "IF(type = 'exec', '{}', NULL) AS parameters",
        """IF(type = 'exec', to_json(named_struct('n_clusters', k % 12, 'n_singleton', k % 5, 'silhouette_overall', named_struct('mean', value),
            'n_clusters_in_range_10_50', v, 'subcluster_silhouette', named_struct('mean', value))), NULL) AS metrics""",
        "IF(type = 'judgment', dp, NULL) AS decision_point",
        "IF(type = 'judgment', named_struct('type', IF(k % 2 = 0, 'session', 'cluster'), 'cluster_id', IF(k % 5 <> 0, CAST(k % 9 AS STRING), NULL)), NULL) AS scope",
        f"IF(type = 'judgment', {step} || (v % 8), NULL) AS run_ref",
        """IF(type = 'judgment', array(named_struct('path', 'step4_rank.per_cluster.' || (k % 9) || '.first_count', 'value', IF(k % 11 = 0, NULL, CAST(v AS STRING))),
            named_struct('path', 'step1_prepare.qc.' || (k % 4), 'value', '1')), NULL) AS inputs""",
        f"IF(type = 'judgment', named_struct('decision', {_decision_sql('v')}, 'confidence', IF(k % 7 <> 0, 'high', NULL), 'action', 'proceed'), NULL) AS output",
        "IF(type = 'judgment', IF(k % 13 = 0, '  ', 'because'), NULL) AS reasoning",
        "IF(type = 'session_end' AND v % 2 = 0, 'done', NULL) AS final_summary")
