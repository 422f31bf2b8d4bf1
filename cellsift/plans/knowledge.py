"""Queries on the knowledge graph, candidate ranking and cross-species mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.functions import scalars as sc
from cellsift.operators import candidates as cd
from cellsift.operators import knowledge as kg
from cellsift.operators import mapping as mp
from cellsift.plans.inputs import (CELLS, CG, EXPR, HITS, ORTH, ROWS, cells, cluster_genes, hits, kg_gene, kg_marker_of,
                                   kg_ontology, kg_relation, kg_rows, orthologs, with_sql)
from cellsift.plans.quality import describe_sql, rounded, sig
from cellsift.plans.registry import query

HIT = ["gene", *kg.HIT_COLUMNS]
JOINED = lambda c: F.array_join(c, ",").alias(c)


def _genes(t):
    return t.part.select(F.col("p_brand").alias("gene")).distinct()


@query("lookup_markers", with_sql(ROWS) + """SELECT gene, cell_type, organ, ontology_id, species_type, ontology_type, confidence, source
  FROM rws WHERE gene_type = 'Plant' AND confidence >= 0.951""")
def _(t):
    return kg.lookup_markers(_genes(t), kg_rows(t), species_type="Plant", min_confidence=0.951)


@query("hit_projection", with_sql(ROWS) + """SELECT gene, species, cell_type, organ, coalesce(confidence, 1) AS confidence FROM rws
  WHERE coalesce(confidence, 1) >= 0.951 AND lower(coalesce(organ, '')) = 'asia'""")
def _(t):
    got = kg.hit_projection(kg_rows(t), 0.951, True, "Asia")
    return got.select("gene", "species", "cell_type", "organ", "confidence")


@query("lookup_via_orthologs", with_sql(ROWS, ORTH) + """SELECT o.gene, cell_type, organ, ontology_id, species_type, ontology_type,
  coalesce(confidence, 1) AS confidence, source, o.ref_gene AS ortholog_ref_gene, o.ref_species AS ortholog_ref_species
  FROM rws JOIN orth o ON rws.gene = o.ref_gene AND rws.species = o.ref_species""")
def _(t):
    return kg.lookup_via_orthologs(_genes(t), orthologs(t), kg_rows(t))


@query("ancestors", """WITH RECURSIVE rel AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT r_name, 'WORLD' FROM region),
  up AS (SELECT child AS name, parent AS ancestor, 1 AS hops FROM rel WHERE child IN (SELECT n_name FROM nation)
    UNION ALL SELECT up.name, rel.parent, hops + 1 FROM up JOIN rel ON rel.child = up.ancestor WHERE hops < 3)
  SELECT name, ancestor, min(hops) AS hops FROM up GROUP BY 1, 2""")
def _(t):
    return kg.ancestors(t.nation, kg_relation(t), name="n_name")


@query("match_names", """WITH lab AS (SELECT DISTINCT lower(trim(label)) AS k, label FROM (SELECT r_name AS label FROM region UNION ALL
    SELECT substr(n_name, 1, 4) FROM nation UNION ALL SELECT lower(p_type) FROM part) WHERE trim(label) <> ''),
  nm AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT DISTINCT r_name FROM region UNION SELECT DISTINCT p_name FROM part)
  SELECT label, name, match, position FROM (SELECT label, name, CASE WHEN trim(lower(name)) = k THEN 'casefold' ELSE 'contains' END AS match,
    row_number() OVER (PARTITION BY label ORDER BY CASE WHEN trim(lower(name)) = k THEN 'casefold' ELSE 'contains' END, name) AS position
    FROM lab JOIN nm ON contains(lower(name), k))""")
def _(t):
    lab = t.region.select(F.col("r_name").alias("label")).unionAll(t.nation.select(F.substring("n_name", 1, 4))).unionAll(
        t.part.select(F.lower("p_type")))
    nm = t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name")).union(t.part.select("p_name"))
    return kg.match_names(lab, nm)


@query("canonical_name", """SELECT label, coalesce((SELECT min(n_name) FROM nation WHERE n_name = trim(label)),
    (SELECT min(n_name) FROM nation WHERE lower(trim(n_name)) = lower(trim(label)))) AS node
  FROM (SELECT DISTINCT lower(n_name) AS label FROM nation UNION SELECT n_name FROM nation UNION SELECT r_name FROM region)""")
def _(t):
    labels = t.nation.select(F.lower("n_name").alias("label")).union(t.nation.select("n_name")).union(
        t.region.select("r_name")).distinct()
    return kg.canonical_name(labels, t.nation.select(F.col("n_name").alias("name")), "label")


@query("unmatched_genes", with_sql(ROWS, ORTH, HITS) + """SELECT gene FROM (SELECT DISTINCT p_name AS gene FROM part)
  WHERE gene NOT IN (SELECT gene FROM hits)""")
def _(t):
    return kg.unmatched_genes(t.part.select(F.col("p_name").alias("gene")), hits(t))


@query("kg_provenance", with_sql(ROWS) + """SELECT * FROM (
  SELECT 'node' AS item, 'Gene' AS value, count(*) AS n FROM ge UNION ALL SELECT 'node', 'Ontology', count(*) FROM ont
  UNION ALL SELECT 'species', species, count(*) FROM ge GROUP BY 2 UNION ALL SELECT 'species_type', species_type, count(*) FROM ge GROUP BY 2
  UNION ALL SELECT 'marker_resource', marker_resource, count(*) FROM ge GROUP BY 2 UNION ALL SELECT 'dataset', dataset, count(*) FROM ge GROUP BY 2
  UNION ALL SELECT 'edge', 'marker_of', count(*) FROM mo
  UNION ALL SELECT 'organ', organ, count(*) FROM ont GROUP BY 2)""")
def _(t):
    return kg.kg_provenance(kg_gene(t), kg_ontology(t), kg_marker_of(t))


@query("target_coverage", with_sql(ROWS) + """SELECT *, n_genes_with_type || ' genes with a type: ' || CASE tier WHEN 'high' THEN 'direct path is enough, skip the ortholog mapping'
    WHEN 'medium' THEN 'direct path first, up to three reference species fill the gaps' ELSE 'ortholog path is needed, up to three reference species' END AS rationale,
    CASE tier WHEN 'high' THEN 'single_species' WHEN 'medium' THEN 'mixed' ELSE 'cross_species_only' END AS strategy FROM (
  SELECT species, n_genes, n_unique_genes, coalesce(n_genes_with_type, 0) AS n_genes_with_type, coalesce(n_types, 0) AS n_types, coalesce(n_edges, 0) AS n_edges,
    CASE WHEN coalesce(n_genes_with_type, 0) >= 24 THEN 'high' WHEN coalesce(n_genes_with_type, 0) >= 22 THEN 'medium' ELSE 'low' END AS tier
  FROM (SELECT species, count(*) AS n_genes, count(DISTINCT name) AS n_unique_genes FROM ge GROUP BY 1) LEFT JOIN
    (SELECT species, count(DISTINCT gene) AS n_genes_with_type, count(DISTINCT cell_type) AS n_types, count(*) AS n_edges FROM rws GROUP BY 1) USING (species))""")
def _(t):
    return kg.target_coverage(kg_gene(t), kg_rows(t), high=24, low=22)


@query("normalize_species", """SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS id, lower(replace(p_name, ' ', '_')) AS species,
  array_to_string(list_transform(string_split(lower(replace(p_name, ' ', '_')), '_'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '_') AS prefix FROM part""")
def _(t):
    ids = t.part.select(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("id")).distinct()
    return ids.select("id", kg.normalize_species("id", F.lit("Plant")).alias("species"), kg.blast_prefix("id").alias("prefix"))


@query("organ_status", with_sql(ROWS) + """SELECT gene, CASE WHEN y AND n THEN 'partial' WHEN y THEN 'root' WHEN n THEN 'mismatch' ELSE 'unknown' END AS status FROM (
  SELECT gene, bool_or(m) AS y, bool_or(NOT m) AS n FROM (SELECT gene, CASE WHEN len(tk) > 0 THEN list_contains(tk, 'asia') END AS m FROM
    (SELECT gene, list_filter(list_transform(string_split(organ, '|'), lambda x: lower(trim(x))), lambda x: x <> '' AND x <> 'unknown') AS tk FROM rws))
  GROUP BY gene)""")
def _(t):
    return kg_rows(t).groupBy("gene").agg(F.collect_set("organ").alias("o")).select("gene", sc.organ_status("o", "Asia").alias("status"))


RANKED = """pg AS (SELECT cluster, cell_type, gene, min(position) AS pos, count(*) AS h, sum(confidence) AS c, min(confidence) AS lo FROM cg JOIN hits USING (gene) GROUP BY 1, 2, 3),
  pt AS (SELECT cluster, cell_type, string_agg(gene, ',' ORDER BY pos, gene) AS supporting_markers, count(*) AS marker_count, sum(c) / sum(h) AS mean_confidence,
    min(lo) AS min_confidence FROM pg GROUP BY 1, 2),
  ex AS (SELECT cluster, cell_type, string_agg(DISTINCT coalesce(source, '?'), ',' ORDER BY coalesce(source, '?')) AS sources,
    string_agg(DISTINCT organ, ',' ORDER BY organ) AS organs, string_agg(DISTINCT source_path, ',' ORDER BY source_path) AS source_paths,
    bool_or(m) AS y, bool_or(NOT m) AS n FROM (SELECT *, CASE WHEN organ <> 'Unknown' THEN list_contains(string_split(organ, '|'), 'ASIA') END AS m FROM hits) JOIN cg USING (gene) GROUP BY 1, 2),
  ca AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE organ_status WHEN 'root' THEN 0 WHEN 'partial' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END,
      marker_count DESC, round(mean_confidence, 12) DESC, cell_type) AS rank FROM
    (SELECT pt.*, sources, organs, source_paths, CASE WHEN y AND n THEN 'partial' WHEN y THEN 'root' WHEN n THEN 'mismatch' ELSE 'unknown' END AS organ_status
     FROM pt JOIN ex USING (cluster, cell_type)))"""
CAND = with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED)


def candidates(t):
    return cd.rank_candidates(cluster_genes(t), hits(t), "Asia")


@query("rank_candidates", CAND + """SELECT cluster, cell_type, supporting_markers, marker_count, round(mean_confidence, 11) AS mean_confidence,
  round(min_confidence, 6) AS min_confidence, sources, organs, source_paths, organ_status, rank FROM ca""")
def _(t):
    lists = ("supporting_markers", "sources", "organs", "source_paths")
    got = candidates(t).withColumns({c: F.array_join(c, ",") for c in lists}).drop("source_species")
    return rounded(got, mean_confidence=11)


@query("cluster_hits", CAND + """SELECT cluster, count(*) AS n_markers, count(h) AS n_markers_hit, count(*) FILTER (d) AS n_direct_hit,
  count(*) FILTER (o) AS n_ortholog_hit, count(*) FILTER (d AND o) AS n_mixed_hit FROM cg LEFT JOIN
  (SELECT gene, count(*) AS h, bool_or(source_path = 'direct') AS d, bool_or(source_path = 'ortholog') AS o FROM hits GROUP BY 1) USING (gene) GROUP BY 1""")
def _(t):
    return cd.cluster_hits(cluster_genes(t), hits(t))


@query("query_stats", with_sql(ROWS, ORTH, HITS) + """SELECT count(*) AS n_genes, count(h) AS n_with_hits, count(*) - count(h) AS n_without_hits,
  round(count(h) / count(*), 6) AS hit_rate, round(avg(h), 6) AS mean_hits_per_gene FROM
  (SELECT DISTINCT p_brand AS gene FROM part UNION SELECT DISTINCT p_type FROM part) LEFT JOIN (SELECT gene, count(*) AS h FROM hits GROUP BY 1) USING (gene)""")
def _(t):
    genes = _genes(t).union(t.part.select("p_type"))
    return rounded(cd.query_stats(genes, hits(t)))


@query("hits_per_gene", sig(with_sql(ROWS, ORTH, HITS, "pg AS (SELECT 1 AS k, count(*) AS h FROM hits GROUP BY gene)",
       "d AS (" + describe_sql("pg", "h", "k") + ")") + "SELECT * EXCLUDE (k) FROM d"))
def _(t):
    return cd.hits_per_gene(hits(t)).drop("histogram")


@query("path_hit_stats", with_sql(ROWS, ORTH, HITS) + """SELECT count(*) FILTER (d) AS n_direct, count(*) FILTER (o) AS n_ortholog,
  count(*) FILTER (d AND o) AS n_mixed, count(*) FILTER (o AND NOT d) AS n_only_ortholog FROM
  (SELECT gene, bool_or(source_path = 'direct') AS d, bool_or(source_path = 'ortholog') AS o FROM hits GROUP BY 1)""")
def _(t):
    return cd.path_hit_stats(hits(t))


@query("candidate_stats", CAND + """SELECT cluster, count(*) AS n_candidates, count(*) FILTER (marker_count = top) AS n_tied_at_top,
  round(greatest(log2(sum(marker_count)) - sum(marker_count * log2(marker_count)) / sum(marker_count), 0), 6) AS entropy
  FROM ca JOIN (SELECT cluster, marker_count AS top FROM ca WHERE rank = 1) USING (cluster) GROUP BY 1""")
def _(t):
    return rounded(cd.candidate_stats(candidates(t)))


@query("candidate_totals", CAND + """SELECT count(DISTINCT cell_type) AS n_types, count(DISTINCT cluster) AS n_clusters_with_candidates,
  round(avg(mean_confidence), 6) AS mean_confidence FROM ca""")
def _(t):
    return rounded(cd.candidate_totals(candidates(t)))


GAP = """anc AS (SELECT n_name AS name, r_name AS ancestor FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'WORLD' FROM nation
    UNION ALL SELECT r_name, 'WORLD' FROM region),
  f AS (SELECT * FROM ca WHERE rank = 1), s AS (SELECT * FROM ca WHERE rank = 2),
  ta AS (SELECT cluster, count(*) AS n_candidates, sum(marker_count) AS sup FROM ca GROUP BY 1),
  gap AS (SELECT c.cluster, CASE WHEN f.cell_type IS NULL THEN 'no_candidates' ELSE 'has_candidates' END AS status, coalesce(n_candidates, 0) AS n_candidates,
    f.cell_type AS first_type, s.cell_type AS second_type, coalesce(f.marker_count, 0) AS first_count, coalesce(s.marker_count, 0) AS second_count,
    f.marker_count / greatest(coalesce(s.marker_count, 0), 1) AS count_ratio, f.marker_count - coalesce(s.marker_count, 0) AS count_diff,
    f.mean_confidence - s.mean_confidence AS confidence_diff,
    (SELECT nullif(count(*), 0) FROM ca WHERE ca.cluster = c.cluster AND ca.marker_count = f.marker_count) AS n_tied_at_first,
    f.marker_count / greatest(sup, 1) AS frac_support_first,
    CASE WHEN s.cell_type IS NOT NULL THEN EXISTS (SELECT 1 FROM anc WHERE (name = s.cell_type AND ancestor = f.cell_type) OR (name = f.cell_type AND ancestor = s.cell_type)) END AS related,
    CASE WHEN s.cell_type IS NOT NULL THEN (SELECT string_agg(ancestor, ',' ORDER BY ancestor) FROM anc a WHERE name = f.cell_type AND ancestor IN (SELECT ancestor FROM anc b WHERE b.name = s.cell_type)) END AS shared
    FROM (SELECT DISTINCT cluster FROM cells UNION SELECT 'NONE') c LEFT JOIN ta USING (cluster) LEFT JOIN f USING (cluster) LEFT JOIN s USING (cluster))"""
CANDGAP = with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP)


def gaps(t):
    clusters = cells(t).select("cluster").union(t.region.select(F.lit("NONE")))
    return cd.gap_metrics(candidates(t), clusters, kg.ancestors(t.nation, kg_relation(t), name="n_name"))


@query("gap_metrics", CANDGAP + """SELECT cluster, status, n_candidates, first_type, second_type, first_count, second_count, round(count_ratio, 6) AS count_ratio,
  count_diff, round(confidence_diff, 6) AS confidence_diff, n_tied_at_first, round(frac_support_first, 6) AS frac_support_first, related, shared AS shared_ancestors FROM gap""")
def _(t):
    got = gaps(t).withColumn("shared_ancestors", F.array_join("shared_ancestors", ","))
    return rounded(got.drop("first_confidence", "second_confidence", "first_is_ancestor", "n_shared_ancestors"))


@query("gap_summary", CANDGAP + """SELECT count(*) AS n_clusters, count(*) FILTER (status = 'has_candidates') AS n_with_candidates,
  round(avg(count_ratio), 6) AS mean_count_ratio, count(*) FILTER (count_ratio <= 1) AS n_tied FROM gap""")
def _(t):
    return rounded(cd.gap_summary(gaps(t)))


@query("decision_view", CAND + """SELECT cluster, rank, cell_type, marker_count, round(mean_confidence, 11) AS mean_confidence, organs, organ_status,
  CASE WHEN rank <= 2 THEN supporting_markers END AS supporting_markers FROM ca""")
def _(t):
    got = cd.decision_view(candidates(t))
    return rounded(got.withColumns({c: F.array_join(c, ",") for c in ("organs", "supporting_markers")}), mean_confidence=11)


DICT = """gd AS (SELECT DISTINCT gene, cell_type FROM pg)"""


@query("reverse_marker_dict", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, DICT) + """
  SELECT gene, string_agg(cell_type, ',' ORDER BY cell_type) AS cell_types FROM gd GROUP BY 1""")
def _(t):
    return cd.reverse_marker_dict(candidates(t)).withColumn("cell_types", F.array_join("cell_types", ","))


@query("dict_coverage", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, DICT) + """
  SELECT r_name AS "true", count(DISTINCT gene) AS n_markers, count(DISTINCT gd.cell_type) AS n_terms_covered, count(DISTINCT gene) < 3 AS too_few,
    array_to_string(list_sort(list_distinct(list(gene)))[1:5], ',') AS sample_markers
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN gd ON gd.cell_type = n_name GROUP BY 1""")
def _(t):
    entries = kg_relation(t).where("parent <> 'WORLD'").select(F.col("parent").alias("true"), F.col("child").alias("predicted"))
    got = cd.dict_coverage(cd.reverse_marker_dict(candidates(t)), entries)
    return got.withColumn("sample_markers", F.array_join("sample_markers", ","))


@query("match_dictionary", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, DICT) + """
  SELECT cluster, cell_type, count(*) AS marker_count, string_agg(gene, ',' ORDER BY position, gene) AS supporting_markers, 'match' AS organ_status,
    row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, cell_type) AS rank FROM cg JOIN gd USING (gene) GROUP BY 1, 2""")
def _(t):
    got = cd.match_dictionary(cluster_genes(t), cd.reverse_marker_dict(candidates(t)), "Asia").drop("mean_confidence")
    return got.withColumn("supporting_markers", F.array_join("supporting_markers", ","))


# Mapping records: ship mode and brand stand for species and genes, the discount for identity.
REC = """rec AS (SELECT p_brand AS gene, l_returnflag || l_linestatus AS ref_species, 'x' || l_suppkey AS ref_gene, max(100 - l_discount * 900) AS score,
  'percent_identity' AS score_type, CASE WHEN count(*) = 1 THEN 'blastp_top_hit' ELSE 'blastp_multiple_hits' END AS mapping_type
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
BEST = """best AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, ref_species, ref_gene) AS position FROM
  (SELECT *, row_number() OVER (PARTITION BY gene, ref_species ORDER BY score DESC, ref_gene) AS r FROM rec WHERE score >= 30) WHERE r <= 2)"""


@mp.mapping_source("lines")
def _records(rows):
    return rows.groupBy("gene", "ref_species", "ref_gene").agg(
        F.max(100 - F.col("l_discount") * 900).alias("score"),
        F.lit("percent_identity").alias("score_type"),
        F.when(F.count("*") == 1, "blastp_top_hit").otherwise("blastp_multiple_hits").alias("mapping_type"))


def _best(t):
    rows = t.lineitem.join(t.part.select("p_partkey", F.col("p_brand").alias("gene")), F.col("l_partkey") == F.col("p_partkey")).select(
        "gene", F.concat("l_returnflag", "l_linestatus").alias("ref_species"), F.expr("'x' || l_suppkey").alias("ref_gene"), "l_discount")
    return mp.collapse_best(mp.map_genes("lines", rows), 30.0, 2)


@query("collapse_best", with_sql(REC, BEST) + "SELECT gene, ref_species, ref_gene, round(score, 6) AS score, score_type, mapping_type, position FROM best")
def _(t):
    return rounded(_best(t).select("gene", "ref_species", "ref_gene", "score", "score_type", "mapping_type", "position"))


@query("mapping_summary", with_sql(REC, BEST) + """SELECT count(*) AS n_input, count(k) AS n_mapped, count(*) - count(k) AS n_unmapped, round(count(k) / count(*), 4) AS hit_rate,
  round(coalesce(avg(k), 0), 4) AS mean_ref_species FROM (SELECT DISTINCT p_brand AS gene FROM part UNION SELECT DISTINCT p_type FROM part)
  LEFT JOIN (SELECT gene, count(DISTINCT ref_species) AS k FROM best GROUP BY 1) USING (gene)""")
def _(t):
    return mp.mapping_summary(_genes(t).union(t.part.select("p_type")), _best(t))


@query("mapping_types", with_sql(REC, BEST) + "SELECT score_type, mapping_type, count(*) AS n FROM best GROUP BY 1, 2")
def _(t):
    return mp.mapping_types(_best(t))


@query("mapping_scores", sig(with_sql(REC, BEST, "b AS (SELECT 1 AS k, round(score, 9) AS score FROM best)", "d AS (" + describe_sql("b", "score", "k") + ")")
       + "SELECT * EXCLUDE (k) FROM d"))
def _(t):
    return mp.mapping_scores(_best(t).withColumn("score", F.round("score", 9))).drop("histogram")


@query("unmapped_genes", with_sql(REC, BEST) + """SELECT gene FROM (SELECT DISTINCT p_brand AS gene FROM part UNION SELECT DISTINCT p_type FROM part)
  WHERE gene NOT IN (SELECT gene FROM best)""")
def _(t):
    return mp.unmapped_genes(_genes(t).union(t.part.select("p_type")), _best(t))


@query("collect_marker_genes", with_sql(EXPR, CELLS, CG) + "SELECT DISTINCT gene FROM cg")
def _(t):
    return mp.collect_marker_genes(cluster_genes(t), "gene")


@query("error_warning", """SELECT count(*) AS n_requests, count(*) FILTER (event_type = 'error') AS n_errors,
  CASE WHEN count(*) FILTER (event_type = 'error') >= count(*) THEN 'all requests failed'
    WHEN count(*) FILTER (event_type = 'error') >= count(*) * 0.5 THEN 'most requests failed' END AS warning FROM events""")
def _(t):
    return mp.error_warning(t.events.select((F.col("event_type") == "error").alias("failed")))


@query("routing", with_sql(ROWS) + """SELECT species AS target_species, CASE WHEN k >= 24 THEN 'single_species' WHEN k >= 22 THEN 'mixed' ELSE 'cross_species_only' END AS strategy,
  k < 24 AS map_needed, CASE WHEN k < 24 THEN CASE kind WHEN 'Plant' THEN 'zea_mays,oryza_sativa,arabidopsis_thaliana' ELSE 'mus_musculus,homo_sapiens' END END AS "references",
  CASE WHEN k < 24 THEN 'default' END AS reference_source, 'routing_accept' AS decision
  FROM (SELECT species, any_value(species_type) AS kind FROM ge GROUP BY 1) LEFT JOIN (SELECT species, count(DISTINCT gene) AS k FROM rws GROUP BY 1) USING (species)""")
def _(t):
    kind = kg_gene(t).groupBy("species").agg(F.any_value("species_type").alias("target_species_type"))
    cov = kg.target_coverage(kg_gene(t), kg_rows(t), high=24, low=22).join(kind, "species").select(
        F.col("species").alias("target_species"), "target_species_type", F.col("strategy").alias("recommended_strategy"),
        F.lit(None).cast("array<string>").alias("refs"))
    return mp.routing(cov).withColumn("references", F.array_join("references", ","))


@query("reuse_key")
def _(t):
    return mp.reuse_key(cluster_genes(t), "asia", ["zea_mays", "oryza_sativa"], "lines", gene="gene")


@query("strip_seq_id", """SELECT DISTINCT raw, CASE WHEN len(p) > 0 THEN p[1] ELSE tok END AS id FROM (
  SELECT raw, tok, list_filter(string_split(tok, '|'), lambda x: x <> '') AS p FROM (
    SELECT raw, regexp_replace(string_split(trim(raw), ' ')[1], '^(?:[A-Za-z]{2,3}\\|)+', '') AS tok FROM
      (SELECT 'lcl|' || p_brand || '|' || p_size || ' ' || p_name AS raw FROM part)))""")
def _(t):
    raw = t.part.select(F.expr("'lcl|' || p_brand || '|' || p_size || ' ' || p_name").alias("raw")).distinct()
    return raw.select("raw", sc.strip_seq_id("raw").alias("id"))
