"""Queries on documents, vectors and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.functions import scalars as sc
from cellsift.operators import retrieval as rt
from cellsift.plans.embedding import points
from cellsift.plans.inputs import CG, CELLS, EXPR, HITS, ORTH, ROWS, LOG, with_sql
from cellsift.plans.knowledge import GAP, RANKED, gaps
from cellsift.plans.logs import DIAG, _diagnosis
from cellsift.plans.registry import query
from cellsift.sources import readers as rd
from cellsift.sources import sinks as sk

TOK = """tk AS (SELECT doc_id, lang, source, list_concat(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]+'), lambda x: lower(x)), regexp_extract_all(text, '[一-鿿]')) AS tok FROM documents)"""


@query("tokenize", with_sql(TOK) + "SELECT doc_id, len(tok) AS n, md5(array_to_string(tok, ' ')) AS tokens FROM tk")
def _(t):
    tok = t.documents.select("doc_id", sc.tokens("text").alias("tok"))
    return tok.select("doc_id", F.size("tok").alias("n"), F.md5(F.array_join("tok", " ")).alias("tokens"))


def _bm25_sql(terms, where="true"):
    n = len(terms)
    f = ", ".join(f"len(list_filter(tok, lambda x: x = '{q}')) AS f{i}" for i, q in enumerate(terms))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(n))
    s = " + ".join(f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for i in range(n))
    return with_sql(TOK, f"c AS (SELECT doc_id, len(tok) AS dl, {f} FROM tk WHERE {where})", f"s AS (SELECT count(*) AS n, greatest(avg(dl), 1) AS avgdl, {d} FROM c)",
                    f"r AS (SELECT doc_id, {s} AS raw FROM c, s)") + "SELECT doc_id, round(raw, 4) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(raw, 10) DESC, doc_id) AS rank FROM r) WHERE rank <= 20"


@query("bm25_topk", _bm25_sql(["the", "license", "copyright", "ther"]))
def _(t):
    return rt.bm25_topk(t.documents, "the License, copyright the ther", 20)


@query("bm25_topk_tags", _bm25_sql(["the", "and"], "lang = 'en' AND source = 'src3'"))
def _(t):
    docs = t.documents.withColumn("tags", F.array("lang", "source"))
    return rt.bm25_topk(docs, "the and", 20, ["en", "src3"])


@query("cosine_topk", """WITH q AS (SELECT [CAST((i % 7) - 3 AS DOUBLE) FOR i IN range(64)] AS q), r AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS raw FROM embeddings, q)
  SELECT id, round(raw, 4) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(raw, 10) DESC, id) AS rank FROM r) WHERE rank <= 20""")
def _(t):
    return rt.cosine_topk(points(t), [(i % 7) - 3 for i in range(64)], 20)


@query("add_note", "SELECT printf('note-%04d', max(doc_id) + 1) AS note_id, 'remember this' AS content FROM documents UNION ALL SELECT printf('note-%04d', doc_id), text FROM documents")
def _(t):
    notes = t.documents.select(F.format_string("note-%04d", "doc_id").alias("note_id"), F.lit("2024").alias("ts"), F.lit("s").alias("session_id"), F.lit("p").alias("project_id"),
                               F.array("lang", "source").alias("tags"), F.col("text").alias("content"))
    return rt.add_note(notes, " remember this ", ["en"]).select("note_id", "content")


@query("parse_blast_tabular", """SELECT gene, 'asia' AS ref_species, ref_gene, score, 'percent_identity' AS score_type, CASE WHEN n = 1 THEN 'blastp_top_hit' ELSE 'blastp_multiple_hits' END AS mapping_type FROM (
  SELECT 'g' || l_orderkey AS gene, 'x' || l_partkey AS ref_gene, l_quantity AS score, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus <> 'X')""")
def _(t):
    lines = t.lineitem.select(F.expr("IF(l_returnflag = 'A', '# comment', concat_ws('\t', 'g' || l_orderkey, 'lcl|x' || l_partkey || ' more', l_quantity, '210', '1e-40'))").alias("value"))
    return rd.parse_blast_tabular(lines, "asia").drop("raw", "confidence")


@query("parse_homology_json", """SELECT 'c' || c_custkey AS gene, 'asia' AS ref_species, 'Os' || c_nationkey AS ref_gene, c_acctbal AS score, 'percent_identity' AS score_type,
  CASE WHEN c_custkey % 5 = 1 THEN 'ensembl_one2many' ELSE 'ensembl_one2one' END AS mapping_type FROM customer WHERE c_custkey % 5 NOT IN (0, 3)""")
def _(t):
    h = """concat('{"type":"', CASE c_custkey % 5 WHEN 0 THEN 'within_species_paralog' WHEN 1 THEN 'ortholog_one2many' ELSE 'ortholog_one2one' END,
        '","target":{"id":"Os', c_nationkey, '","species":"asia"', IF(c_custkey % 5 = 3, '', concat(',"perc_id":', c_acctbal)), '}}')"""
    body = f"""CASE c_custkey % 3 WHEN 0 THEN concat('{{"data":[{{"homologies":[', {h}, ']}}]}}') WHEN 1 THEN concat('[{{"homologies":[', {h}, ']}}]') ELSE concat('{{"homologies":[', {h}, ']}}') END"""
    got = rd.parse_homology_json(t.customer.selectExpr("'c' || c_custkey AS gene", f"{body} AS body"), "asia")
    return got.drop("raw", "confidence")


@query("filter_fasta", """SELECT p_name AS gene, min(p_partkey) AS position, arg_min('S' || p_size, p_partkey) AS sequence FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 10) AND p_name IN (SELECT p_name FROM part WHERE p_size < 40) GROUP BY 1""")
def _(t):
    fasta = t.part.select(F.col("p_partkey").alias("position"), F.concat(F.lit("lcl|"), F.replace("p_name", F.lit(" "), F.lit("~"))).alias("header"), F.expr("'S' || p_size").alias("sequence"))
    names = t.part.select(F.replace("p_name", F.lit(" "), F.lit("~")).alias("gene"), "p_size")
    got = rd.filter_fasta(fasta, names.where("p_size > 10"), names.where("p_size < 40"))
    return got.withColumn("gene", F.replace("gene", F.lit("~"), F.lit(" ")))


@query("fasta_metrics", """SELECT count(*) AS n_fasta, count(*) FILTER (v) AS n_in_var, count(DISTINCT p_name) FILTER (v AND m) AS n_kept, CASE WHEN count(*) > count(*) FILTER (v) THEN (count(*) - count(*) FILTER (v)) || ' sequences are not in the gene table' END AS warning
  FROM (SELECT p_name, p_name IN (SELECT p_name FROM part WHERE p_size > 10) AS v, p_name IN (SELECT p_name FROM part WHERE p_size < 40) AS m FROM part)""")
def _(t):
    fasta = t.part.select(F.col("p_partkey").alias("position"), F.concat(F.lit("lcl|"), F.replace("p_name", F.lit(" "), F.lit("~"))).alias("header"))
    names = t.part.select(F.replace("p_name", F.lit(" "), F.lit("~")).alias("gene"), "p_size")
    return rd.fasta_metrics(fasta, names.where("p_size > 10"), names.where("p_size < 40"))


@query("last_per_key", "SELECT o_custkey::VARCHAR AS cell_id, arg_max(o_orderpriority, o_orderkey) AS cluster FROM orders GROUP BY 1")
def _(t):
    rows = t.orders.select(F.expr("' ' || o_custkey || ' '").alias("cell_id"), F.col("o_orderpriority").alias("cluster"), F.col("o_orderkey").alias("_o"))
    return rd.last_per_key(rows, "cell_id", "_o")


@query("cluster_order", "SELECT cluster, row_number() OVER (ORDER BY CASE WHEN regexp_matches(cluster, '^[0-9]+$') THEN cluster::BIGINT END NULLS LAST, cluster) AS place FROM (SELECT c_nationkey::VARCHAR AS cluster FROM customer UNION SELECT c_mktsegment FROM customer)")
def _(t):
    from cellsift.operators.running import running

    names = t.customer.select(F.col("c_nationkey").cast("string").alias("cluster")).union(t.customer.select("c_mktsegment")).distinct()
    return running(names.withColumn("_one", F.lit(1).cast("long")), [], sc.cluster_order("cluster"), {"place": ("sum", "_one")}).drop("_one")


ENTRY = with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP)


@query("annotation_report", ENTRY + """SELECT cluster, '## cluster ' || cluster || ' - ' || coalesce(first_type, 'unknown') || ' (confidence n/a)' || chr(10)
  || CASE WHEN first_type IS NOT NULL THEN '- first: ' || first_type || ' (marker_count=' || first_count || ', conf=' || coalesce(printf('%.4f', (SELECT mean_confidence FROM f WHERE f.cluster = gap.cluster)), 'None') || ')' || chr(10) ELSE '' END
  || CASE WHEN second_type IS NOT NULL THEN '- second: ' || second_type || ' (marker_count=' || second_count || ')' || chr(10) ELSE '' END
  || '- count_ratio: ' || coalesce(printf('%.2f', count_ratio), 'None') || '  count_diff: ' || coalesce(count_diff::VARCHAR, 'None') || chr(10) AS value FROM gap
  UNION ALL SELECT NULL, '# Cell type annotation report' || chr(10) || chr(10) || '- dataset: ?  organ: Asia' || chr(10) || '- graph: ?  date: ?' || chr(10) || '- clusters: ' || count(*) || '  unknown: ' || count(*) FILTER (first_type IS NULL) || chr(10) FROM gap""")
def _(t):
    g = gaps(t).withColumns({"label": F.coalesce("first_type", F.lit("unknown")), "confidence": F.lit(None).cast("string"), "status": F.when(F.col("first_type").isNull(), "unknown").otherwise("decisive")})
    return sk.annotation_report(g, meta={"organ": "Asia"})


@query("diagnosis_report", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, GAP, DIAG) + """SELECT cluster, '| ' || cluster || ' | ' || printf('%.2f', hit_rate) || ' | ' || n_candidates || ' | ' || first_count || ' | ' || second_count || ' | ' || strictly_ahead || ' | ' || coalesce(printf('%.2f', batch_entropy), 'None') || ' |' AS value FROM dg
  UNION ALL SELECT NULL, '# Diagnosis report' || chr(10) || chr(10) || '- missing metadata: AMERICA' || chr(10) || chr(10) || '| cluster | hit rate | candidates | first | second | strictly ahead | batch entropy |' || chr(10) || '|---|---|---|---|---|---|---|'""")
def _(t):
    return sk.diagnosis_report(_diagnosis(t), t.region.where("r_name = 'AMERICA'").select(F.col("r_name").alias("field")))
