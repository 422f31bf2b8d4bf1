"""Queries of the distributions that the steps report."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.operators import distribution as dist
from cellsift.operators import embedding as em
from cellsift.operators import neighbors as nb
from cellsift.operators import normalize as nz
from cellsift.operators import qc
from cellsift.operators import summaries as sm
from cellsift.plans.embedding import G, ORDER, RES, edges, points, resolutions
from cellsift.plans.inputs import CELLS, CG, EXPR, FINE, LONG, METRICS, NORM, cells, cluster_genes, matrix, n_cells, norm, with_sql
from cellsift.plans.knowledge import CAND, candidates
from cellsift.plans.quality import BREADTH, DE_ALL, FNORM, HVG, _breadth, _de, describe_sql, metrics, rounded, sig
from cellsift.plans.registry import query
from cellsift.session import durable


def _no_bins(df):
    return df.drop("histogram")


def _one(table: str, value: str) -> str:
    """describe() of a whole table."""
    return f"SELECT * EXCLUDE (k) FROM ({describe_sql(f'(SELECT 1 AS k, * FROM {table})', value, 'k')})"


@query("filter_genes_breadth", sig(with_sql(FINE, BREADTH) + _one("breadth", "breadth")))
def _(t):
    return _no_bins(dist.describe(_breadth(t), "breadth"))


@query("normalization_means", sig(with_sql(EXPR, NORM, "gm AS (SELECT gene_id, sum(norm) / (SELECT count(*) FROM customer) AS m FROM norm GROUP BY 1)") + _one("gm", "m")))
def _(t):
    return _no_bins(sm.gene_means(norm(t), n_cells(t)))


@query("variable_distributions", sig(with_sql(FINE, FNORM, HVG, "lg AS (SELECT 'dispersion_norm' AS variable, dn AS value FROM hv WHERE highly_variable UNION ALL SELECT 'mean', mean FROM hv WHERE highly_variable)")
       + describe_sql("lg", "value", "variable")))
def _(t):
    return _no_bins(sm.variable_distributions(nz.select_variable_genes(norm(t, fine=True), n_cells(t), n_top=40)))


# Every tenth gene stands for one that two batches picked.
@query("variable_batches", """SELECT count(*) AS n_kept, sum(1 + (p_partkey % 10 = 0)::INT)::BIGINT AS n_batch_picks, count(*) FILTER (p_partkey % 10 <> 0) AS n_of_one_batch FROM part WHERE p_partkey % 3 = 0""")
def _(t):
    return sm.variable_batches(t.part.select((F.col("p_partkey") % 3 == 0).alias("highly_variable"), (1 + (F.col("p_partkey") % 10 == 0).cast("int")).alias("n_batches")))


# Two-sided tail of a normal score: the series below 2.5 / sqrt 2 of the error function, else the continued fraction.
ERFC = """CASE WHEN {x} < 2.5 THEN 1 - 2 / sqrt(pi()) * {x} * exp(-{x} * {x}) * list_reduce(list_concat([1.0::DOUBLE], list_reverse(range(1, 91))::DOUBLE[]), lambda s, k: 1 + 2 * {x} * {x} / (2 * k + 1) * s)
  ELSE exp(-{x} * {x}) / sqrt(pi()) / list_reduce(list_concat([{x}], list_reverse(range(1, 121))::DOUBLE[]), lambda f, k: {x} + k / 2 / f) END"""
PVALUES = """pv AS (SELECT *, """ + ERFC.format(x="xs") + """ AS pval FROM (SELECT *, abs(score) / sqrt(2) AS xs FROM de)),
  bq AS (SELECT *, pval * count(*) OVER (PARTITION BY cluster) / row_number() OVER (PARTITION BY cluster ORDER BY pval, gene_id) AS bq FROM pv),
  ad AS (SELECT *, least(min(bq) OVER (PARTITION BY cluster ORDER BY pval DESC, gene_id DESC), 1) AS pval_adj FROM bq)"""
P = with_sql(EXPR, NORM, CELLS, DE_ALL, PVALUES)


@query("rank_genes_pvalues", P + "SELECT cluster, gene_id, round(pval, 9) AS pval, round(pval_adj, 9) AS pval_adj FROM ad WHERE rank <= 20")
def _(t):
    return rounded(_de(t).select("cluster", "gene_id", "pval", "pval_adj"), 9)


@query("de_summary", P + """SELECT cluster, count(*) FILTER (pval_adj < 0.05) AS n_fdr_05, count(*) FILTER (pval_adj < 0.01) AS n_fdr_01, count(*) FILTER (pval_adj < 0.001) AS n_fdr_001,
  round(avg((logfc > 0)::INT), 6) AS frac_positive_logfc, round(max(logfc) FILTER (rank = 1) - max(logfc) FILTER (rank = 2), 6) AS gap_1_2,
  round(max(logfc) FILTER (rank = 2) - max(logfc) FILTER (rank = 3), 6) AS gap_2_3 FROM ad GROUP BY 1""")
def _(t):
    from cellsift.operators.markers import de_summary

    return rounded(de_summary(_de(t, None)))


@query("de_distributions", sig(P[:-1] + """, lg AS (SELECT cluster || '|' || variable AS k, value FROM (SELECT cluster, logfc, pval, auc FROM ad) UNPIVOT (value FOR variable IN (logfc, pval, auc))),
  d AS (""" + describe_sql("lg", "value", "k") + ")") + " SELECT split_part(k, '|', 1) AS cluster, split_part(k, '|', 2) AS variable, n, min, max, mean, std, median, p25, p75 FROM d")
def _(t):
    return sm.de_distributions(_de(t, None)).select("cluster", "variable", "n", "min", "max", "mean", "std", "median", "p25", "p75")


@query("de_top_genes", P + """SELECT cluster, string_agg(gene_id, ',' ORDER BY rank) AS genes, round(sum(logfc), 6) AS logfc, round(sum(pval_adj), 6) AS pval_adj, round(sum(auc), 6) AS auc
  FROM ad WHERE rank <= 15 GROUP BY 1""")
def _(t):
    top = sm.top_genes(_de(t, None))
    total = lambda c: F.aggregate(f"top_genes.{c}", F.lit(0.0), lambda s, v: s + v).alias(c)
    return rounded(top.select("cluster", F.array_join("top_genes.name", ",").alias("genes"), total("logfc"), total("pval_adj"), total("auc")))


@query("candidate_distributions", sig(CAND[:-1] + """, lg AS (SELECT 'n_candidates' AS variable, count(*)::DOUBLE AS value FROM ca GROUP BY cluster UNION ALL SELECT 'confidence', mean_confidence FROM ca WHERE mean_confidence IS NOT NULL),
  d AS (""" + describe_sql("lg", "value", "variable") + ") SELECT variable, n, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(median, 4) AS median, round(p25, 4) AS p25, round(p75, 4) AS p75 FROM d"))
def _(t):
    return rounded(sm.candidate_distributions(candidates(t)).select("variable", "n", "min", "max", "mean", "median", "p25", "p75"), 4)


def _agreement_sql() -> str:
    from cellsift.plans.registry import SQL

    return SQL["adjacent_agreement"]


@query("chosen_agreement", f"SELECT round(avg(ari), 5) AS stability_at_chosen, count(*) AS n_pairs FROM ({_agreement_sql()}) WHERE r1 = '0.6' OR r2 = '0.6'")
def _(t):
    return rounded(sm.chosen_agreement(rounded(em.adjacent_agreement(resolutions(t), ORDER)), "0.6"), 5)


@query("degree_summary", sig(G.replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + """, dg AS (SELECT 1 AS k, pt.id, coalesce(sum(weight), 0) AS d FROM pt LEFT JOIN ed ON src = id GROUP BY 2),
  re AS (SELECT id, id AS r FROM pt UNION SELECT re.id, ed.dst FROM re JOIN ed ON ed.src = re.r)
  SELECT q.* EXCLUDE (k), (SELECT count(DISTINCT m) FROM (SELECT min(r) AS m FROM re GROUP BY id)) AS n_components FROM (""" + describe_sql("dg", "d", "k") + ") q"))
def _(t):
    return _no_bins(sm.degree_summary(durable(edges(t)), points(t)))


@query("cluster_size_summary", sig(with_sql(CELLS, "sz AS (SELECT 1 AS k, batch, count(*) AS size FROM cells GROUP BY 2)") + """SELECT q.* EXCLUDE (k),
  (SELECT round((2 * sum(i * size) - (count(*) + 1) * sum(size)) / (count(*) * sum(size)), 6) FROM (SELECT size, row_number() OVER (ORDER BY size) AS i FROM sz)) AS gini FROM (""" + describe_sql("sz", "size", "k") + ") q"))
def _(t):
    return _no_bins(sm.size_summary(cells(t), "batch")).withColumn("gini", F.round("gini", 6))


def _batch_sql() -> str:
    from cellsift.plans.registry import SQL

    return SQL["batch_autocorrelation"]


@query("mean_autocorrelation", f"SELECT round(avg(abs(morans_i)), 5) AS mean_abs, count(morans_i) AS n_batches FROM ({_batch_sql()})")
def _(t):
    return rounded(sm.mean_autocorrelation(nb.batch_autocorrelation(edges(t), points(t), "cluster")), 5)


# Sets with names that no gene has.
@query("available_genes", with_sql(EXPR, CELLS, CG) + """SELECT cluster, which, count(*) AS n_genes, count(*) FILTER (known) AS n_available FROM (SELECT DISTINCT cluster, CASE WHEN position % 2 = 1 THEN 'first' ELSE 'second' END AS which,
  CASE WHEN position % 5 = 0 THEN gene || '?' ELSE gene END AS g, position % 5 <> 0 AS known FROM cg) GROUP BY 1, 2""")
def _(t):
    sets = cluster_genes(t).select("cluster", F.when(F.col("position") % 2 == 1, "first").otherwise("second").alias("which"),
                                   F.when(F.col("position") % 5 == 0, F.concat("gene", F.lit("?"))).otherwise(F.col("gene")).alias("gene_id"))
    return sm.available_genes(sets, matrix(t))


@query("ks_normal", with_sql(EXPR, METRICS, LONG, """sp AS (SELECT variable, avg(value) AS mu, stddev_pop(value) AS sd, count(value) AS n FROM long GROUP BY 1),
  cm AS (SELECT variable, value, count(*) AS c, sum(count(*)) OVER (PARTITION BY variable ORDER BY value) AS hi FROM long GROUP BY 1, 2),
  zs AS (SELECT *, (value - mu) / (sd + 1e-9) AS z, abs((value - mu) / (sd + 1e-9)) / sqrt(2) AS xs FROM cm JOIN sp USING (variable)),
  ps AS (SELECT *, """ + ERFC.format(x="xs") + """ / 2 AS tail FROM zs)""") + """
  SELECT variable, round(max(greatest(hi / n - f, f - (hi - c) / n)), 6) AS ks_statistic_vs_normal FROM (SELECT *, CASE WHEN z < 0 THEN tail ELSE 1 - tail END AS f FROM ps) GROUP BY 1""")
def _(t):
    return rounded(dist.ks_normal(qc.melt(metrics(t), qc.QC_COLUMNS), "value", ["variable"]))
