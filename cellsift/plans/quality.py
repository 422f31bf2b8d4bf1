"""Queries on the matrix: quality control, normalisation, markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.operators import distribution as dist
from cellsift.operators import markers as mk
from cellsift.operators import normalize as nz
from cellsift.operators import qc
from cellsift.plans.inputs import (CELLS, EXPR, FINE, LONG, METRICS, NORM, PATTERNS, cells, matrix, metrics, n_cells,
                                   norm, with_sql)
from cellsift.plans.registry import query
from cellsift.sources import guards


def rounded(df, digits: int = 6, **special):
    """Round the double columns so that both engines agree to the last printed digit."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            out.append((F.round(f.name, special.get(f.name, digits)) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


PCT = {"p1": .01, "p5": .05, "p10": .1, "p25": .25, "p50": .5, "p75": .75, "p90": .9, "p95": .95, "p99": .99}


def describe_sql(table: str, value: str, by: str) -> str:
    """describe() as SQL: population moments from centred powers, linear percentiles."""
    return f"""SELECT {by}, n, sig(mn) AS min, sig(mx) AS max, sig(mu) AS mean, sig(sqrt(m2)) AS std,
  sig(p50) AS median, sig(p75 - p25) AS iqr, sig(sqrt(m2) / nullif(mu, 0)) AS cv, sk AS skewness, ku AS kurtosis,
  CASE WHEN ku + 3 > 0 THEN sig((sk * sk + 1) / (ku + 3)) END AS bimodality, {", ".join(f"sig({p}) AS {p}" for p in PCT)}
  FROM (SELECT *, CASE WHEN m2 > 1e-20 THEN sig(m3 / (m2 * sqrt(m2))) END AS sk,
    CASE WHEN m2 > 1e-20 THEN sig(m4 / (m2 * m2) - 3) END AS ku FROM (
    SELECT {by}, count(*) AS n, min(v) AS mn, max(v) AS mx, max(mu) AS mu, avg((v - mu) ** 2) AS m2,
      avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4,
      {", ".join(f"quantile_cont(v, {q}::DOUBLE) AS {p}" for p, q in PCT.items())}
    FROM (SELECT {by}, {value}::DOUBLE AS v, avg({value}::DOUBLE) OVER (PARTITION BY {by}) AS mu
          FROM {table} WHERE {value} IS NOT NULL) GROUP BY {by}))"""


def sig(sql: str) -> str:
    """Expand sig(x) to six significant digits."""
    out, i = [], 0
    while True:
        j = sql.find("sig(", i)
        if j < 0:
            return "".join(out) + sql[i:]
        depth, k = 1, j + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + f"CAST(printf('%.6g', ({sig(sql[j + 4:k - 1])})::DOUBLE) AS DOUBLE)")
        i = k


@query("describe", sig(with_sql(EXPR, METRICS, LONG) + describe_sql("long", "value", "variable")))
def _(t):
    return dist.describe(qc.melt(metrics(t), qc.QC_COLUMNS), "value", ["variable"]).drop("histogram")


HIST = """SELECT variable, b.bin::INT AS bin, round(lo + b.bin * (hi - lo) / {k}, 6) AS lower,
  round(CASE WHEN b.bin = {k} - 1 THEN hi ELSE lo + (b.bin + 1) * (hi - lo) / {k} END, 6) AS upper, coalesce(h.n, 0) AS n
  FROM (SELECT variable, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1) s
  CROSS JOIN (SELECT range AS bin FROM range({k})) b
  LEFT JOIN (SELECT variable, CASE WHEN hi = lo THEN {k} // 2 ELSE
      CASE WHEN value < lo + g * w THEN g - 1 WHEN g < {k} - 1 AND value >= lo + (g + 1) * w THEN g + 1 ELSE g END END AS bin,
      count(*) AS n FROM (SELECT variable, value, lo, hi, (hi - lo) / {k} AS w,
        least(floor((value - lo) / nullif(hi - lo, 0) * {k}), {k} - 1)::BIGINT AS g
        FROM long JOIN (SELECT variable, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1) USING (variable))
      GROUP BY 1, 2) h USING (variable, bin)"""


@query("histogram", with_sql(EXPR, METRICS, LONG) + HIST.format(k=20))
def _(t):
    return rounded(dist.histogram(qc.melt(metrics(t), qc.QC_COLUMNS), "value", ["variable"]))


@query("qc_plot_table", with_sql(EXPR, METRICS, LONG) + HIST.format(k=50))
def _(t):
    return rounded(dist.histogram(qc.melt(metrics(t), qc.QC_COLUMNS), "value", ["variable"], bins=50))


@query("gini", with_sql(EXPR, METRICS, LONG) + """SELECT variable,
  round((2 * sum(i * value) - (count(*) + 1) * sum(value)) / (count(*) * sum(value)), 6) AS gini
  FROM (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) AS i FROM long) GROUP BY 1""")
def _(t):
    return rounded(dist.gini(qc.melt(metrics(t), qc.QC_COLUMNS), "value", ["variable"]))


@query("entropy", with_sql(CELLS) + """SELECT cluster, round(-sum(p * log2(p)), 6) AS entropy FROM
  (SELECT cluster, n / sum(n) OVER (PARTITION BY cluster) AS p FROM
    (SELECT cluster, batch, count(*) AS n FROM cells GROUP BY 1, 2)) GROUP BY 1""")
def _(t):
    return rounded(dist.entropy(cells(t).groupBy("cluster", "batch").count(), "count", ["cluster"]))


LIMITS = dict(min_genes=15, max_mt=25.0, max_cp=25.0)


@query("filter_funnel", with_sql(EXPR, METRICS) + """SELECT count(*) AS n_before,
  count(*) FILTER (a AND b AND c) AS n_after, round(count(*) FILTER (a AND b AND c) / count(*), 6) AS frac_retained,
  count(*) FILTER (a) AS min_genes_passed, count(*) FILTER (NOT a) AS min_genes_lost,
  count(*) FILTER (b) AS max_mt_passed, count(*) FILTER (a AND NOT b) AS max_mt_lost,
  count(*) FILTER (c) AS max_cp_passed, count(*) FILTER (a AND b AND NOT c) AS max_cp_lost,
  count(*) FILTER (a::INT + b::INT + c::INT <= 1) AS n_lost_multiple,
  round(1 - count(*) FILTER (a AND b AND c) / count(*), 6) AS frac_lost
  FROM (SELECT n_genes >= 15 AS a, pct_mt < 25 AS b, pct_cp < 25 AS c FROM metrics)""")
def _(t):
    return rounded(qc.cell_funnel(metrics(t), **LIMITS))


@query("compact_float", "SELECT o_orderkey, " + sig("sig(o_totalprice * 1.2345)") + " AS compact FROM orders")
def _(t):
    from cellsift.functions.scalars import compact_float

    return t.orders.select("o_orderkey", compact_float(F.col("o_totalprice") * 1.2345).alias("compact"))


@query("flag_features", with_sql(EXPR) + """SELECT DISTINCT gene_id, regexp_matches(gene_id, '^(?:Brand#1)') AS mt,
  regexp_matches(gene_id, '^(?:Brand#2)') AS cp FROM expr""")
def _(t):
    return qc.flag_features(matrix(t).select("gene_id").distinct(), PATTERNS)


@query("qc_metrics", with_sql(EXPR, METRICS) + """SELECT cell_id, n_genes, total_counts, round(pct_mt, 6) AS pct_mt,
  round(pct_cp, 6) AS pct_cp FROM metrics""")
def _(t):
    return rounded(metrics(t))


@query("filter_cells", with_sql(EXPR, METRICS) + """SELECT cell_id, n_genes, total_counts, round(pct_mt, 6) AS pct_mt,
  round(pct_cp, 6) AS pct_cp FROM metrics WHERE n_genes >= 15 AND pct_mt < 25 AND pct_cp < 25""")
def _(t):
    return rounded(qc.filter_cells(metrics(t), **LIMITS))


@query("distribution_shift", sig(with_sql(EXPR, METRICS, """tagged AS (
  SELECT 'pre' AS side, total_counts AS v FROM metrics UNION ALL
  SELECT 'post', total_counts FROM metrics WHERE n_genes >= 15 AND pct_mt < 25 AND pct_cp < 25)""",
  """d AS (""" + describe_sql("tagged", "v", "side") + ")",
  """steps AS (SELECT v, sum(sum((side = 'pre')::INT)) OVER (ORDER BY v) AS a, sum(sum((side = 'post')::INT)) OVER (ORDER BY v) AS b
    FROM tagged GROUP BY v)""") + """SELECT round(max(post.median - pre.median), 6) AS delta_median,
  round(max(post.iqr - pre.iqr), 6) AS delta_iqr, round(max(coalesce(post.skewness, 0) - coalesce(pre.skewness, 0)), 6) AS delta_skewness,
  (SELECT round(max(abs(a / (SELECT max(a) FROM steps) - b / (SELECT max(b) FROM steps))), 6) FROM steps) AS ks_statistic,
  'total_counts' AS variable
  FROM (SELECT * FROM d WHERE side = 'pre') pre, (SELECT * FROM d WHERE side = 'post') post HAVING count(*) > 0"""))
def _(t):
    return rounded(qc.cell_shift(metrics(t), "total_counts", **LIMITS))


@query("ks_two_sample", with_sql(EXPR, METRICS, CELLS, """steps AS (SELECT total_counts AS v,
    sum(sum((cluster = 'BUILDING')::INT)) OVER (ORDER BY total_counts) AS a,
    sum(sum((cluster <> 'BUILDING')::INT)) OVER (ORDER BY total_counts) AS b
    FROM metrics JOIN cells USING (cell_id) GROUP BY 1)""") + """
  SELECT round(max(abs(a / (SELECT max(a) FROM steps) - b / (SELECT max(b) FROM steps))), 6) AS ks_statistic FROM steps""")
def _(t):
    both = metrics(t).join(cells(t), "cell_id")
    building = F.col("cluster") == "BUILDING"
    return rounded(dist.ks_two_sample(both.where(building), both.where(~building), "total_counts"))


@query("qc_distribution")
def _(t):
    return rounded(qc.qc_distribution(metrics(t)).drop("histogram"))


@query("qc_summary", sig(with_sql(EXPR, METRICS, LONG, "d AS (" + describe_sql("long", "value", "variable") + ")",
  """g AS (SELECT variable, (2 * sum(i * value) - (count(*) + 1) * sum(value)) / (count(*) * sum(value)) AS gini
  FROM (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) AS i FROM long) GROUP BY 1)""")
  + "SELECT d.*, round(gini, 6) AS gini FROM d JOIN g USING (variable)"))
def _(t):
    d = qc.qc_summary(metrics(t)).drop("histogram")
    return d.withColumn("gini", F.round("gini", 6))


BREADTH = """breadth AS (SELECT gene_id, count(*) AS n_cells_expr, count(*) / (SELECT count(*) FROM customer) AS breadth,
  gene_id LIKE 'Brand#1%' AS mt, gene_id LIKE 'Brand#2%' AS cp FROM fine WHERE count > 0 GROUP BY 1)"""


def _breadth(t):
    return qc.gene_masks(qc.gene_breadth(matrix(t, fine=True), n_cells(t)), PATTERNS, min_cells=100)


@query("filter_genes", with_sql(FINE, BREADTH) + """SELECT f.cell_id, f.gene_id, f.count FROM fine f JOIN breadth b USING (gene_id)
  WHERE n_cells_expr >= 100 AND NOT mt AND NOT cp""")
def _(t):
    return qc.filter_genes(matrix(t, fine=True), _breadth(t)).select("cell_id", "gene_id", "count")


@query("filter_genes_report", with_sql(FINE, BREADTH) + """SELECT count(*) AS n_before,
  count(*) FILTER (n_cells_expr >= 100 AND NOT mt AND NOT cp) AS n_after,
  round(1 - count(*) FILTER (n_cells_expr >= 100 AND NOT mt AND NOT cp) / count(*), 6) AS frac_lost,
  count(*) FILTER (mt) AS n_mt_removed, count(*) FILTER (cp) AS n_cp_removed,
  count(*) FILTER (n_cells_expr < 100) AS n_removed_by_min_cells,
  count(*) FILTER (breadth < 0.01) AS n_in_lt_1pct_cells FROM breadth""")
def _(t):
    return rounded(qc.gene_report(_breadth(t), PATTERNS, min_cells=100))


@query("normalize_log", with_sql(EXPR, NORM) + "SELECT cell_id, gene_id, count, round(norm, 6) AS norm FROM norm")
def _(t):
    return rounded(norm(t).select("cell_id", "gene_id", "count", "norm"))


@query("normalization_summary", with_sql(EXPR) + """SELECT
  (SELECT quantile_cont(s, 0.5::DOUBLE) FROM (SELECT sum(count)::DOUBLE AS s FROM expr GROUP BY cell_id)) AS median_library_size,
  (SELECT count(*) FROM customer) AS n_cells, count(DISTINCT gene_id) AS n_genes,
  round(1 - count(*) FILTER (count > 0) / ((SELECT count(*) FROM customer) * count(DISTINCT gene_id)), 6) AS frac_zero FROM expr""")
def _(t):
    return rounded(nz.normalization_summary(norm(t), n_cells(t)))


FNORM = NORM.replace("expr", "fine").replace("norm AS (", "fnorm AS (", 1)
HVG = """mom AS (SELECT gene_id, s / n AS mean, (q - n * (s / n) * (s / n)) / (n - 1) AS variance, l / n AS mean_log FROM
    (SELECT gene_id, sum(exp(norm) - 1) AS s, sum((exp(norm) - 1) ** 2) AS q, sum(norm) AS l,
      (SELECT count(*) FROM customer) AS n FROM fnorm GROUP BY 1)),
  sc AS (SELECT *, ln(variance / mean) AS disp, ln(1 + mean) AS lm FROM mom),
  bn AS (SELECT *, greatest(1, least(20, ceil((lm - min(lm) OVER ()) / (max(lm) OVER () - min(lm) OVER ()) * 20))) AS bin FROM sc),
  st AS (SELECT bin, avg(disp) AS m, stddev_samp(disp) AS sd FROM bn GROUP BY 1),
  z AS (SELECT gene_id, mean, variance, disp, (disp - CASE WHEN sd IS NULL THEN 0 ELSE m END) / coalesce(sd, m) AS dn
    FROM bn JOIN st USING (bin)),
  hv AS (SELECT *, row_number() OVER (ORDER BY dn DESC NULLS LAST, gene_id) <= 40 AS highly_variable FROM z)"""


@query("select_variable_genes", with_sql(FINE, FNORM, HVG) + """SELECT gene_id, round(mean, 4) AS mean,
  round(variance, 2) AS variance, round(disp, 6) AS dispersion, round(dn, 6) AS dispersion_norm, highly_variable FROM hv""")
def _(t):
    got = nz.select_variable_genes(norm(t, fine=True), n_cells(t), n_top=40)
    return rounded(got.select("gene_id", "mean", "variance", "dispersion", "dispersion_norm", "highly_variable"), mean=4, variance=2)


@query("variable_summary", with_sql(FINE, FNORM, HVG) + """SELECT count(*) AS n_before, count(*) FILTER (highly_variable) AS n_after,
  round(count(*) FILTER (highly_variable) / count(*), 6) AS frac_kept,
  round(quantile_cont(dn, 0.5::DOUBLE) FILTER (highly_variable) - quantile_cont(dn, 0.5::DOUBLE) FILTER (NOT highly_variable), 6) AS dispersion_gap FROM hv""")
def _(t):
    return rounded(nz.variable_summary(nz.select_variable_genes(norm(t, fine=True), n_cells(t), n_top=40)))


@query("select_variable_genes_by_batch", with_sql(FINE, FNORM, CELLS, """mom AS (SELECT region, gene_id, s / n AS mean,
      (q - n * (s / n) * (s / n)) / (n - 1) AS variance FROM
    (SELECT region, gene_id, sum(exp(norm) - 1) AS s, sum((exp(norm) - 1) ** 2) AS q FROM fnorm JOIN cells USING (cell_id) GROUP BY 1, 2)
    JOIN (SELECT region, count(*) AS n FROM cells GROUP BY 1) USING (region)),
  sc AS (SELECT *, CASE WHEN variance > 0 THEN ln(variance / mean) END AS disp, ln(1 + mean) AS lm FROM mom),
  bn AS (SELECT *, greatest(1, least(20, coalesce(ceil((lm - min(lm) OVER w) / nullif(max(lm) OVER w - min(lm) OVER w, 0) * 20), 1))) AS bin
    FROM sc WINDOW w AS (PARTITION BY region)),
  z AS (SELECT region, gene_id, (disp - CASE WHEN sd IS NULL THEN 0 ELSE m END) / coalesce(sd, m) AS dn FROM bn
    JOIN (SELECT region, bin, avg(disp) AS m, stddev_samp(disp) AS sd FROM bn GROUP BY 1, 2) USING (region, bin)),
  pk AS (SELECT gene_id, count(*) AS nb FROM (SELECT gene_id, row_number() OVER (PARTITION BY region ORDER BY dn DESC NULLS LAST, gene_id) AS r FROM z)
    WHERE r <= 40 GROUP BY 1),
  mg AS (SELECT gene_id, sum(coalesce(dn, 0)) / (SELECT count(DISTINCT region) FROM cells) AS dispersion_norm FROM z GROUP BY 1)""") + """
  SELECT gene_id, round(dispersion_norm, 6) AS dispersion_norm, coalesce(nb, 0) AS n_batches,
  row_number() OVER (ORDER BY coalesce(nb, 0) DESC, dispersion_norm DESC, gene_id) <= 40 AS highly_variable
  FROM mg LEFT JOIN pk USING (gene_id)""")
def _(t):
    return rounded(nz.select_variable_genes_by_batch(norm(t, fine=True), cells(t), "region", n_top=40))


@query("scale_clip", with_sql(EXPR, NORM, """st AS (SELECT gene_id, s / n AS mean, sqrt(greatest((q - n * (s / n) * (s / n)) / (n - 1), 0)) AS sd FROM
  (SELECT gene_id, sum(norm) AS s, sum(norm * norm) AS q, (SELECT count(*) FROM customer) AS n FROM norm GROUP BY 1))""") + """
  SELECT cell_id, gene_id, round(least((norm - mean) / sd, 1.5), 6) AS scaled, round(least(-mean / sd, 1.5), 6) AS zero_scaled
  FROM norm JOIN st USING (gene_id)""")
def _(t):
    got = nz.scale_clip(norm(t), n_cells(t), max_value=1.5)
    return rounded(got.select("cell_id", "gene_id", "scaled", "zero_scaled"))


# Ranks of the full grid, zeros included, written out; Spark never builds this grid.
STATS = """grid AS (SELECT c.cell_id, c.cluster, g.gene_id, coalesce(x.norm, 0) AS v FROM cells c
    CROSS JOIN (SELECT DISTINCT gene_id FROM expr) g LEFT JOIN norm x ON x.cell_id = c.cell_id AND x.gene_id = g.gene_id),
  rk AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY v) + (count(*) OVER (PARTITION BY gene_id, v) - 1) / 2 AS r FROM grid),
  tot AS (SELECT gene_id, count(*) AS n, count(*) FILTER (v > 0) AS nz, sum(v) AS s, sum(v * v) AS q FROM grid GROUP BY 1),
  st AS (SELECT cluster, gene_id, count(*) AS n_in, any_value(n) - count(*) AS n_out, count(*) FILTER (v > 0) AS nnz_in,
      any_value(nz) - count(*) FILTER (v > 0) AS nnz_out, sum(v) AS sum_in, any_value(s) - sum(v) AS sum_out,
      sum(v * v) AS sq_in, any_value(q) - sum(v * v) AS sq_out, sum(r) AS rank_sum
    FROM rk JOIN tot USING (gene_id) GROUP BY 1, 2)"""
DE = STATS + """,
  sco AS (SELECT *, (rank_sum - n_in * (n_in + n_out + 1) / 2) / sqrt(n_in::DOUBLE * n_out * (n_in + n_out + 1) / 12) AS score,
      log2((exp(sum_in / n_in) - 1 + 1e-9) / (exp(sum_out / n_out) - 1 + 1e-9)) AS logfc,
      (rank_sum / n_in - (n_in + 1) / 2) / n_out AS auc, nnz_in / n_in AS pct1, nnz_out / n_out AS pct2 FROM st),
  de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, gene_id) AS rank FROM sco) WHERE rank <= 20)"""
MATRIX = with_sql(EXPR, NORM, CELLS, DE)


# The same without the cut: summaries read every tested gene.
DE_ALL = DE.replace(" WHERE rank <= 20", "")


def _de(t, top=20):
    return mk.rank_genes(norm(t), cells(t), top=top)


def _stats(t):
    return mk.gene_cluster_stats(norm(t), cells(t))


@query("gene_cluster_stats", MATRIX + """SELECT cluster, gene_id, n_in, n_out, nnz_in, nnz_out, round(sum_in, 4) AS sum_in,
  round(sum_out, 4) AS sum_out, round(sq_in, 3) AS sq_in, round(sq_out, 3) AS sq_out, round(rank_sum, 1) AS rank_sum FROM st""")
def _(t):
    return rounded(_stats(t), sum_in=4, sum_out=4, sq_in=3, sq_out=3, rank_sum=1)


@query("rank_genes", MATRIX + """SELECT cluster, gene_id, rank, round(score, 6) AS score, round(logfc, 6) AS logfc, round(auc, 6) AS auc,
  round(pct1, 6) AS pct1, round(pct2, 6) AS pct2, round(pct1 - pct2, 6) AS pct1_minus_pct2 FROM de""")
def _(t):
    return rounded(_de(t).drop("pval", "pval_adj"))


@query("gene_auc", MATRIX + "SELECT cluster, gene_id, round(auc, 6) AS auc FROM sco")
def _(t):
    return rounded(mk.gene_auc(_stats(t)).select("cluster", "gene_id", "auc"))


@query("pct_in_out", MATRIX + """SELECT cluster, gene_id, round(pct1, 6) AS pct1, round(pct2, 6) AS pct2,
  round(pct1 - pct2, 6) AS pct1_minus_pct2 FROM sco""")
def _(t):
    return rounded(mk.pct_in_out(_stats(t)).select("cluster", "gene_id", "pct1", "pct2", "pct1_minus_pct2"))


EFFECT = """eff AS (SELECT *, (mean_in - mean_out) / pool AS cohen_d FROM (SELECT *, sum_in / n_in AS mean_in, sum_out / n_out AS mean_out,
  sqrt((greatest(sq_in / n_in - (sum_in / n_in) ** 2, 0) + greatest(sq_out / n_out - (sum_out / n_out) ** 2, 0)) / 2) AS pool FROM sco))"""


@query("effect_size", with_sql(EXPR, NORM, CELLS, DE, EFFECT) + """SELECT cluster, gene_id, round(mean_in, 6) AS mean_in,
  round(mean_out, 6) AS mean_out, round(cohen_d, 6) AS cohen_d, round(auc, 6) AS auc, round(mean_in / greatest(mean_out, 1e-6), 6) AS fold_change,
  round(log2((mean_in + 1) / (mean_out + 1)), 6) AS log_ratio FROM eff""")
def _(t):
    return rounded(mk.effect_size(_stats(t)).select(
        "cluster", "gene_id", "mean_in", "mean_out", "cohen_d", "auc", "fold_change", "log_ratio"))


@query("bh_fdr", """WITH p AS (SELECT o_orderpriority AS grp, o_orderkey AS id, (o_totalprice - floor(o_totalprice / 1000) * 1000) / 1000 AS p FROM orders),
  q AS (SELECT *, p * count(*) OVER (PARTITION BY grp) / row_number() OVER (PARTITION BY grp ORDER BY p, id) AS q FROM p)
  SELECT grp, id, round(p, 6) AS p, round(least(min(q) OVER (PARTITION BY grp ORDER BY p DESC, id DESC), 1), 6) AS pval_adj FROM q""")
def _(t):
    p = t.orders.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"),
                        F.expr("(o_totalprice - floor(o_totalprice / 1000) * 1000) / 1000").alias("p"))
    return rounded(mk.bh_fdr(p, "p", ["grp"], "id"))


# The chi-square of a two-sided p is the square of its score; p is 1 at score 0 and 0 beyond 38.
@query("inflation_lambda", with_sql(EXPR, NORM, CELLS, DE_ALL) + f"""SELECT cluster, round(median(score * score) / {mk.MEDIAN_CHI2_1}, 6) AS inflation_lambda
  FROM de WHERE score <> 0 AND abs(score) < 38 GROUP BY 1""")
def _(t):
    return rounded(mk.inflation_lambda(_de(t, None)))


@query("pct_summary", sig(with_sql(EXPR, NORM, CELLS, DE_ALL, """lg AS (SELECT cluster || '|' || variable AS k, cluster, variable, value FROM
    (SELECT cluster, pct1, pct2, pct1 - pct2 AS pct1_minus_pct2 FROM de) UNPIVOT (value FOR variable IN (pct1, pct2, pct1_minus_pct2)))""",
  "d AS (" + describe_sql("lg", "value", "k") + ")") + """
  SELECT split_part(k, '|', 1) AS cluster, split_part(k, '|', 2) AS variable, n, mean, std, median,
  (SELECT round(avg(pct1 - pct2), 6) FROM de WHERE de.cluster = split_part(k, '|', 1) AND rank <= 50) AS mean_specificity_of_top FROM d"""))
def _(t):
    d = mk.pct_summary(_de(t, None)).select("cluster", "variable", "n", "mean", "std", "median", "mean_specificity_of_top")
    return d.withColumn("mean_specificity_of_top", F.round("mean_specificity_of_top", 6))


MARKED = """fm AS (SELECT *, CASE WHEN a AND b AND c THEN 'kept' WHEN d >= 0.005 AND d < 0.01 THEN 'grey' ELSE 'dropped' END AS status FROM
    (SELECT *, pct1 - pct2 AS d, pct1 >= 0.5 AS a, pct1 <= 0.95 AS b, pct1 - pct2 >= 0.01 AS c FROM de)),
  mk AS (SELECT *, CASE WHEN status = 'kept' AND k <= 6 THEN k END AS marker_rank FROM
    (SELECT *, row_number() OVER (PARTITION BY cluster, status ORDER BY rank) AS k FROM fm))"""
LOOSE = dict(min_pct1=0.5, max_pct1=0.95, min_diff=0.01, top_n=6)


def markers(t):
    return mk.filter_markers(_de(t), **LOOSE)


@query("filter_markers", with_sql(EXPR, NORM, CELLS, DE, MARKED.replace("d >= 0.005", "d >= 0.1")) + """SELECT cluster, gene_id, rank, status, marker_rank FROM mk""")
def _(t):
    return markers(t).select("cluster", "gene_id", "rank", "status", "marker_rank")


@query("marker_report", with_sql(EXPR, NORM, CELLS, DE, MARKED.replace("d >= 0.005", "d >= 0.1")) + """SELECT cluster, count(*) AS n_before,
  count(*) FILTER (a) AS pct1_min_passed, count(*) FILTER (a AND b) AS pct1_max_left, count(*) FILTER (status = 'kept') AS n_passed,
  count(marker_rank) AS n_markers, count(*) FILTER (status = 'grey') AS n_grey, round(count(marker_rank) / count(*), 6) AS filter_efficiency,
  round(count(*) FILTER (status = 'grey') / count(*), 6) AS grey_rate,
  any_value(n_in) / (SELECT count(*) FROM customer) < 0.05 AS is_rare FROM mk GROUP BY 1""")
def _(t):
    return rounded(mk.marker_report(markers(t), cells(t)))


@query("marker_expression", with_sql(EXPR, NORM, CELLS, DE, EFFECT, MARKED.replace("d >= 0.005", "d >= 0.1")) + """SELECT cluster, gene_id, mk.marker_rank,
  round(eff.pct1, 6) AS pct1, round(eff.pct2, 6) AS pct2, round(eff.pct1 - eff.pct2, 6) AS specificity, round(mean_in, 6) AS mean_expr,
  round(mean_out, 6) AS mean_expr_other, round(mean_in / greatest(mean_out, 1e-6), 6) AS expression_ratio, round(cohen_d, 6) AS cohen_d,
  round(eff.auc, 6) AS auc, round(mean_in / greatest(mean_out, 1e-6), 6) AS fold_change, round(log2((mean_in + 1) / (mean_out + 1)), 6) AS log_ratio
  FROM mk JOIN eff USING (cluster, gene_id) WHERE mk.marker_rank <= 3""")
def _(t):
    return rounded(mk.marker_expression(_stats(t), markers(t)))


@query("marker_expression_summary", with_sql(EXPR, NORM, CELLS, DE, MARKED.replace("d >= 0.005", "d >= 0.1")) + """SELECT cluster,
  round(avg(pct1), 6) AS mean_top_pct1, round(avg(d), 6) AS mean_top_specificity, round(avg((pct1 > 0.5)::INT), 6) AS frac_pct1_above_half
  FROM mk WHERE marker_rank <= 3 GROUP BY 1""")
def _(t):
    return rounded(mk.marker_expression_summary(mk.marker_expression(_stats(t), markers(t))))


@query("violin_table", with_sql(EXPR, NORM, CELLS, DE, MARKED.replace("d >= 0.005", "d >= 0.1")) + """
  SELECT gene_id, cluster, count(*) AS n, round(quantile_cont(v::DOUBLE, 0.25::DOUBLE), 6) AS p25,
  round(quantile_cont(v::DOUBLE, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(v::DOUBLE, 0.75::DOUBLE), 6) AS p75
  FROM grid WHERE v > 0 AND gene_id IN (SELECT gene_id FROM mk WHERE marker_rank <= 3) GROUP BY 1, 2""")
def _(t):
    top = markers(t).where("marker_rank <= 3").select("gene_id").distinct()
    shown = norm(t).join(top, "gene_id", "left_semi").join(cells(t), "cell_id")
    return rounded(dist.describe(shown, "norm", ["gene_id", "cluster"], compact=False).select(
        "gene_id", "cluster", "n", "p25", "p50", "p75"))


PB = """cnt AS (SELECT cluster, region AS s, gene_id, sum(count) AS x FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2, 3),
  allp AS (SELECT cl.cluster, sg.s, sg.gene_id, coalesce(c.x, 0) AS i, sg.x - coalesce(c.x, 0) AS o FROM (SELECT DISTINCT cluster FROM cells) cl
    CROSS JOIN (SELECT s, gene_id, sum(x) AS x FROM cnt GROUP BY 1, 2) sg LEFT JOIN cnt c ON c.cluster = cl.cluster AND c.s = sg.s AND c.gene_id = sg.gene_id),
  lg AS (SELECT cluster, s, gene_id, ln(1 + i / (sum(i) OVER w + 1e-9) * 1e6) AS a, ln(1 + o / (sum(o) OVER w + 1e-9) * 1e6) AS b
    FROM allp WINDOW w AS (PARTITION BY cluster, s)),
  ag AS (SELECT cluster, gene_id, avg(a) - avg(b) AS logfc, var_samp(a) / count(*) AS va, var_samp(b) / count(*) AS vb, count(*) AS k FROM lg GROUP BY 1, 2)"""


@query("pseudobulk_de", with_sql(EXPR, CELLS, PB) + """SELECT cluster, gene_id, round(logfc, 6) AS logfc, round(logfc / sqrt(va + vb), 6) AS t,
  round((va + vb) ** 2 / (va * va / (k - 1) + vb * vb / (k - 1)), 6) AS df, k AS n_samples FROM ag""")
def _(t):
    got = mk.pseudobulk_de(matrix(t), cells(t), sample="region")
    return rounded(got.select("cluster", "gene_id", "logfc", "t", "df", "n_samples"))


@query("merge_pseudobulk")
def _(t):
    pb = mk.pseudobulk_de(matrix(t), cells(t), sample="region", rare_threshold=0.2)
    return rounded(mk.merge_pseudobulk(_de(t, None), pb))


@query("check_matrix", with_sql(EXPR) + """SELECT bool_and(try_cast(gene_id AS DOUBLE) IS NOT NULL) AS all_numeric_genes,
  sum(count) AS total, count(*) AS n_entries, count(DISTINCT cell_id) AS n_cells, count(DISTINCT gene_id) AS n_genes FROM expr""")
def _(t):
    return guards.matrix_facts(matrix(t))
