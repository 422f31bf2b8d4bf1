"""Writers for the step artifacts, and the Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.functions.scalars import cluster_order
from cellsift.operators.runlog import append_rows

MARKER_COLUMNS = ["cluster", "gene_id", "logfc", "pval", "pval_adj", "auc", "pct1", "pct2", "pct1_minus_pct2", "status"]


def write_prepared(folder: str, obs: DataFrame, var: DataFrame, expr: DataFrame, metrics: DataFrame | None = None) -> None:
    """Cell table, gene table, matrix (sorted by gene within files) and metrics as parquet."""
    obs.write.mode("overwrite").parquet(f"{folder}/obs")
    var.write.mode("overwrite").parquet(f"{folder}/var")
    expr.sortWithinPartitions("gene_id").write.mode("overwrite").parquet(f"{folder}/expr")
    if metrics is not None:
        metrics.write.mode("overwrite").json(f"{folder}/qc_metrics")


def write_bucketed(folder: str, name: str, rows: DataFrame, key: str, buckets: int = 16) -> DataFrame:
    """A table of the catalog, bucketed and sorted by ``key``: two of them with as many buckets join without a shuffle.

    Returns the table. Its files lie in ``folder``; a table of that name is replaced.
    """
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    # One file a bucket and task: rows are dealt by the key first.
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{name}").saveAsTable(name)
    return spark.table(name)


def write_markers(folder: str, markers: DataFrame) -> None:
    """Flat CSV, and one JSON document per cluster with its kept markers.

    Kept markers are at most top_n per cluster, so a document is small.
    """
    markers.select(MARKER_COLUMNS).write.mode("overwrite").option("header", True).csv(f"{folder}/markers_csv")
    nest(markers.where("marker_rank IS NOT NULL"), "cluster", "markers", "marker_rank").write.mode("overwrite").json(f"{folder}/markers_json")


def nest(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """One row per key with its (few) rows as an ordered array of structs."""
    others = [c for c in rows.columns if c != key and not c.startswith("_")]
    packed = F.struct(F.col(order).alias("_o"), F.struct(*others).alias("_v"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda s: s["_v"]).alias(name))


def write_documents(folder: str, name: str, rows: DataFrame) -> None:
    """hits, annotations, refined, final or diagnosis: one JSON document per row."""
    rows.write.mode("overwrite").json(f"{folder}/{name}")


def write_marker_dict(folder: str, gene_types: DataFrame, coverage: DataFrame) -> None:
    gene_types.write.mode("overwrite").json(f"{folder}/gene_to_types")
    coverage.write.mode("overwrite").json(f"{folder}/coverage")


def append_log(path: str, log: DataFrame, rows: DataFrame) -> None:
    """Append rows to a log folder, partitioned by run, with UTC time and the next seqs."""
    append_rows(log, rows).drop("line").write.mode("append").partitionBy("run").json(path)


def write_conversation(path: str, messages: DataFrame, append: bool = False) -> None:
    messages.write.mode("append" if append else "overwrite").json(path)


def _num(c: str, digits: int = 2):
    return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))).otherwise("None")


def annotation_report(entries: DataFrame, top_rows: DataFrame | None = None, meta: dict | None = None) -> DataFrame:
    """(section, value): header and one Markdown section per cluster, numeric ids first.

    ``entries``: cluster, label, confidence, first_type, first_count, first_confidence,
    second_type, second_count, count_ratio, count_diff, outcome, n_subclusters.
    """
    meta = meta or {}
    lines = [
        F.concat(F.lit("## cluster "), "cluster", F.lit(" - "), F.coalesce("label", F.lit("(judgment pending)")), F.lit(" (confidence "),
                 F.coalesce("confidence", F.lit("n/a")), F.lit(")")),
        F.when(F.col("first_type").isNotNull(), F.concat(F.lit("- first: "), "first_type", F.format_string(" (marker_count=%d, conf=%s)", "first_count", _num("first_confidence", 4)))),
        F.when(F.col("second_type").isNotNull(), F.concat(F.lit("- second: "), "second_type", F.format_string(" (marker_count=%d)", "second_count"))),
        F.concat(F.lit("- count_ratio: "), _num("count_ratio"), F.lit("  count_diff: "), F.coalesce(F.col("count_diff").cast("string"), F.lit("None"))),
    ]
    rows = entries
    if top_rows is not None:
        text = F.concat(F.lit("  - "), "gene_id", F.lit(": pct1="), _num("pct1"), F.lit(" pct2="), _num("pct2"), F.lit(" cohen_d="), _num("cohen_d"), F.lit(" auc="), _num("auc", 3))
        # A cluster shows its few top markers only.
        shown = top_rows.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("marker_rank", text.alias("t")))), lambda s: s["t"]), "\n").alias("_m"))
        rows = rows.join(shown, "cluster", "left")
        lines.append(F.col("_m"))
    if "outcome" in entries.columns:
        lines.append(F.when(F.col("outcome").isNotNull(), F.concat(F.lit("- refine: "), "outcome", F.lit(" subclusters="), F.coalesce(F.col("n_subclusters").cast("string"), F.lit("None")))))
    body = rows.select("cluster", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))
    head = entries.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "unknown").alias("u")).select(
        F.lit(None).cast("string").alias("cluster"),
        F.concat(F.lit("# Cell type annotation report\n\n- dataset: " + str(meta.get("dataset", "?")) + "  organ: " + str(meta.get("organ", "?")) + "\n- graph: " + str(meta.get("kg_source", "?")) + "  date: " + str(meta.get("date", "?")) + "\n- clusters: "),
                 F.col("n").cast("string"), F.lit("  unknown: "), F.col("u").cast("string"), F.lit("\n")).alias("value"))
    return _ordered(head, body)


def _ordered(head: DataFrame, body: DataFrame) -> DataFrame:
    both = head.withColumn("_part", F.lit(0)).unionByName(body.withColumn("_part", F.lit(1)))
    return both.orderBy("_part", *cluster_order("cluster")).select("cluster", "value")


def diagnosis_report(diagnosis: DataFrame, missing: DataFrame) -> DataFrame:
    """(cluster, value): the diagnosis table as Markdown lines, then the missing fields."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "cluster", _num("hit_rate"), F.col("n_candidates").cast("string"), F.col("first_count").cast("string"),
                                            F.col("second_count").cast("string"), F.col("strictly_ahead").cast("string"), _num("batch_entropy")), F.lit(" |"))
    body = diagnosis.select("cluster", row.alias("value"))
    names = F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_list("field")), ", "), F.lit("")), F.lit("none"))
    head = missing.agg(F.concat(F.lit("# Diagnosis report\n\n- missing metadata: "), names, F.lit(
        "\n\n| cluster | hit rate | candidates | first | second | strictly ahead | batch entropy |\n|---|---|---|---|---|---|---|")).alias("value")).select(
        F.lit(None).cast("string").alias("cluster"), "value")
    return _ordered(head, body)


def write_report(report: DataFrame, path: str) -> None:
    """Report lines in order; a report has one row per cluster, so one file holds it."""
    report.select("value").coalesce(1).write.mode("overwrite").text(path)
