"""Readers for the file formats, and parsers for text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cellsift.session import durable

from cellsift.functions.fixed import ORTHOLOG_TYPES
from cellsift.functions.scalars import strip_seq_id

BAD = "_bad"

LOG_SCHEMA = (
    "ts string, seq bigint, type string, session_id string, run_id string, parameters string, metrics string, "
    "decision_point string, scope struct<type:string,cluster_id:string>, run_ref string, "
    "inputs array<struct<path:string,value:string>>, output struct<decision:string,confidence:string,action:string>, "
    "reasoning string, final_summary string"
)
CONVERSATION_SCHEMA = (
    "role string, content string, tool_call_id string, tool_calls array<struct<id:string,name:string,args:string>>"
)
NOTE_SCHEMA = "note_id string, ts string, session_id string, project_id string, tags array<string>, content string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per non-blank line; a line that is no JSON keeps its text in ``_bad``."""
    full = T._parse_datatype_string(schema).add(BAD, T.StringType())
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file")).where(F.trim("value") != "")
    return lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": BAD}).alias("j"), "_file").select("j.*", "_file")


def split_bad(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines)."""
    return rows.where(F.col(BAD).isNull()).drop(BAD, "_file"), rows.where(F.col(BAD).isNotNull()).select(BAD)


def count_bad(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col(BAD).isNull()).alias("n_rows"), F.count_if(F.col(BAD).isNotNull()).alias("n_bad"))


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Adds the place of each row, from 1, over all files in the order of their names.

    ``rows`` must come straight from a file reader. Rows are counted per block of a file; a block bounds what a task orders.
    """
    placed = durable(rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")))
    blocks = placed.groupBy("_path", "_block").agg(F.count("*").alias("_n"))
    before = blocks.select("_path", "_block", F.coalesce(F.sum("_n").over(W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_path", "_block").orderBy("_row"))
    return placed.withColumn("_nth", nth).join(before, ["_path", "_block"]).withColumn(out, F.col("_before") + F.col("_nth")).drop("_path", "_block", "_row", "_nth", "_before")


def _log_lines(spark: SparkSession, path: str, run: str | None) -> DataFrame:
    full = T._parse_datatype_string(LOG_SCHEMA).add(BAD, T.StringType())
    text = spark.read.text(path)
    lines = numbered(text.withColumn("_file", F.col("_metadata.file_path")), "line").where(F.trim("value") != "")
    name = F.lit(run) if run else F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
    return lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": BAD}).alias("j"), name.alias("run"), "line").select("j.*", "run", "line")


def read_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Run log rows with ``run`` (the file's folder unless named) and ``line``, their place in the files (blank lines count)."""
    return _log_lines(spark, path, run).where(F.col(BAD).isNull()).drop(BAD)


def bad_log_lines(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """(run, line, level, message) of the lines that are no JSON, in the form of ``validate_log``'s issues."""
    return _log_lines(spark, path, run).where(F.col(BAD).isNotNull()).select("run", "line", F.lit("error").alias("level"), F.lit("line is no JSON").alias("message"))


def read_conversation(spark: SparkSession, path: str) -> DataFrame:
    """Messages; an assistant message without text has the empty text."""
    good, _ = split_bad(read_jsonl(spark, path, CONVERSATION_SCHEMA))
    return good.withColumn("content", F.when((F.col("role") == "assistant") & F.col("content").isNull(), "").otherwise(F.col("content")))


def read_ground_truth(spark: SparkSession, path: str, expected_n: int | None = None) -> DataFrame:
    """(cell_id, true_type) from the first and third column of a CSV with header.

    Rows without barcode are skipped; a short row or blank type is an error, and so
    is another row count than the expected one.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if len(raw.columns) < 3:
        raise ValueError("ground truth needs at least three columns")
    key, kind = raw.columns[0], raw.columns[2]
    rows = raw.select(F.trim(F.col(f"`{key}`")).alias("cell_id"), F.trim(F.col(f"`{kind}`")).alias("true_type")).where("coalesce(cell_id, '') <> ''")
    checked = rows.withColumn("true_type", F.when(F.coalesce("true_type", F.lit("")) != "", F.col("true_type")).otherwise(
        F.raise_error(F.concat(F.lit("no cell type for "), "cell_id"))))
    if expected_n is not None:
        n = rows.count()
        if n != expected_n:
            raise ValueError(f"ground truth holds {n} cells, expected {expected_n}")
    return checked


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Trimmed keys, blank ones dropped; the last row of a key wins."""
    others = [c for c in rows.columns if c not in (key, order)]
    return (
        rows.withColumn(key, F.trim(key)).where(F.coalesce(key, F.lit("")) != "")
        .groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")
    )


def read_keyed_csv(spark: SparkSession, path: str, key: str, required: list[str]) -> DataFrame:
    """CSV with header as a map: last row per key wins, required columns must be there."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    # Position in the input: file, then the order of rows within it.
    return last_per_key(numbered(raw, "_o"), key, "_o")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(position, header, sequence); a record starts at a line that begins with '>'."""
    text = numbered(spark.read.option("lineSep", "\n>").text(path), "position")
    parts = F.split(F.regexp_replace("value", "^>", ""), "\n", 2)
    return text.select(
        "position", F.regexp_replace(parts[0], r"\r$", "").alias("header"),
        F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"[\r\n]", "").alias("sequence"),
    ).where("header <> '' OR sequence <> ''")


def filter_fasta(fasta: DataFrame, var: DataFrame, markers: DataFrame) -> DataFrame:
    """First sequence of every id that is both in the gene table and among the markers.

    Of several records with one id the first is found by aggregation, so an id that
    repeats very often is merged before the shuffle.
    """
    named = fasta.withColumn("gene", strip_seq_id("header"))
    kept = named.join(var.select("gene").distinct(), "gene", "left_semi").join(markers.select("gene").distinct(), "gene", "left_semi")
    return kept.groupBy("gene").agg(F.min("position").alias("position"), F.min_by("sequence", "position").alias("sequence"))


def fasta_metrics(fasta: DataFrame, var: DataFrame, markers: DataFrame) -> DataFrame:
    """n_fasta, n_in_var, n_kept and a warning when sequences were dropped."""
    named = fasta.withColumn("gene", strip_seq_id("header")).join(
        var.select("gene").distinct().withColumn("_v", F.lit(True)), "gene", "left").join(
        markers.select("gene").distinct().withColumn("_m", F.lit(True)), "gene", "left")
    return named.agg(
        F.count("*").alias("n_fasta"), F.count("_v").alias("n_in_var"),
        F.count_distinct(F.when(F.col("_v") & F.col("_m"), F.col("gene"))).alias("n_kept"),
    ).withColumn("warning", F.when(F.col("n_fasta") > F.col("n_in_var"), F.concat((F.col("n_fasta") - F.col("n_in_var")).cast("string"), F.lit(" sequences are not in the gene table"))))


def write_fasta(kept: DataFrame, path: str) -> None:
    """Kept records as FASTA text, in file order."""
    kept.orderBy("position").select(F.concat(F.lit(">"), "gene", F.lit("\n"), "sequence").alias("value")).write.mode("overwrite").text(path)


def parse_blast_tabular(lines: DataFrame, ref_species: str, column: str = "value") -> DataFrame:
    """Mapping records from tab-separated alignment rows.

    Blank and comment lines, short rows and rows without numbers are skipped.
    """
    f = F.split(F.trim(column), "\t")
    rows = (
        lines.where((F.trim(column) != "") & ~F.trim(column).startswith("#") & (F.size(f) >= 5))
        .select(f[0].alias("gene"), f[1].alias("_s"), f[2].try_cast("double").alias("score"), f[3].try_cast("double").alias("bitscore"), f[4].alias("evalue"))
        .where("score IS NOT NULL AND bitscore IS NOT NULL")
    )
    # Row counts are joined back, not windowed: a query with very many rows stays spread.
    counts = rows.groupBy("gene").agg(F.count("*").alias("_n"))
    return rows.join(counts, "gene").select(
        "gene", F.lit(ref_species).alias("ref_species"), strip_seq_id("_s").alias("ref_gene"), "score",
        F.lit("percent_identity").alias("score_type"), F.when(F.col("_n") == 1, "blastp_top_hit").otherwise("blastp_multiple_hits").alias("mapping_type"),
        F.lit(None).cast("double").alias("confidence"),
        F.create_map(F.lit("qseqid"), F.col("gene"), F.lit("sseqid"), F.col("_s"), F.lit("bitscore"), F.col("bitscore").cast("string"), F.lit("evalue"), F.col("evalue")).alias("raw"))


_HOMOLOGY = "array<struct<type:string,dn_ds:string,taxonomy_level:string,target:struct<id:string,species:string,perc_id:string,perc_pos:string,protein_id:string,cigar_line:string>>>"


def parse_homology_json(bodies: DataFrame, ref_species: str | None = None, column: str = "body") -> DataFrame:
    """Mapping records from homology answers: an object with data, a list, or bare homologies.

    Only orthologs with a numeric percentage are kept. The input has a ``gene`` column.
    """
    body = F.col(column)
    found = F.coalesce(
        F.get_json_object(body, "$.data[0].homologies"), F.get_json_object(body, "$[0].homologies"), F.get_json_object(body, "$.homologies"))
    one = bodies.select("gene", F.explode(F.from_json(found, _HOMOLOGY)).alias("h")).select("gene", "h.*")
    score = F.col("target.perc_id").try_cast("double")
    return one.where(F.col("type").isin(ORTHOLOG_TYPES) & score.isNotNull()).select(
        "gene", F.coalesce(F.nullif("target.species", F.lit("")), F.lit(ref_species)).alias("ref_species"), F.coalesce("target.id", F.lit("")).alias("ref_gene"),
        score.alias("score"), F.lit("percent_identity").alias("score_type"), F.regexp_replace("type", "^ortholog_", "ensembl_").alias("mapping_type"),
        F.lit(None).cast("double").alias("confidence"),
        F.map_filter(
            F.create_map(
                F.lit("ensembl_type"), F.col("type"), F.lit("perc_pos"), F.col("target.perc_pos"), F.lit("protein_id"), F.col("target.protein_id"),
                F.lit("cigar_line"), F.col("target.cigar_line"), F.lit("dn_ds"), F.col("dn_ds"), F.lit("taxonomy_level"), F.col("taxonomy_level")),
            lambda k, v: v.isNotNull()).alias("raw"))


def _document(spark: SparkSession, path: str) -> DataFrame | None:
    """One row with the JSON document of a file as ``doc``; None where there is no file."""
    try:
        rows = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
        return None if rows.isEmpty() else rows
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _entries(doc: DataFrame, *keys: str) -> DataFrame:
    """(key, value) of the object under the first of ``keys`` that the document has; the whole document for key ``$``."""
    inner = F.coalesce(*[F.col("doc") if k == "$" else F.try_variant_get("doc", f"$.{k}", "variant") for k in keys])
    return doc.select(inner.alias("_in")).lateralJoin(doc.sparkSession.tvf.variant_explode(F.col("_in").outer())).select("key", "value")


def _texts(doc: DataFrame, key: str) -> list[str]:
    """A short list of texts under a key."""
    return list(doc.select(F.try_variant_get("doc", f"$.{key}", "array<string>")).first()[0] or [])


def load_ortholog_map(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """((gene, ref_species, ref_gene, score), references, warnings); a missing file is empty with a warning.

    The map may stand under either of two keys, and a reference gene under either of two fields.
    """
    doc = _document(spark, path)
    if doc is None:
        return spark.createDataFrame([], "gene string, ref_species string, ref_gene string, score double"), [], [f"ortholog map not readable: {path}"]
    listed = _entries(doc, "cross_species_map", "ortholog_map").withColumnRenamed("key", "gene")
    records = listed.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("value").alias("r")))
    field = lambda name, kind="string": F.try_variant_get("r", f"$.{name}", kind)
    pairs = records.select("gene", field("ref_species").alias("ref_species"), F.coalesce(field("ref_gene_id"), field("ref_gene")).alias("ref_gene"), field("score", "double").alias("score"))
    return pairs, _texts(doc, "reference_species"), _texts(doc, "warnings")


_ENTRY = "struct<label:string,confidence:string,status:string>"


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, label, confidence, status); a cluster that lacks one of them is an error."""
    doc = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.annotations"), F.col("value"))
    rows = doc.select(F.explode(F.from_json(inner, f"map<string,{_ENTRY}>")).alias("cluster", "e")).select("cluster", "e.*")
    blank = [r["cluster"] for r in rows.where("coalesce(label, '') = '' OR coalesce(confidence, '') = '' OR coalesce(status, '') = ''").limit(10).collect()]
    if blank:
        raise ValueError(f"clusters {blank} have no label, confidence or status; a judgement must write them")
    if rows.isEmpty():
        raise ValueError("no annotated cluster")
    return rows


def _text_map(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True)
    inner = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in keys])
    return doc.select(F.explode(F.from_json(inner, "map<string,string>")).alias("k", "v")).where("trim(coalesce(v, '')) <> ''").select("k", F.trim("v").alias("v"))


def load_pins(spark: SparkSession, path: str) -> DataFrame:
    """(label, node) under pins or gt_ontology; null and blank nodes are dropped."""
    return _text_map(spark, path, "pins", "gt_ontology").toDF("label", "node")


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    return _text_map(spark, path, "aliases").toDF("alias", "node")


def read_markers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(flat rows, kept markers per cluster) of ``write_markers``; the kinds are stated, as no file may hold a row."""
    flat = spark.read.schema("cluster string, gene_id string, logfc double, pval double, pval_adj double, auc double, pct1 double, pct2 double, "
                             "pct1_minus_pct2 double, status string").option("header", True).csv(f"{folder}/markers_csv")
    return flat, spark.read.schema("cluster string, markers array<struct<gene_id:string,marker_rank:int>>").json(f"{folder}/markers_json")
