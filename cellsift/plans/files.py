"""Queries that write the tables out in a file format and read them back, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.plans.inputs import CELLS, CG, EXPR, HITS, NORM, ORTH, ROWS, cells, kg_relation, matrix, run_log, with_sql
from cellsift.plans.knowledge import DICT, RANKED, candidates
from cellsift.plans.logs import L, U
from cellsift.plans.quality import DE, MARKED, markers
from cellsift.plans.registry import query
from cellsift.operators import candidates as cd
from cellsift.operators import runlog as rl
from cellsift.session import durable, with_files
from cellsift.sources import readers as rd
from cellsift.sources import sinks as sk
from cellsift.streaming import logs as st


def _in_splits(t, read) -> DataFrame:
    """What ``read`` gives when a file is one split, and when it is cut into many."""
    spark, key = t.spark, "spark.sql.files.maxPartitionBytes"
    before, out = spark.conf.get(key), None
    try:
        for splits, size in (("one", "1g"), ("many", "16k")):
            spark.conf.set(key, size)
            rows = durable(read()).withColumn("splits", F.lit(splits))
            out = rows if out is None else out.unionByName(rows)
    finally:
        spark.conf.set(key, before)
    return out


@query("read_jsonl", """SELECT splits, * EXCLUDE (splits) FROM (SELECT unnest(['one', 'many']) AS splits), (
  SELECT o_orderpriority AS type, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS seqs FROM orders WHERE o_orderkey % 40 <> 0 GROUP BY 1
  UNION ALL SELECT 'bad lines', count(*), sum(len(o_orderkey::VARCHAR))::BIGINT FROM orders WHERE o_orderkey % 40 = 0)""")
def _(t):
    whole = F.to_json(F.struct(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("type"), F.lit("a\nb").alias("reasoning")))
    # Every fortieth line breaks off; blank lines follow some.
    line = F.when(F.col("o_orderkey") % 40 == 0, F.concat(F.lit('{"seq": '), F.col("o_orderkey").cast("string"))).otherwise(whole)
    lines = t.orders.select(F.concat(line, F.when(F.col("o_orderkey") % 7 == 0, "\n  ").otherwise("")).alias("value"))

    def run(folder):
        lines.coalesce(2).write.text(folder)

        def read():
            rows = rd.read_jsonl(t.spark, folder, rd.LOG_SCHEMA)
            good, bad = rd.split_bad(rows)
            counts = good.groupBy("type").agg(F.count("*").alias("n_rows"), F.sum("seq").alias("seqs"))
            return counts.unionByName(bad.agg(F.lit("bad lines").alias("type"), F.count("*").alias("n_rows"), F.sum(F.length("_bad") - 8).alias("seqs")))

        return _in_splits(t, read)

    return with_files(t.spark, run)


@query("read_fasta", """SELECT splits, * EXCLUDE (splits) FROM (SELECT unnest(['one', 'many']) AS splits), (
  SELECT row_number() OVER (ORDER BY p_partkey) AS position, 'lcl|P' || p_partkey || ' >' || p_name AS header, upper(replace(p_type, ' ', '')) AS sequence FROM part)""")
def _(t):
    broken = F.regexp_replace(F.upper(F.replace("p_type", F.lit(" "), F.lit(""))), "(.{7})", "$1\n")
    text = t.part.orderBy("p_partkey").select(F.concat(F.lit(">lcl|P"), "p_partkey", F.lit(" >"), "p_name", F.lit("\r\n"), broken).alias("value"))

    def run(folder):
        text.write.text(folder)
        return _in_splits(t, lambda: rd.read_fasta(t.spark, folder))

    return with_files(t.spark, run)


@query("read_ground_truth", "SELECT 'c' || c_custkey AS cell_id, c_mktsegment AS true_type FROM customer WHERE c_custkey % 11 <> 0")
def _(t):
    rows = t.customer.select(
        F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.concat(F.lit(" c"), "c_custkey")).alias("barcode"), F.col("c_nationkey").alias("n"),
        F.concat("c_mktsegment", F.lit(" ")).alias("type"), F.lit("x, \"y\"").alias("more"))

    def run(folder):
        rows.repartition(3).write.option("header", True).option("quoteAll", True).csv(folder)
        return rd.read_ground_truth(t.spark, folder, t.customer.where("c_custkey % 11 <> 0").count())

    return with_files(t.spark, run)


@query("read_conversation", """SELECT role, count(*) AS n, count(*) FILTER (content IS NULL) AS n_null, count(*) FILTER (content = '') AS n_empty, sum(len(content))::BIGINT AS n_chars, sum(calls)::BIGINT AS n_calls FROM (
  SELECT role, CASE WHEN turn % 3 = 1 AND role = 'assistant' THEN '' WHEN turn % 3 = 1 THEN NULL ELSE text END AS content, (turn % 3 = 1)::INT AS calls, unnest(CASE WHEN turn = 0 THEN [1, 2] ELSE [1] END) FROM conversations) GROUP BY 1""")
def _(t):
    calls = F.when(F.col("turn") % 3 == 1, F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("note").alias("name"), F.lit("{}").alias("args"))))
    said = t.conversations.select("turn", "role", F.when(F.col("turn") % 3 != 1, F.col("text")).alias("content"), F.lit(None).cast("string").alias("tool_call_id"), calls.alias("tool_calls"))

    def run(folder):
        sk.write_conversation(folder, said.drop("turn"))
        sk.write_conversation(folder, said.where("turn = 0").drop("turn"), append=True)
        return rd.read_conversation(t.spark, folder).groupBy("role").agg(
            F.count("*").alias("n"), F.count_if(F.col("content").isNull()).alias("n_null"), F.count_if(F.col("content") == "").alias("n_empty"),
            F.sum(F.length("content")).alias("n_chars"), F.sum(F.coalesce(F.size("tool_calls"), F.lit(0))).alias("n_calls"))

    return with_files(t.spark, run)


def _document(rows: DataFrame, folder: str, **parts) -> None:
    """One JSON document out of the few rows of a small table."""
    rows.agg(F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()])).alias("value")).coalesce(1).write.text(folder)


@query("load_ortholog_map", """SELECT k AS file, n_name AS gene, r_name AS ref_species, 'G' || n_nationkey AS ref_gene, n_nationkey * 1.5::DOUBLE AS score, 'EUROPE,ASIA' AS reference_species, 0 AS n_warnings
    FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['cross_species_map', 'ortholog_map']) AS k)
  UNION ALL SELECT 'missing', NULL, NULL, NULL, NULL, '', 1""")
def _(t):
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))

    def run(folder):
        out = None
        for key, field in (("cross_species_map", "ref_gene_id"), ("ortholog_map", "ref_gene"), ("missing", "")):
            if key != "missing":
                record = F.struct(F.col("r_name").alias("ref_species"), F.concat(F.lit("G"), "n_nationkey").alias(field), (F.col("n_nationkey") * 1.5).alias("score"))
                _document(named, f"{folder}/{key}", **{key: F.map_from_entries(F.collect_list(F.struct("n_name", F.array(record)))),
                                                       "reference_species": F.array(F.lit("EUROPE"), F.lit("ASIA"))})
            pairs, refs, warned = rd.load_ortholog_map(t.spark, f"{folder}/{key}")
            if key == "missing":
                pairs = t.spark.range(1).select(*[F.lit(None).cast("double" if c == "score" else "string").alias(c) for c in pairs.columns]) if not refs and pairs.isEmpty() else pairs
            rows = pairs.withColumns({"file": F.lit(key), "reference_species": F.lit(",".join(refs)), "n_warnings": F.lit(len(warned))})
            out = rows if out is None else out.unionByName(rows)
        return out

    return with_files(t.spark, run)


@query("load_annotations", """SELECT k AS file, r_name AS cluster, 'type ' || r_regionkey AS label, 'high' AS confidence, 'decisive' AS status FROM region, (SELECT unnest(['nested', 'plain']) AS k)""")
def _(t):
    entry = F.struct(F.concat(F.lit("type "), "r_regionkey").alias("label"), F.lit("high").alias("confidence"), F.lit("decisive").alias("status"), F.lit(1).alias("extra"))
    every = F.map_from_entries(F.collect_list(F.struct("r_name", entry)))

    def run(folder):
        _document(t.region, f"{folder}/nested", annotations=every, version=F.lit(2))
        t.region.agg(F.to_json(every).alias("value")).coalesce(1).write.text(f"{folder}/plain")
        one, two = (rd.load_annotations(t.spark, f"{folder}/{k}").withColumn("file", F.lit(k)) for k in ("nested", "plain"))
        return one.unionByName(two)

    return with_files(t.spark, run)


@query("load_pins", """SELECT k AS item, n_name AS label, 'node ' || n_nationkey AS node FROM nation, (SELECT unnest(['pins', 'gt_ontology', 'aliases']) AS k) WHERE n_nationkey % 4 <> 0""")
def _(t):
    blank = F.when(F.col("n_nationkey") % 8 == 0, " ").when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit(" node "), "n_nationkey"))
    every = F.map_from_entries(F.collect_list(F.struct("n_name", blank)))

    def run(folder):
        out = None
        for key in ("pins", "gt_ontology", "aliases"):
            _document(t.nation, f"{folder}/{key}", **{key: every})
            read = rd.load_aliases if key == "aliases" else rd.load_pins
            rows = read(t.spark, f"{folder}/{key}").toDF("label", "node").withColumn("item", F.lit(key))
            out = rows if out is None else out.unionByName(rows)
        return out

    return with_files(t.spark, run)


@query("write_prepared", with_sql(EXPR, CELLS) + """SELECT cluster, count(*) AS n_values, count(DISTINCT cell_id) AS n_cells, sum(count) AS total, 0 AS n_exchanges FROM expr JOIN cells USING (cell_id) GROUP BY 1""")
def _(t):
    """The join of cells and values of the bucketed tables has no exchange; the plan is counted."""
    spark, names = t.spark, ("cellsift_obs", "cellsift_expr")

    def run(folder):
        obs, expr = cells(t), matrix(t)
        sk.write_prepared(folder, obs, expr.select("gene_id").distinct(), expr)
        tables = [sk.write_bucketed(folder, name, spark.read.parquet(f"{folder}/{kind}"), "cell_id") for name, kind in zip(names, ("obs", "expr"))]
        joined = tables[1].hint("merge").join(tables[0], "cell_id")
        n = joined._jdf.queryExecution().executedPlan().toString().count("Exchange")
        return joined.groupBy("cluster").agg(F.count("*").alias("n_values"), F.count_distinct("cell_id").alias("n_cells"), F.sum("count").alias("total")).withColumn("n_exchanges", F.lit(n))

    out = with_files(spark, run)
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


@query("write_markers", with_sql(EXPR, NORM, CELLS, DE, MARKED.replace("d >= 0.005", "d >= 0.1")) + """SELECT cluster, count(*) AS n_rows, count(marker_rank) AS n_kept,
  coalesce(string_agg(gene_id, ',' ORDER BY marker_rank) FILTER (marker_rank IS NOT NULL), '') AS genes FROM mk GROUP BY 1""")
def _(t):
    def run(folder):
        sk.write_markers(folder, durable(markers(t)))
        rows, nested = rd.read_markers(t.spark, folder)
        flat = rows.groupBy("cluster").agg(F.count("*").alias("n_rows"))
        kept = nested.select("cluster", F.size("markers").cast("long").alias("n_kept"), F.array_join("markers.gene_id", ",").alias("genes"))
        return flat.join(kept, "cluster", "left").fillna(0, ["n_kept"]).fillna("", ["genes"])

    return with_files(t.spark, run)


@query("write_documents", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED) + "SELECT cluster, cell_type, rank, marker_count, supporting_markers FROM ca")
def _(t):
    def run(folder):
        sk.write_documents(folder, "hits", candidates(t).select("cluster", "cell_type", "rank", "marker_count", "supporting_markers"))
        back = t.spark.read.schema("cluster string, cell_type string, rank int, marker_count long, supporting_markers array<string>").json(f"{folder}/hits")
        return back.withColumn("supporting_markers", F.array_join("supporting_markers", ","))

    return with_files(t.spark, run)


@query("write_marker_dict", with_sql(EXPR, CELLS, ROWS, ORTH, CG, HITS, RANKED, DICT) + """
  SELECT 'gene' AS item, gene AS name, count(DISTINCT cell_type) AS n FROM gd GROUP BY 2
  UNION ALL SELECT 'coverage', r_name, count(DISTINCT gene) FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN gd ON gd.cell_type = n_name GROUP BY 2""")
def _(t):
    entries = kg_relation(t).where("parent <> 'WORLD'").select(F.col("parent").alias("true"), F.col("child").alias("predicted"))

    def run(folder):
        found = durable(cd.reverse_marker_dict(candidates(t)))
        sk.write_marker_dict(folder, found, cd.dict_coverage(found, entries))
        genes = t.spark.read.schema("gene string, cell_types array<string>").json(f"{folder}/gene_to_types").select(F.lit("gene").alias("item"), F.col("gene").alias("name"), F.size("cell_types").cast("long").alias("n"))
        return genes.unionByName(t.spark.read.schema("true string, n_markers long").json(f"{folder}/coverage").select(F.lit("coverage").alias("item"), F.col("true").alias("name"), F.col("n_markers").alias("n")))

    return with_files(t.spark, run)


def _log_stream(t, folder: str, cut: bool = False) -> DataFrame:
    """The run log written as files in shuffled order, read as a stream of several batches."""
    log = run_log(t).drop("line").withColumn("_at", F.xxhash64("run", "seq", "ts", "type"))
    text = F.to_json(F.struct(*[c for c in log.columns if c != "_at"]))
    if cut:
        text = F.when(F.col("seq") % 9 == 0, F.substring(text, 1, 30)).otherwise(text)
    log.select(text.alias("value"), "_at").repartition(6, "_at").sortWithinPartitions("_at").select("value").write.text(f"{folder}/log")
    return st.tail_log(t.spark, f"{folder}/log", files_per_batch=2)


def _stored(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """The result table of a stream that takes what is there; a complete result replaces the one before it."""
    spark = stream.sparkSession
    kind = "overwrite" if mode == "complete" else "append"
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(
        lambda rows, n: rows.write.mode(kind).parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_usage", U + "SELECT decision_point, path, sum(n)::BIGINT AS n FROM us GROUP BY 1, 2")
def _(t):
    return with_files(t.spark, lambda folder: _stored(st.stream_usage(_log_stream(t, folder)), folder, "complete"))


@query("stream_latest", L + "SELECT run, split_part(run_id, '#', 1) AS key, max(seq) AS seq FROM lg WHERE type = 'exec' GROUP BY 1, 2")
def _(t):
    return with_files(t.spark, lambda folder: _stored(st.stream_latest(_log_stream(t, folder)), folder, "complete").select("run", "key", "seq"))


@query("stream_split", L + "SELECT 'good' AS kind, count(*) FILTER (seq % 9 <> 0) AS n FROM lg UNION ALL SELECT 'bad', count(*) FILTER (seq % 9 = 0) FROM lg")
def _(t):
    def run(folder):
        def keep(kind):
            return lambda rows, n: rows.select(F.lit(kind).alias("kind")).write.mode("append").parquet(f"{folder}/kept")

        st.split_batches(_log_stream(t, folder, cut=True), keep("good"), keep("bad"), f"{folder}/state").awaitTermination()
        return t.spark.read.schema("kind string").parquet(f"{folder}/kept").groupBy("kind").agg(F.count("*").alias("n"))

    return with_files(t.spark, run)


@query("stream_missing", L + "SELECT run, max(seq) - count(DISTINCT seq) AS n_missing FROM lg GROUP BY 1")
def _(t):
    """What is reported missing, less what late records close, whatever the order of arrival."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key)
    size = (F.col("last") - F.col("first") + 1) * F.when(F.col("event") == "missing", 1).otherwise(-1)

    def run(folder):
        events = _stored(st.stream_missing(_log_stream(t, folder)), folder, "append")
        left = events.groupBy("run").agg(F.sum(size).alias("n_missing"))
        return run_log(t).select("run").distinct().join(left, "run", "left").fillna(0, ["n_missing"])

    try:
        t.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        return with_files(t.spark, run)
    finally:
        t.spark.conf.set(key, before)
