"""Keyword and vector retrieval over notes or documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.functions.scalars import tokens
from cellsift.session import durable

K1, B = 1.5, 0.75


def tagged(docs: DataFrame, tags: Sequence[str] | None, column: str = "tags") -> DataFrame:
    """Documents that carry every tag."""
    for tag in tags or []:
        docs = docs.where(F.array_contains(column, tag))
    return docs


def bm25_topk(docs: DataFrame, query: str, k: int = 5, tags: Sequence[str] | None = None, id_col: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(id, score, rank) of the k best documents; statistics over the documents with the tags.

    Only the query's terms are counted, inside each document's own row, so no term
    list is exploded or shuffled. Documents without a hit score 0 and still rank;
    equal scores go by id.
    """
    terms = [r for r in dict.fromkeys(_terms(docs.sparkSession, query))]
    held = tagged(docs, tags).select(F.col(id_col).alias("id"), tokens(text).alias("_t"))
    counted = held.select(
        "id", F.size("_t").alias("_dl"),
        *[(F.size("_t") - F.size(F.array_remove("_t", q))).alias(f"_f{i}") for i, q in enumerate(terms)])
    # The texts are read and cut once; what is kept is a few numbers per document.
    counted = durable(counted)
    stats = counted.agg(F.struct(
        F.count("*").alias("n"), F.greatest(F.avg("_dl"), F.lit(1.0)).alias("avgdl"),
        *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])).scalar()
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"_f{i}"), F.col(f"_s.d{i}")
        idf = F.log((F.col("_s.n") - df + 0.5) / (df + 0.5) + 1.0)
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_s.avgdl")))
    ranked = counted.withColumn("_s", stats).select("id", F.round(score, 4).alias("score"), score.alias("_raw"))
    return _best(ranked, k).withColumnRenamed("id", id_col)


def _terms(spark, query: str) -> list[str]:
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def _best(ranked: DataFrame, k: int) -> DataFrame:
    """The k best rows with their rank; the window sees only those k."""
    from pyspark.sql.window import Window as W

    top = ranked.orderBy(F.round("_raw", 10).desc(), "id").limit(k)
    w = W.partitionBy(F.lit(1)).orderBy(F.round("_raw", 10).desc(), "id")
    return top.withColumn("rank", F.row_number().over(w)).drop("_raw")


def cosine_topk(vectors: DataFrame, query: Sequence[float], k: int = 5, tags: Sequence[str] | None = None,
                id_col: str = "id", vec: str = "x") -> DataFrame:
    """(id, score, rank) of the k vectors with the smallest cosine distance."""
    q = F.array(*[F.lit(float(v)) for v in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    x = F.transform(vec, lambda v: v.cast("double"))
    score = F.try_divide(dot(x, q), F.sqrt(dot(x, x)) * F.sqrt(dot(q, q)))
    ranked = tagged(vectors, tags).select(F.col(id_col).alias("id"), score.alias("_raw")).withColumn("score", F.round("_raw", 4)).select("id", "score", "_raw")
    return _best(ranked, k).withColumnRenamed("id", id_col)


def next_note_id(notes: DataFrame) -> DataFrame:
    """One row with the next id: note-%04d of the highest number + 1."""
    top = F.coalesce(F.max(F.nullif(F.regexp_extract("note_id", r"^note-(\d+)", 1), F.lit("")).cast("int")), F.lit(0))
    return notes.agg(F.format_string("note-%04d", top + 1).alias("note_id"))


def add_note(notes: DataFrame, content: str, tags: Sequence[str] = (), session_id: str = "", project_id: str = "") -> DataFrame:
    """The notes with one more; a blank text is an error."""
    if not content or not content.strip():
        raise ValueError("note content is empty")
    row = next_note_id(notes).select(
        "note_id", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.lit(session_id).alias("session_id"), F.lit(project_id).alias("project_id"),
        F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"), F.lit(content.strip()).alias("content"))
    return notes.unionByName(row)
