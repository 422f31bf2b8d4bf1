"""Benchmark passages in documents: a prefix-filtered join of word windows, verified word by word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsift.llm.text import fresh
from cellsift.session import durable

WINDOW = 13
#: Prefix words that are broadcast at once, 8 bytes each; more take further passes over the documents.
AT_ONCE = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, a-z and characters above ASCII, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, size, items): distinct windows of ``window`` words; a shorter item is one window. Items are ids as strings."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    runs = items.select("item", size.alias("size"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.concat_ws(" ", F.slice("w", i, size)))).alias("window"))
    return runs.groupBy("window", "size").agg(F.collect_set("item").alias("items"))


def read_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), words_of(F.col(text_col)).alias("w"))


def prefixes(windows: DataFrame, read: DataFrame) -> DataFrame:
    """(token, offset, window, size, items): the rarest word of each window, by its count in the documents.

    A text that holds a whole window holds all of its words, so the first one in the order of rarity is the necessary
    prefix. Windows with a word that no document has are left out.
    """
    spelled = windows.select("*", F.posexplode(F.split("window", " ")).alias("offset", "word")).withColumn("token", F.xxhash64("word"))
    known = durable(spelled.select("token").distinct())
    seen = _meet(read.select(F.explode("w").alias("word")).select(F.xxhash64("word").alias("token")), known)
    rarity = seen.groupBy("token").agg(F.count("*").alias("n"))
    rarest = spelled.select("window", "token", "offset").join(rarity, "token", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("first"))
    return rarest.filter("first.n > 0").join(windows, "window").select("first.token", "first.offset", "window", "size", "items")


def _meet(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows whose ``token`` is in ``tokens``, at most AT_ONCE tokens broadcast at a time."""
    passes = -(-max(1, tokens.count()) // AT_ONCE)
    parts = [tokens.filter(F.pmod("token", F.lit(passes)) == i) if passes > 1 else tokens for i in range(passes)]
    return reduce(DataFrame.unionAll, [rows.join(F.broadcast(p), "token", "left_semi") for p in parts])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n_words, n_hit, items) of the texts that hold a benchmark window; ``mark`` is the hash of the text."""
    read = read_documents(docs, id_col, text_col)
    needed = durable(prefixes(durable(item_windows(benchmark, window, text_col="text")), read))
    tokens = durable(needed.select("token").distinct())
    at = F.col("p") - F.greatest(F.col("p") - (window - 1), F.lit(0))  # place within the words around
    placed = read.select("id", "mark", "w", F.posexplode("w").alias("p", "word")).withColumn("token", F.xxhash64("word"))
    near = _meet(placed, tokens).select(
        "token", "id", "mark", F.size("w").alias("n_words"), "p", at.alias("at"),
        F.slice("w", F.col("p") - F.col("at") + 1, 2 * window - 1).alias("around"))
    start, inside = F.col("p") - F.col("offset"), F.col("at") - F.col("offset") + 1
    found = near.join(needed, "token").filter(
        (start >= 0) & (start + F.col("size") <= F.col("n_words"))
        & (F.concat_ws(" ", F.slice("around", F.greatest(inside, F.lit(1)), F.col("size"))) == F.col("window")))
    by_text = found.groupBy("id", "mark", "n_words").agg(
        F.array_sort(F.collect_set(F.struct(start.alias("start"), (start + F.col("size")).alias("stop")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(r["stop"] - F.greatest(r["start"], a["upto"]), F.lit(0))).cast("int").alias("n"),
            F.greatest(a["upto"], r["stop"]).cast("int").alias("upto")),
        lambda a: a["n"])
    return by_text.select("id", "mark", "n_words", covered.cast("long").alias("n_hit"), "items")


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every whole text, one row per row of ``docs``.

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive words of an item (a shorter item
    is one window). A text is contaminated if a twentieth of its words or more are hit. Null and empty texts have no
    words and are clean; null and empty items have no window. Repeated rows are judged each, repeated items count once
    per id. Other columns are not read.

    Only the prefix words of windows are broadcast (8 bytes a word, 200,000 at a time); candidates carry the words
    around them and meet their windows in an ordinary join. Columns and functions of Spark only.
    """
    found = hits(docs, benchmark, window, id_col, text_col).select(
        F.col("id").alias("id_"), F.col("mark").alias("mark_"), "n_hit", "items")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    joined = base.join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(F.col("n_words"), n_hit).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    mark = fresh(docs, "llm_mark")
    bad = hits(docs, benchmark, window, id_col, text_col).filter(is_contaminated(F.col("n_words"), F.col("n_hit"))).select(
        F.col("id").alias("bad_id"), F.col("mark").alias("bad_mark"))
    rows = docs.withColumn(mark, F.xxhash64(text_col))
    return rows.join(bad, rows[id_col].eqNullSafe(F.col("bad_id")) & (rows[mark] == F.col("bad_mark")), "left_anti").drop(mark)
