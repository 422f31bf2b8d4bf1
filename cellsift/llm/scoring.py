"""Document likelihood under a unigram lattice of subword pieces."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.llm.lattice import BYTE_MASS, Pieces, expected_pieces, load_pieces, rank_log_probs, word_log_probs
from cellsift.llm.text import distinct, slices, words
from cellsift.llm.tokens import VOCABULARY
from cellsift.session import durable

#: The end of a text as a token; no word holds white space.
END = "\n"
#: Words whose counts every worker has at hand, at most; the other words meet their counts in a join.
COMMON = 1 << 17
#: Pieces used, in expectation, that the vocabulary's own scores stand for.
PRIOR = 10_000.0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of the one column ``text``, and END with the number of texts."""

    def count(batches):
        for part in slices(batches):
            flat, _, _ = words(part.column(0), lower=True)
            vocab, codes = distinct(flat)
            n = np.bincount(codes, minlength=len(vocab))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([vocab.cast(pa.string()), pa.array([END])]), pa.array(np.append(n, part.num_rows).astype(np.int64))],
                names=["word", "n"],
            )

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, pieces: list[str], rounds: int = 3, prior: float = PRIOR) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces and of the end of a text, learned from all word counts.

    Starts at the vocabulary's scores. Each round spreads every word over all of its segmentations
    (forward-backward over the trie) and adds ``prior`` pieces dealt by the vocabulary's scores.
    """
    start = rank_log_probs(len(pieces))
    logp = start
    texts = counts.filter(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    only = counts.filter(F.col("word") != END)
    used = np.zeros(len(pieces))
    for _ in range(rounds):

        def expect(batches, logp=logp):
            table, total = Pieces(pieces, logp), np.zeros(len(pieces))
            for part in slices(batches, "word", 2 << 20):
                total += expected_pieces(part.column(0), part.column(1).to_numpy().astype(float), table)
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["piece", "used"])

        # At most one row per piece of the vocabulary comes to the driver.
        rows = only.mapInArrow(expect, "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used")).toPandas()
        used = np.zeros(len(pieces))
        used[rows["piece"].to_numpy(dtype=np.int64)] = rows["used"]
        p = used + prior * np.exp(start)
        logp = np.log(p / p.sum() * (1 - BYTE_MASS))
    end = (texts + 1.0) / (used.sum() + texts + 2.0)
    return logp + math.log1p(-end), math.log(end)


def score_texts(
    docs: DataFrame,
    held_out,
    vocabulary: str = VOCABULARY,
    rounds: int = 3,
    common: int = COMMON,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """log10 probability of every whole text, learning from the rows where the column ``held_out`` is false.

    Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.
    A text is its words between ASCII white space, A-Z lower-cased, and one end. ``score`` sums, over all ways to
    spell each word by vocabulary pieces or bytes, the product of the piece probabilities (forward recursion in log
    space); the probabilities of all texts sum to one. ``base_score`` is the smoothed word unigram.

    Null texts are empty: one token, the end. With no training rows the pieces keep the vocabulary's scores.
    Repeated rows are scored each. A null id is a value like others. Other columns are not read.

    The commonest words' counts (at most ``common``) travel to the workers; the rest are joined by word, so no word
    is left out. Word counts are checkpointed.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"),
        F.xxhash64(F.col(text_col)).alias("mark"),
    )
    counts = durable(word_counts(base.filter(~F.col("held_out")).select("text")))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    log_rest = math.log10(total + 0.5 * (kinds + 1))
    # Smallest power of two that at most `common` words reach; one row per power comes to the driver.
    powers = sorted(counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect(), reverse=True)
    least, seen = 1 << 62, 0
    for p, n in powers:
        seen += n
        if seen > common:
            break
        least = 1 << int(p)
    known = counts.filter((F.col("n") >= least) & (F.col("word") != END)).toPandas()
    common_words, common_n = known["word"].tolist(), known["n"].to_numpy(dtype=np.int64)
    pieces = load_pieces(vocabulary)
    logp, log_end = fit_pieces(counts, pieces, rounds)
    ends = (counts.filter(F.col("word") == END).first() or [END, 0])[1]

    def score(batches):
        table, values = Pieces(pieces, logp), pa.array(common_words, pa.string())
        for part in slices(batches):
            rows = part.num_rows
            flat, doc, n_words = words(part.column(1), lower=True)
            vocab, codes = distinct(flat)
            spot = pc.fill_null(pc.index_in(vocab, value_set=values), -1).to_numpy(zero_copy_only=False)
            rare = spot < 0
            n = np.where(rare, 0, common_n[spot] if len(common_n) else 0)
            logs = np.where(rare, 0.0, np.log10(n + 0.5) - log_rest)
            chances = word_log_probs(vocab, table)
            sums = np.bincount(doc, logs[codes], minlength=rows) + math.log10(ends + 0.5) - log_rest
            scores = (np.bincount(doc, chances[codes], minlength=rows) + log_end) / math.log(10)
            hits = np.bincount(doc, ~rare[codes], minlength=rows) + (ends > 0)
            # One row for the text itself, with a word that no text has, and one per rare word of the text.
            pairs, times = np.unique(doc[rare[codes]] * len(vocab) + codes[rare[codes]], return_counts=True)
            of, word = (pairs // len(vocab), pairs % len(vocab)) if len(vocab) else (pairs, pairs)
            at = pa.array(np.concatenate([np.arange(rows), of]))
            own = pc.binary_join_element_wise(" ", pc.cast(part.column(3), pa.string()), "")
            zeros, some = np.zeros(len(of), dtype=np.int64), np.zeros(len(of))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(at), part.column(2).take(at), part.column(3).take(at),
                    pa.concat_arrays([own.cast(pa.string()), vocab.take(pa.array(word)).cast(pa.string())]),
                    pa.array(np.concatenate([np.zeros(rows, dtype=np.int64), times.astype(np.int64)])),
                    pa.array(np.concatenate([np.ones(rows, dtype=np.int64), zeros])),
                    pa.array(np.concatenate([(n_words + 1).astype(np.int64), zeros])),
                    pa.array(np.concatenate([hits.astype(np.int64), zeros])),
                    pa.array(np.concatenate([sums, some])), pa.array(np.concatenate([scores, some])),
                ],
                names=out.names,
            )

    out = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.StringType() if c == "word" else T.LongType()) for c in ("mark", "word", "times", "rows", "n_tokens", "hits")]
        + [T.StructField(c, T.DoubleType()) for c in ("sums", "score")]
    )
    found = base.mapInArrow(score, out).join(counts.select("word", "n"), "word", "left")
    met = F.coalesce("n", F.lit(0))
    one = found.groupBy("id", "held_out", "mark").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("hits") + F.when(met > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("sums") + F.col("times") * (F.log10(met + 0.5) - log_rest)).alias("base_score"),
        F.sum("score").alias("score"),
    )
    # Rows with the same id and text fall together above; each gets its row back.
    n = F.col("rows")
    return one.withColumn("_", F.explode(F.sequence(F.lit(1), n))).select(
        F.col("id").alias(id_col), "held_out", (F.col("n_tokens") / n).cast("long").alias("n_tokens"),
        (F.col("n_known") / n).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") / n).alias("base_score"), (F.col("score") / n).alias("score"),
    )
