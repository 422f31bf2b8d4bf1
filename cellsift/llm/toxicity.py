"""Severity of toxic language by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.llm.text import distinct, drawn, letter_words, sample_rate, slices
from cellsift.session import durable

#: Labelled texts for fitting, at most about; words that become features, at most; evidence that a feature needs.
ROWS, FEATURES, LEAST_Z = 20_000, 2048, 2.5


class Model:
    """Shared weights over the feature words, and one threshold between neighbouring grades."""

    def __init__(self, features: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.features, self.weights, self.cuts = features, weights, cuts

    def above(self, signal: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each text."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - signal[:, None], -50, 50)))


def _counts(column: pa.Array, features: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, occurrences) that occur, and the words per text."""
    flat, doc, n_words = letter_words(column)
    vocab, codes = distinct(flat)
    spot = pc.fill_null(pc.index_in(vocab, value_set=features), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = spot[codes]
    pairs, n = np.unique(doc[at >= 0] * max(1, len(features)) + at[at >= 0], return_counts=True)
    return pairs // max(1, len(features)), pairs % max(1, len(features)), n, n_words


def fit_ordinal(owner: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, grades: int,
                steps: int = 400, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds: P(grade >= k) = logistic(w x - cut_k), by AdaGrad with an L2 penalty."""
    n = max(1, len(grade))
    share = np.array([(np.sum(grade >= k) + 0.5) / (n + 1) for k in range(1, grades)])
    # cut_1, then the log of each step upwards, keeps the thresholds in order.
    first = -np.log(share[0] / (1 - share[0]))
    cuts = -np.log(share / (1 - share))
    steps_up = np.log(np.maximum(np.diff(cuts), 1e-2))
    w = np.zeros(n_features)
    params = [w, np.array([first]), steps_up]
    seen = [np.full(p.shape, 1e-8) for p in params]
    for _ in range(steps):
        w, first, steps_up = params
        cuts = np.concatenate([first, first[0] + np.cumsum(np.exp(steps_up))])
        x = np.bincount(owner, value * w[feature], minlength=len(grade))
        up = 1 / (1 + np.exp(np.clip(cuts[None, :] - x[:, None], -50, 50)))  # P(grade >= k)
        bounds = np.concatenate([np.ones((len(x), 1)), up, np.zeros((len(x), 1))], axis=1)
        slope = bounds * (1 - bounds)
        rows = np.arange(len(x))
        p = np.maximum(bounds[rows, grade] - bounds[rows, grade + 1], 1e-12)
        d_x = -(slope[rows, grade] - slope[rows, grade + 1]) / p / n
        d_cut = np.zeros(len(cuts))
        np.add.at(d_cut, grade[grade > 0] - 1, (slope[rows, grade] / p / n)[grade > 0])
        np.add.at(d_cut, grade[grade < grades - 1], -(slope[rows, grade + 1] / p / n)[grade < grades - 1])
        g_w = np.bincount(feature, value * d_x[owner], minlength=n_features) + decay * w
        later = np.cumsum(d_cut[::-1])[::-1]
        for param, g, s in zip(params, (g_w, np.array([later[0]]), later[1:] * np.exp(steps_up)), seen):
            s += g * g
            param -= 0.4 * g / np.sqrt(s)
    w, first, steps_up = params
    return w, np.concatenate([first, first[0] + np.cumsum(np.exp(steps_up))])


def fit(graded: DataFrame, rows: int = ROWS, n_features: int = FEATURES, least_z: float = LEAST_Z) -> Model:
    """Learn from (id, text, grade) with grades 0, 1, 2, ...; null texts or grades are left out.

    About ``rows`` texts are drawn by a hash of id and text if there are more. Feature words are those whose share of
    toxic texts (grade above 0) differs from the rest by ``least_z`` standard errors of the log odds, the
    ``n_features`` strongest at most. At most rows x features numbers come to the driver, where the fit runs. The sample is checkpointed.
    With no graded rows, or one grade only, the model has no features and gives grade 0.
    """
    graded = graded.filter(F.col("text").isNotNull() & F.col("grade").isNotNull())
    # Read three times; stored, so that texts meet their labels once.
    sample = durable(graded.filter(drawn(F.lit(sample_rate(graded.count(), rows)), "id", "text")).select("text", F.col("grade").cast("int").alias("grade")))
    sizes = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    grades = max(sizes, default=0) + 1
    clean, toxic = sizes.get(0, 0), sum(n for g, n in sizes.items() if g > 0)
    if not clean or not toxic:
        return Model([], np.zeros(0), np.full(max(1, grades - 1), 30.0))

    def by_word(batches):
        for part in slices(batches):
            flat, doc, _ = letter_words(part.column(0))
            vocab, codes = distinct(flat)
            pairs = np.unique(codes * part.num_rows + doc)  # each word once per text
            bad = part.column(1).to_numpy() > 0
            word, of = pairs // part.num_rows, pairs % part.num_rows
            yield pa.RecordBatch.from_arrays(
                [vocab.cast(pa.string()), pa.array(np.bincount(word, ~bad[of], minlength=len(vocab)).astype(np.int64)),
                 pa.array(np.bincount(word, bad[of], minlength=len(vocab)).astype(np.int64))], names=["word", "clean", "toxic"])

    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    not_a, not_b = F.lit(toxic + 1.0) - a, F.lit(clean + 1.0) - b
    z = (F.log(a / not_a) - F.log(b / not_b)) / F.sqrt(1 / a + 1 / not_a + 1 / b + 1 / not_b)
    chosen = (
        sample.mapInArrow(by_word, "word string, clean long, toxic long").groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .select("word", z.alias("z")).filter(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(n_features).collect()
    )
    features = [r["word"] for r in chosen]

    def sparse(batches):
        values = pa.array(features, pa.string())
        for part in slices(batches):
            owner, feature, n, _ = _counts(part.column(0), values)
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (feature, n)]
            yield pa.RecordBatch.from_arrays([part.column(1), *lists], names=["grade", "feature", "n"])

    got = sample.mapInArrow(sparse, "grade int, feature array<int>, n array<int>").collect()
    got.sort(key=lambda r: (r["grade"], r["feature"], r["n"]))
    owner = np.repeat(np.arange(len(got)), [len(r["feature"]) for r in got])
    feature = np.array([f for r in got for f in r["feature"]], dtype=np.int64)
    value = 1 + np.log(np.array([n for r in got for n in r["n"]], dtype=float))
    w, cuts = fit_ordinal(owner, feature, value, np.array([r["grade"] for r in got]), len(features), grades)
    return Model(features, w, cuts)


def grade(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, expected_severity, p_toxic, severity, toxic) of every whole text, one row per row of ``docs``.

    ``expected_severity`` is the mean of the grade, ``severity`` the likeliest grade (ties: the lower), ``toxic`` is
    P(grade > 0) >= ``least``. Words are runs of letters, lower-cased; a feature's value is 1 + log(occurrences).
    Null and empty texts have no evidence: what the thresholds alone give. Repeated rows are graded each; other
    columns are not read. Nothing is shuffled.
    """
    fields = [docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("expected_severity", T.DoubleType()),
              T.StructField("p_toxic", T.DoubleType()), T.StructField("severity", T.IntegerType()), T.StructField("toxic", T.BooleanType())]

    def run(batches):
        values = pa.array(model.features, pa.string())
        for part in slices(batches):
            owner, feature, n, n_words = _counts(part.column(1), values)
            signal = np.bincount(owner, (1 + np.log(n)) * (model.weights[feature] if len(feature) else 0.0), minlength=part.num_rows)
            up = model.above(signal)
            chance = np.concatenate([np.ones((len(up), 1)), up], axis=1) - np.concatenate([up, np.zeros((len(up), 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words.astype(np.int64)), pa.array(up.sum(axis=1)), pa.array(up[:, 0]),
                 pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(up[:, 0] >= least)], names=[f.name for f in fields])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))
