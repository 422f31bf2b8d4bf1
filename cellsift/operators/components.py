"""Principal components of a sparse matrix in long form, by a randomised range finder."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.operators.hot import hot_join
from cellsift.session import durable

#: Directions beyond those asked for, and rounds of power iteration.
EXTRA, ROUNDS = 8, 4
#: Directions whose length is below this share of the longest are noise.
TINY = 1e-9


@dataclass
class Components:
    """``scores`` (id, x) and ``loadings`` (feature, w) are tables; only numbers per component are held here."""

    scores: DataFrame
    loadings: DataFrame
    variances: list[float]
    total_variance: float

    def ratios(self) -> DataFrame:
        rows = [(i + 1, v / self.total_variance if self.total_variance > 0 else 0.0) for i, v in enumerate(self.variances)]
        return self.scores.sparkSession.createDataFrame(rows, "pc int, ratio double")

    def top_loadings(self, k: int = 10) -> DataFrame:
        """Features with the largest absolute weight on the first two components: (pc, rank, feature)."""
        name = self.loadings.columns[0]
        out = None
        for pc in range(min(2, len(self.variances))):
            best = self.loadings.select(name, F.round(F.abs(F.get("w", F.lit(pc))), 9).alias("_w")).orderBy(F.desc("_w"), name).limit(k)
            rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("_w")).alias("_w"), name))).alias("_l")).select(
                F.lit(pc + 1).alias("pc"), F.posexplode("_l").alias("_p", "_s")).select("pc", (F.col("_p") + 1).alias("rank"), F.col(f"_s.{name}").alias(name))
            out = rows if out is None else out.unionByName(rows)
        return out


def _normal(key: str, j: int, seed: int) -> Column:
    """A standard normal number of a feature, from its hash."""
    def unit(part: int) -> Column:
        return (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed), F.lit(j), F.lit(part)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))

    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * np.pi * unit(1))


def _rows(batch, at: int, width: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _triangle(rows: DataFrame, width: int) -> np.ndarray:
    """R of the tall table's QR: each task folds its rows into one triangle, and the triangles are folded again."""

    def fold(batches):
        r = np.zeros((0, width))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, _rows(batch, 0, width)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["x"])

    once = durable(rows.select("x").mapInArrow(fold, "x array<double>"))
    few = max(1, int(np.sqrt(once.rdd.getNumPartitions())))
    again = once.repartition(few).mapInArrow(fold, "x array<double>").coalesce(1).mapInArrow(fold, "x array<double>")
    # At most ``width`` rows of ``width`` numbers come to the driver.
    got = np.array([r["x"] for r in again.collect()], dtype=float).reshape(-1, width)
    return np.vstack([got, np.zeros((max(0, width - len(got)), width))])


def _times(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """(key, x): each row times a small matrix."""
    schema = T.StructType([rows.schema[key], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_rows(batch, 1, len(matrix)) @ matrix), pa.list_(pa.float64()))], names=[key, "x"])

    return rows.select(key, "x").mapInArrow(run, schema)


def _straight(rows: DataFrame, key: str, width: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows' orthonormal directions, longest first (with the lengths, and the turn that was applied); noise is left out."""
    _, lengths, turn = np.linalg.svd(_triangle(rows, width))
    keep = lengths > TINY * max(lengths[0], np.finfo(float).tiny)
    apply = turn[keep].T / lengths[keep]
    return durable(_times(rows, key, apply)), lengths[keep], apply


def _product(long: DataFrame, side: DataFrame, on: str, by: str, width: int, n: int) -> DataFrame:
    """(by, x): sums of ``value`` times the row of ``side`` (on, x); a hot key's rows stay where they are."""
    met = hot_join(long, side.select(on, "x"), [on], "inner", n)
    sums = met.groupBy(by).agg(*[F.sum(F.col("_v") * F.get("x", F.lit(j))).alias(f"_{j}") for j in range(width)])
    return sums.select(by, F.array(*[f"_{j}" for j in range(width)]).alias("x"))


def _vector(rows: DataFrame, weight: Column, width: int) -> np.ndarray:
    """Sum of the rows times a weight: one row of ``width`` numbers."""
    got = rows.agg(*[F.sum(weight * F.get("x", F.lit(j))) for j in range(width)]).first()
    return np.array([v or 0.0 for v in got])


def _less(rows: DataFrame, off: np.ndarray, scale: Column | None = None) -> DataFrame:
    """Rows minus a small vector (times a column of the row)."""
    at = [F.get("x", F.lit(j)) - F.lit(float(v)) * (F.lit(1.0) if scale is None else scale) for j, v in enumerate(off)]
    return rows.withColumn("x", F.array(*at))


def principal_components(
    long: DataFrame, k: int = 50, cell: str = "cell_id", feature: str = "gene_id", value: str = "scaled_raw",
    extra: int = EXTRA, rounds: int = ROUNDS, seed: int = 0, distinct: bool = False,
) -> Components:
    """Components of the covariance of a sparse matrix (cell, feature, value); cells are those with a value.

    The matrix meets k + ``extra`` normal directions, which are turned to the widest ones by ``rounds`` of power iteration (few features or
    cells need none);
    means are taken off the products, so the matrix stays sparse and any number of features will do. Tall tables are
    made orthonormal by a tall-skinny QR. The driver holds matrices of k + ``extra`` columns and rows only. Scores are rows
    times loadings, means left in. The largest loading of a component is positive (the first feature by name on ties).

    A (cell, feature) pair that stands repeatedly is summed; ``distinct`` says that none does, and rows then stay where they
    are: where a cell's rows lie together, its sums meet before the shuffle. Null values and keys are left out. With fewer directions than k,
    fewer components come; an empty table has none.
    """
    given = long.select(F.col(cell).alias("_c"), F.col(feature).alias("_f"), F.col(value).cast("double").alias("_v")).where(
        "_c IS NOT NULL AND _f IS NOT NULL AND _v IS NOT NULL")
    held = durable(given if distinct else given.groupBy("_c", "_f").agg(F.sum("_v").alias("_v")))
    size = held.count()
    n = held.select("_c").distinct().count()
    means = durable(held.groupBy("_f").agg((F.sum("_v") / n).alias("_m"), F.sum(F.col("_v") * F.col("_v")).alias("_q"))) if n else held.select("_f", F.col("_v").alias("_m"), F.col("_v").alias("_q"))
    m, squares, centre = means.agg(F.count("*"), F.sum("_q"), F.sum(F.col("_m") * F.col("_m"))).first()
    total = max(float(((squares or 0.0) - n * (centre or 0.0)) / (n - 1)), 0.0) if n > 1 else 0.0
    # As many directions as features or cells find all components at once.
    width = min(m, n) if min(m, n) <= 4 * (k + extra) else k + extra
    rounds = 0 if width == min(m, n) else rounds

    def empty() -> Components:
        none = held.select(F.col("_c").alias("id"), F.array().cast("array<double>").alias("x")).distinct()
        return Components(none, held.select(F.col("_f").alias(feature), F.array().cast("array<double>").alias("w")).limit(0), [], total)

    if width < 1 or total <= 0:
        return empty()
    start = means.select("_f", F.array(*[_normal("_f", j, seed) for j in range(width)]).alias("x"))

    def rows_of(side: DataFrame, size_of: int) -> DataFrame:
        """Centred rows times the feature table."""
        off = _vector(hot_means.join(side, "_f"), F.col("_m"), size_of)
        return durable(_less(_product(held, side, "_f", "_c", size_of, size), off))

    def features_of(side: DataFrame, size_of: int) -> DataFrame:
        """Features of the centred matrix times the cell table."""
        off = _vector(side, F.lit(1.0), size_of)
        return durable(_less(_product(held, side, "_c", "_f", size_of, size).join(means.select("_f", "_m"), "_f"), off, F.col("_m")).select("_f", "x"))

    hot_means = means.select("_f", "_m")  # each feature once: no key is hot here
    side, wide = durable(start), width
    for turn in range(rounds + 1):
        rows, lengths, _ = _straight(rows_of(side, wide), "_c", wide)
        wide = len(lengths)
        side = features_of(rows, wide)
        if turn < rounds:
            side, lengths, _ = _straight(side, "_f", wide)
            wide = len(lengths)
    loadings, lengths, _ = _straight(side, "_f", wide)
    lengths, wide = lengths[:k], len(lengths)
    most = loadings.agg(*[F.max(F.struct(F.round(F.abs(F.get("x", F.lit(j))), 9).alias("a"), F.struct(F.get("x", F.lit(j)).alias("w")).alias("s"))) for j in range(len(lengths))]).first()
    signs = np.array([1.0 if most[j]["s"]["w"] >= 0 else -1.0 for j in range(len(lengths))])
    pick = np.zeros((wide, len(lengths)))
    pick[np.arange(len(lengths)), np.arange(len(lengths))] = signs
    loadings = durable(_times(loadings, "_f", pick))
    scores = _product(held, loadings, "_f", "_c", len(lengths), size)
    return Components(scores.select(F.col("_c").alias("id"), "x"), loadings.select(F.col("_f").alias(feature), F.col("x").alias("w")),
                      (lengths**2 / (n - 1)).tolist() if n > 1 else [0.0] * len(lengths), total)
