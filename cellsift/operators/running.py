"""Running aggregates whose groups may be larger than one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.session import durable

_FOLD = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _merge(fn: str, before: Column, here: Column) -> Column:
    if fn == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    if fn == "last":
        return F.coalesce(here, before)
    return (F.least if fn == "min" else F.greatest)(before, here)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    folds: Mapping[str, tuple],
    totals: Mapping[str, tuple[str, str]] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add running values (row itself included) and whole-group totals.

    ``folds`` and ``totals`` map an output name to ``(sum|min|max|last, column)``;
    a fold ``(fn, column, "before")`` leaves the row itself out.
    ``order`` must be unique within a group.

    A plain window would sort every group in one task. Here rows are range
    partitioned by ``by`` and ``order``, so a hot group spans many partitions;
    each partition folds its own stretch, and the small table of stretch totals
    carries the value from one stretch into the next. ``bounded=True`` says the
    caller's groups cannot grow with the data, and uses the plain window.
    """
    by, totals = list(by), dict(totals or {})
    folds = {out: (*spec, "upto")[:3] for out, spec in folds.items()}

    def frames(keys):
        w = W.partitionBy(*keys).orderBy(*order)
        return {"upto": w.rowsBetween(W.unboundedPreceding, 0), "before": w.rowsBetween(W.unboundedPreceding, -1)}

    if bounded:
        frame, whole = frames(by), W.partitionBy(*by)
        return df.select(
            "*",
            *[_FOLD[fn](c).over(frame[to]).alias(out) for out, (fn, c, to) in folds.items()],
            *[_FOLD[fn](c).over(whole).alias(out) for out, (fn, c) in totals.items()],
        )

    ranged = durable(df.repartitionByRange(*by, *order)).withColumn("_chunk", F.spark_partition_id())
    keys = [*by, "_chunk"]
    frame = frames(keys)
    here = ranged.select(
        "*", *[_FOLD[fn](c).over(frame[to]).alias(f"_in_{out}") for out, (fn, c, to) in folds.items()]
    )
    # What a stretch hands on is the fold over all of its rows. A last value is
    # the one on the latest row that has it.
    spot = F.row_number().over(W.partitionBy(*keys).orderBy(*order))

    def whole_stretch(fn, c):
        if fn == "last":
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_spot")))
        return _FOLD[fn](c)

    ends = (ranged.withColumn("_spot", spot) if any(fn == "last" for fn, _, _ in folds.values()) else ranged).groupBy(*keys).agg(
        *[whole_stretch(fn, c).alias(f"_end_{out}") for out, (fn, c, _) in folds.items()],
        *[_FOLD[fn](c).alias(f"_all_{out}") for out, (fn, c) in totals.items()],
    )
    earlier = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    carry = ends.select(
        *keys,
        *[_FOLD[fn](F.col(f"_end_{out}")).over(earlier).alias(f"_pre_{out}") for out, (fn, _, _) in folds.items()],
        *[_FOLD[fn](F.col(f"_all_{out}")).over(whole).alias(out) for out, (fn, _) in totals.items()],
    )
    # Null is a group like any other.
    carry = carry.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    return here.join(carry, same).select(
        *df.columns,
        *[_merge(fn, F.col(f"_pre_{out}"), F.col(f"_in_{out}")).alias(out) for out, (fn, _, _) in folds.items()],
        *totals,
    )
