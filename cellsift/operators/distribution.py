"""Distribution summaries: describe, gini, entropy, funnel, KS distances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.functions.scalars import bin_index, edges, ratio
from cellsift.functions.tails import normal_cdf
from cellsift.operators.running import running

PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, _v, _n): one row per distinct number; equal values meet before the shuffle."""
    v = F.col(value).cast("double")
    return (
        df.select(*by, v.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*by, "_v")
        .agg(F.count("*").alias("_n"))
    )


def _ranked(df: DataFrame, value: str, by: Sequence[str], bounded: bool) -> DataFrame:
    counted = value_counts(df, value, by).withColumn("_nv", F.col("_n") * F.col("_v"))
    return running(
        counted,
        by,
        ["_v"],
        {"_hi": ("sum", "_n")},
        {"_size": ("sum", "_n"), "_total": ("sum", "_nv"), "_min": ("min", "_v"), "_max": ("max", "_v")},
        bounded=bounded,
    )


def _percentile(p: float) -> list[str]:
    """Lower and upper order statistic around percentile p, and the weight between them."""
    h = f"((_size - 1) * {p / 100.0}D)"
    inside = "max(CASE WHEN _hi - _n <= {k} AND {k} < _hi THEN _v END) AS _q{p}_{part}"
    return [
        inside.format(k=f"floor({h})", p=p, part="a"),
        inside.format(k=f"least(floor({h}) + 1, _size - 1)", p=p, part="b"),
        f"max({h} - floor({h})) AS _q{p}_w",
    ]


def describe(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    bins: int = 20,
    percents: Sequence[int] = PERCENTS,
    compact: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """One row per group: moments, quartiles, shape, percentiles p*, histogram array.

    Percentiles are exact with linear interpolation. Groups of any size are fine,
    see ``running``; no group is gathered in one task.
    """
    by = list(by)
    ranked = _ranked(df, value, by, bounded)
    binned = ranked.withColumn("_bin", bin_index("_v", "_min", "_max", bins)).withColumn(
        "_d", F.expr("_v - _total / _size")
    )
    orders = [part for p in dict.fromkeys([*percents, 25, 50, 75]) for part in _percentile(p)]
    slots = ", ".join(f"sum(CASE WHEN _bin = {i} THEN _n ELSE 0 END)" for i in range(bins))
    wide = binned.groupBy(*by).agg(
        *map(
            F.expr,
            [
                "max(_size) AS n",
                "max(_min) AS min",
                "max(_max) AS max",
                "max(_total / _size) AS mean",
                "sum(_n * _d * _d) / max(_size) AS _m2",
                "sum(_n * _d * _d * _d) / max(_size) AS _m3",
                "sum(_n * _d * _d * _d * _d) / max(_size) AS _m4",
                *orders,
                f"array({slots}) AS histogram",
            ],
        )
    )

    def cut(x: str) -> str:
        return f"try_cast(format_string('%.6g', {x}) AS double)" if compact else x

    def q(p: float) -> str:
        a, b, w = (f"_q{p}_{part}" for part in "abw")
        return f"IF({w} < 0.5D, {a} + ({b} - {a}) * {w}, {b} - ({b} - {a}) * (1 - {w}))"

    # A spread below rounding error has no shape.
    shaped = wide.selectExpr(
        "*",
        "sqrt(_m2) AS _std",
        "_m2 <= power(2.220446049250313e-16D * mean, 2) AS _flat",
    ).selectExpr(
        "*",
        cut("IF(_flat, NULL, _m3 / (_m2 * _std))") + " AS skewness",
        cut("IF(_flat, NULL, _m4 / (_m2 * _m2) - 3)") + " AS kurtosis",
    )
    return shaped.selectExpr(
        *[f"`{c}`" for c in by],
        "n",
        *[f"{cut(c)} AS {c}" for c in ("min", "max", "mean")],
        f"{cut('_std')} AS std",
        f"{cut(q(50))} AS median",
        f"{cut(q(75) + ' - ' + q(25))} AS iqr",
        f"{cut('try_divide(_std, mean)')} AS cv",
        "skewness",
        "kurtosis",
        cut("IF(kurtosis + 3 > 0, (skewness * skewness + 1) / (kurtosis + 3), NULL)") + " AS bimodality",
        *[f"{cut(q(p))} AS p{p}" for p in percents],
        "histogram",
    )


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """Plot-ready bins: (by, bin, lower, upper, n), empty bins included."""
    by = list(by)
    counted = value_counts(df, value, by)
    span = counted.groupBy(*by).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    if by:
        placed = counted.join(span, by)
    else:
        span = span.select(F.struct("_min", "_max").alias("_s"))
        placed = counted.withColumn("_s", span.scalar()).select("*", "_s._min", "_s._max")
    filled = placed.groupBy(*by, bin_index("_v", "_min", "_max", bins).alias("bin")).agg(
        F.sum("_n").alias("n"), F.max("_min").alias("_min"), F.max("_max").alias("_max")
    )
    per_group = filled.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_bins"),
        edges(F.max("_min"), F.max("_max"), bins).alias("_edges"),
    )
    return per_group.select(
        *by, "_bins", "_edges", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        *by,
        "bin",
        F.element_at("_edges", F.col("bin") + 1).alias("lower"),
        F.element_at("_edges", F.col("bin") + 2).alias("upper"),
        F.coalesce(F.try_element_at("_bins", F.col("bin")), F.lit(0)).cast("long").alias("n"),
    )


def gini(df: DataFrame, value: str, by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Gini coefficient per group; 0 when all values are 0."""
    by = list(by)
    n, hi, v = F.col("_n"), F.col("_hi"), F.col("_v")
    # Ranks hi-n+1 .. hi belong to one value, so their sum is n*(2*hi-n+1)/2.
    weighted = F.sum(v * n * (2 * hi - n + 1) / 2)
    total, count = F.max("_total"), F.max("_size")
    return (
        _ranked(df, value, by, bounded)
        .groupBy(*by)
        .agg(
            F.when(total == 0, 0.0)
            .otherwise(ratio(2 * weighted - (count + 1) * total, count * total))
            .alias("gini")
        )
    )


def entropy(df: DataFrame, count: str, by: Sequence[str] = (), base: float = 2.0, name: str = "entropy") -> DataFrame:
    """Shannon entropy of the positive counts of each group; 0 when there are none.

    H = log T - sum(c log c) / T needs one pass and no group totals.
    """
    c = F.when(F.col(count) > 0, F.col(count).cast("double"))
    t = F.sum(c)
    h = (F.log(t) - F.sum(c * F.log(c)) / t) / F.log(F.lit(float(base)))
    return df.groupBy(*by).agg(F.greatest(F.coalesce(h, F.lit(0.0)), F.lit(0.0)).alias(name))


def filter_funnel(df: DataFrame, masks: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: passed (on all rows) and lost (after earlier stages) per mask."""
    flags = {name: F.coalesce(m, F.lit(False)) for name, m in masks.items()}
    alive, out = F.lit(True), []
    for name, m in flags.items():
        out.append(F.count_if(m).alias(f"{name}_passed"))
        out.append(F.count_if(alive & ~m).alias(f"{name}_lost"))
        alive = alive & m
    fails = sum((F.when(m, 0).otherwise(1) for m in flags.values()), F.lit(0))
    return df.groupBy(*by).agg(
        F.count("*").alias("n_before"),
        F.count_if(alive).alias("n_after"),
        (F.count_if(alive) / F.greatest(F.count("*"), F.lit(1))).alias("frac_retained"),
        *out,
        F.count_if(fails >= 2).alias("n_lost_multiple"),
    )


def ks_two_sample(a: DataFrame, b: DataFrame, value: str, by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Largest distance between the two empirical distribution functions."""
    by = list(by)
    zero = F.lit(0).cast("long")
    both = (
        value_counts(a, value, by)
        .select(*by, "_v", F.col("_n").alias("_a"), zero.alias("_b"))
        .unionByName(value_counts(b, value, by).select(*by, "_v", zero.alias("_a"), F.col("_n").alias("_b")))
        .groupBy(*by, "_v")
        .agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    )
    steps = running(
        both, by, ["_v"], {"_ca": ("sum", "_a"), "_cb": ("sum", "_b")},
        {"_na": ("sum", "_a"), "_nb": ("sum", "_b")}, bounded=bounded,
    )
    gap = F.abs(ratio("_ca", "_na") - ratio("_cb", "_nb"))
    return steps.groupBy(*by).agg(F.max(gap).alias("ks_statistic"))


def ks_normal(df: DataFrame, value: str, by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """KS distance of (x - mean) / (std + 1e-9) to the standard normal."""
    by = list(by)
    ranked = _ranked(df, value, by, bounded)
    mean = F.col("_total") / F.col("_size")
    # The spread is one row per group, so the join side stays small.
    spread = ranked.groupBy(*by).agg(
        F.sqrt(F.sum(F.col("_n") * F.pow(F.col("_v") - mean, 2)) / F.max("_size")).alias("_sd")
    )
    if by:
        placed = ranked.join(spread, by)
    else:
        placed = ranked.withColumn("_sd", spread.scalar())
    cdf = placed.withColumn("_F", normal_cdf((F.col("_v") - mean) / (F.col("_sd") + 1e-9)))
    gap = F.greatest(F.col("_hi") / F.col("_size") - F.col("_F"), F.col("_F") - (F.col("_hi") - F.col("_n")) / F.col("_size"))
    return cdf.groupBy(*by).agg(F.max(gap).alias("ks_statistic_vs_normal"))


def valley(described: DataFrame, by: Sequence[str] = (), threshold: float = 0.555) -> DataFrame:
    """Midpoint of the lowest bin between the two highest, for bimodal groups only.

    Equal bins: the lower one wins.
    """
    bins = F.size("histogram")
    held = described.select(*by, "min", "max", "bimodality", "histogram", bins.alias("_k"))
    ordered = F.array_sort(
        F.transform("histogram", lambda n, i: F.struct((-n).alias("a"), i.alias("i")))
    )
    held = held.withColumn("_order", ordered)
    first, second = F.col("_order")[0]["i"], F.col("_order")[1]["i"]
    lo, hi = F.least(first, second), F.greatest(first, second)
    lowest = F.array_min(
        F.transform(
            F.slice("histogram", lo + 1, hi - lo + 1), lambda n, i: F.struct(n.alias("n"), (i + lo).alias("i"))
        )
    )["i"]
    width = (F.col("max") - F.col("min")) / F.col("_k")
    point = F.col("min") + (lowest + 0.5) * width
    return held.select(
        *by, F.when((F.col("bimodality") > threshold) & (F.col("_k") >= 4), point).alias("valley")
    )


def distribution_shift(pre: DataFrame, post: DataFrame, value: str, bounded: bool = False) -> DataFrame:
    """Change of median, iqr and skewness from pre to post, and their KS distance."""
    a, b = describe(pre, value, bounded=bounded), describe(post, value, bounded=bounded)
    keep = ("median", "iqr", "skewness")
    one = F.struct(*keep)
    gap = ks_two_sample(pre, post, value, bounded=bounded)
    return (
        gap.withColumn("_a", a.select(one).scalar())
        .withColumn("_b", b.select(one).scalar())
        .where("_a IS NOT NULL AND _b IS NOT NULL")
        .select(
            (F.col("_b.median") - F.col("_a.median")).alias("delta_median"),
            (F.col("_b.iqr") - F.col("_a.iqr")).alias("delta_iqr"),
            (F.coalesce("_b.skewness", F.lit(0.0)) - F.coalesce("_a.skewness", F.lit(0.0))).alias("delta_skewness"),
            "ks_statistic",
        )
    )


def share_ranked(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of ``key`` per group with their share and rank (count desc, key asc).

    The counts are pre-aggregated, so a group holds one row per distinct key.
    """
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    return counts.select(
        "*",
        (F.col("n") / F.sum("n").over(w)).alias("share"),
        F.row_number().over(w.orderBy(F.col("n").desc(), F.col(key))).alias("rank"),
    )
