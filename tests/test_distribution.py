import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellsift.functions import tails
from cellsift.operators import distribution as dist
from cellsift.operators.running import running


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    g = np.where(rng.random(4000) < 0.4, "hot", rng.integers(0, 5, 4000).astype(str))
    return pd.DataFrame({"g": g, "v": np.round(rng.normal(10, 2, 4000), 3)})


@pytest.mark.parametrize("bounded", [True, False])
def test_describe_matches_numpy(spark, values, bounded):
    got = dist.describe(spark.createDataFrame(values), "v", ["g"], compact=False, bounded=bounded).toPandas().set_index("g")
    for g, x in values.groupby("g")["v"]:
        x, row = x.to_numpy(), got.loc[g]
        for p in dist.PERCENTS:
            assert row[f"p{p}"] == pytest.approx(np.percentile(x, p), rel=1e-12)
        z = (x - x.mean()) / x.std()
        assert row["std"] == pytest.approx(x.std())
        assert row["skewness"] == pytest.approx((z**3).mean())
        assert row["kurtosis"] == pytest.approx((z**4).mean() - 3)
        assert list(row["histogram"]) == list(np.histogram(x, 20)[0])
        assert row["bimodality"] == pytest.approx((row["skewness"] ** 2 + 1) / (row["kurtosis"] + 3))


def test_describe_of_constants_and_ulp_ranges(spark):
    const = dist.describe(spark.createDataFrame([(3.0,)] * 5, "v double"), "v").first()
    assert const["histogram"][10] == 5 and sum(const["histogram"]) == 5
    assert const["skewness"] is None and const["bimodality"] is None and const["std"] == 0
    ulp = dist.describe(spark.createDataFrame([(1.0,)] * 10 + [(1.0 + 2.3e-16,)] * 10, "v double"), "v").first()
    assert ulp["histogram"][0] == 20
    assert dist.describe(spark.createDataFrame([(float("nan"),)], "v double"), "v").count() <= 1


def test_describe_keeps_six_digits(spark):
    row = dist.describe(spark.createDataFrame([(0.1234567890123,), (1.0,), (2.0,)], "v double"), "v").first()
    assert row["min"] == 0.123457


def test_gini_entropy_ks(spark, values):
    df = spark.createDataFrame(values)
    x = np.sort(values["v"].to_numpy())
    n = len(x)
    want = (2 * np.sum(np.arange(1, n + 1) * x) - (n + 1) * x.sum()) / (n * x.sum())
    assert dist.gini(df, "v").first()[0] == pytest.approx(want)
    assert dist.gini(spark.createDataFrame([(0.0,), (0.0,)], "v double"), "v").first()[0] == 0
    assert dist.entropy(spark.createDataFrame([(1,), (1,), (2,), (0,)], "n int"), "n").first()[0] == pytest.approx(1.5)
    assert dist.entropy(spark.createDataFrame([(0,)], "n int"), "n").first()[0] == 0
    a, b = values[values.g == "hot"]["v"].to_numpy(), values[values.g != "hot"]["v"].to_numpy()
    grid = np.unique(x)
    ecdf = lambda s: np.searchsorted(np.sort(s), grid, side="right") / len(s)
    got = dist.ks_two_sample(df.where("g = 'hot'"), df.where("g <> 'hot'"), "v").first()[0]
    assert got == pytest.approx(np.abs(ecdf(a) - ecdf(b)).max())
    from statistics import NormalDist

    z = (grid - x.mean()) / (x.std() + 1e-9)
    cdf = np.array([NormalDist().cdf(v) for v in z])
    hi = np.searchsorted(x, grid, side="right") / n
    lo = np.searchsorted(x, grid, side="left") / n
    assert dist.ks_normal(df, "v").first()[0] == pytest.approx(max((hi - cdf).max(), (cdf - lo).max()))


def test_valley_lies_between_the_peaks(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, 500), rng.normal(5, 0.3, 450)])
    d = dist.describe(spark.createDataFrame([(float(v),) for v in x], "v double"), "v")
    assert 0.5 < dist.valley(d).first()[0] < 4.5


@pytest.mark.parametrize("bounded", [True, False])
def test_running_folds_cross_partitions(spark, bounded):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.where(rng.random(900) < 0.5, "hot", "b"), "o": np.arange(900), "x": rng.integers(0, 9, 900)})
    pdf["y"] = [int(v) if v > 6 else None for v in pdf["x"]]
    df = spark.createDataFrame(pdf.astype({"y": "Int64"}))
    got = running(df, ["g"], ["o"], {"s": ("sum", "x"), "m": ("min", "x"), "l": ("last", "y"), "lb": ("last", "y", "before")},
                  {"t": ("sum", "x")}, bounded=bounded).toPandas().sort_values("o")
    for g, part in got.groupby("g"):
        src = pdf[pdf.g == g]
        assert list(part["s"]) == list(src["x"].cumsum())
        assert list(part["m"]) == list(src["x"].cummin())
        assert (part["t"] == src["x"].sum()).all()
        last = src["y"].astype("float").ffill()
        np.testing.assert_array_equal(part["l"].astype(float), last)
        np.testing.assert_array_equal(part["lb"].astype(float), last.shift())


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["median"]) for r in dist.describe(df, "v", ["g"]).collect()}
    assert got == {None: (2, 2.0), "a": (1, 5.0)}


def test_tails_against_published_values(spark):
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert tails.gamma_upper(0.5, 3.841 / 2) == pytest.approx(0.05, abs=1e-4)
    assert tails.gamma_upper(5.0, 18.307 / 2) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_1_from_p(0.05) == pytest.approx(3.841, abs=1e-3)
    row = spark.range(1).select(tails.normal_two_sided(F.lit(1.959964)).alias("z"), tails.chi2_tail(F.lit(3.841459), F.lit(1.0)).alias("c"),
                                tails.t_tail(F.lit(2.228139), F.lit(10.0)).alias("t")).first()
    assert [row["z"], row["c"], row["t"]] == pytest.approx([0.05] * 3, abs=1e-6)


def test_normal_tails_as_columns(spark):
    import math

    x = [-40.0, -9.0, -6.1, -3.6, -3.2, -1.0, -1e-9, 0.0, 1e-300, 0.3, 2.5, 3.5, 3.6, 5.9, 7.0, 30.0, None]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", tails.normal_two_sided("x").alias("p"), tails.normal_cdf("x").alias("c"))
    for r in df.collect():
        if r["x"] is None:
            assert r["p"] is None and r["c"] is None
        else:
            assert r["p"] == pytest.approx(math.erfc(abs(r["x"]) / math.sqrt(2)), rel=1e-11, abs=1e-300)
            assert r["c"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=1e-11, abs=1e-300)
    assert "Python" not in df._jdf.queryExecution().toString()
