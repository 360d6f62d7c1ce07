"""Chunked plans must equal plain pandas results for any chunk size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans.chunks import Level, Series, affine_scan, fold, number_rows, over_chunks, running
from tidemark.plans.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    parts = []
    for sym, n in (("hot", 700), ("mid", 90), ("one", 1)):
        gaps = rng.integers(1, 5000, n).cumsum()
        if sym == "hot":
            gaps[300:500] = gaps[300] + np.arange(200)  # a burst within one bucket
            gaps[500:] = gaps[500:] + 1000
        parts.append(pd.DataFrame({"symbol": sym, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(gaps, unit="s"), "x": rng.normal(size=n)}))
    return pd.concat(parts, ignore_index=True).sort_values(["symbol", "ts"]).drop_duplicates(["symbol", "ts"]).reset_index(drop=True)


SERIES = [
    Series(rows_per_chunk=1_000_000),
    Series(rows_per_chunk=40),
    Series(rows_per_chunk=25, levels=(Level("ts", 86400.0), Level("ts", 60.0))),
]


def collect(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("s", SERIES)
def test_bounded_windows(spark, frame, s):
    df = spark.createDataFrame(frame)
    out = collect(over_chunks(df, s, lambda c: {
        "m": F.when(F.count("x").over(c.last(30)) == 30, F.avg("x").over(c.last(30))),
        "ahead": F.lead("x", 45).over(c.window),
        "pos": c.position,
        "n": c.total,
    }, before=29, after=45))
    g = frame.groupby("symbol")["x"]
    assert len(out) == len(frame)
    np.testing.assert_allclose(out["m"], g.transform(lambda x: x.rolling(30).mean()), rtol=1e-9, atol=1e-12)
    np.testing.assert_array_equal(out["ahead"], g.shift(-45))
    np.testing.assert_array_equal(out["pos"], g.cumcount())
    np.testing.assert_array_equal(out["n"], g.transform("size"))


@pytest.mark.parametrize("s", SERIES)
def test_running(spark, frame, s):
    pdf = frame.assign(y=frame["x"].where(frame["x"] > 0.5))
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    out = collect(running(df, s, {
        "s": ("sum", F.col("x")), "mx": ("max", F.col("x")), "mn": ("min", F.col("x")), "f": ("last", F.col("y")),
        "p": ("max", F.struct("x", "ts")),
    }))
    g = pdf.groupby("symbol")
    np.testing.assert_allclose(out["s"], g["x"].cumsum(), rtol=1e-9, atol=1e-12)
    np.testing.assert_array_equal(out["mx"], g["x"].cummax())
    np.testing.assert_array_equal(out["mn"], g["x"].cummin())
    np.testing.assert_array_equal(out["f"].astype(float), g["y"].ffill())
    np.testing.assert_array_equal([p["x"] for p in out["p"]], g["x"].cummax())


@pytest.mark.parametrize("s", SERIES[1:])
def test_running_before_current_row(spark, frame, s):
    out = collect(running(spark.createDataFrame(frame), s, {"mx": ("max", F.col("x"))}, exclusive=True))
    want = frame.groupby("symbol")["x"].transform(lambda x: x.cummax().shift(1))
    np.testing.assert_array_equal(out["mx"].astype(float), want)


@pytest.mark.parametrize("s", SERIES)
def test_affine(spark, frame, s):
    df = spark.createDataFrame(frame)
    out = collect(affine_scan(df, s, F.when(F.col("x") > 1.5, 0.0).otherwise(0.9), F.col("x"), "y"))
    want, prev = [], None
    for sym, x in zip(frame["symbol"], frame["x"]):
        if sym != prev:
            y, prev = 0.0, sym
        y = (0.0 if x > 1.5 else 0.9) * y + x
        want.append(y)
    np.testing.assert_allclose(out["y"], want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("s", SERIES)
def test_fold_rate_limit(spark, frame, s):
    def step(rows, state):
        recent, keep = list(state), []
        for t in (rows["ts"].astype("int64") / 1e9 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9):
            recent = [r for r in recent if r > t - 20_000]
            keep.append(len(recent) < 3)
            if keep[-1]:
                recent.append(t)
        return rows.assign(ok=keep), recent

    out = collect(fold(spark.createDataFrame(frame), s, step, "ok boolean"))
    want = pd.concat([step(g, [])[0] for _, g in frame.groupby("symbol")]).reset_index(drop=True)
    np.testing.assert_array_equal(out["ok"], want["ok"])


@pytest.mark.parametrize("small", [200_000, 50])
def test_percentiles(spark, small):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b", "c"], [4000, 500, 3]), "x": np.round(rng.normal(size=4503), 2)})
    pdf.loc[:1500, "x"] = 0.0
    qs = {"q05": 0.05, "q33": 0.33, "med": 0.5, "q9": 0.9}
    out = exact_percentiles(spark.createDataFrame(pdf), ["k"], F.col("x"), qs, accuracy=200, small_group=small).toPandas().set_index("k")
    for n, q in qs.items():
        np.testing.assert_allclose(out[n].sort_index(), pdf.groupby("k")["x"].quantile(q), atol=1e-12)


def test_number_rows_descending(spark):
    pdf = pd.DataFrame({"k": "a", "v": np.arange(100.0)})
    s = Series(keys=("k",), order=("-v",), levels=(Level("-v", 7.0),), rows_per_chunk=20)
    out = number_rows(spark.createDataFrame(pdf), s).toPandas().sort_values("v")
    np.testing.assert_array_equal(out["pos"], np.arange(100)[::-1])


def test_one_busy_day_is_cut(spark):
    """Nine rows in ten in one day of one key: no chunk holds many more rows than asked, and AQE plays no part."""
    from tidemark.plans.chunks import Chunks

    n = 4000
    ts = F.when(F.col("id") < n * 9 // 10, F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 20)).otherwise(F.timestamp_seconds(F.lit(1_710_000_000) + F.col("id") * 86_400))
    df = spark.range(n).select(F.lit("hot").alias("symbol"), ts.alias("ts"), F.col("id").cast("double").alias("x"))
    skew, rows = spark.conf.get("spark.sql.adaptive.skewJoin.enabled"), 200
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        c = Chunks(df, Series(rows_per_chunk=rows), before=30)
        sizes = [r["count"] for r in c.df.groupBy("_chunk").count().collect()]
        assert len(sizes) >= n // rows - 1 and max(sizes) <= rows + rows // 16 * 2 + 60
        got = c.close(c.df.withColumn("s", F.sum("x").over(c.last(30)))).orderBy("ts").toPandas()["s"]
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", skew)
    x = pd.Series(np.arange(n, dtype=float))
    np.testing.assert_allclose(got, x.rolling(30, min_periods=1).sum())
