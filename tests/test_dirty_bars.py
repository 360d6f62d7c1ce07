"""Rolling and exponential features on spikes, infinities and gaps, against pandas, for two chunk sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import make_bars, rows
from tidemark.operators import windows as W
from tidemark.plans.chunks import Level, Series

SERIES = [Series(), Series(rows_per_chunk=50, levels=(Level("ts", 86_400.0), Level("ts", 3_600.0)))]


@pytest.fixture(scope="module")
def dirty():
    p = make_bars({"a": 400, "b": 150})
    a = p.index[p.symbol == "a"]
    p.loc[a[30], ["open", "high", "low", "close"]] = 1e15
    p.loc[a[90], "close"] = np.inf
    p.loc[a[120:124], "close"] = np.nan
    p.loc[a[200], "volume"] = np.inf
    p.loc[a[260], "close"] = -np.inf
    p.loc[p.index[p.symbol == "b"][:3], "close"] = np.nan
    return p


def wanted(p):
    out = []
    for _, g in p.groupby("symbol", sort=False):
        c, v = g["close"], g["volume"]
        finite = c.replace([np.inf, -np.inf], np.nan)
        d = c.diff()

        def mean(x, n):  # direct sums, infinities missing
            x = x.replace([np.inf, -np.inf], np.nan)
            return x.rolling(n, min_periods=1).apply(np.nanmean, raw=True)

        def total(x, n):
            x = x.replace([np.inf, -np.inf], np.nan)
            return x.rolling(n, min_periods=n).apply(np.sum, raw=True)

        gain, loss = mean(d.where(d > 0, 0), 14), mean((-d).where(d < 0, 0), 14)
        tp, r = (g["high"] + g["low"] + c) / 3, c.pct_change(fill_method=None)
        out.append(pd.DataFrame({
            "symbol": g["symbol"], "ts": g["ts"], "rsi_14": 100 - 100 / (1 + gain / loss), "vwap_5": total(tp * v, 5) / total(v, 5),
            "volume_momentum_10": total(r * v, 10), "volume_sma_20": total(v, 20) / 20,
            **{f"ema_{n}": finite.ewm(span=n, adjust=False).mean() for n in (5, 20, 50)},
        }))
    return pd.concat(out).sort_values(["symbol", "ts"]).reset_index(drop=True)


def test_equal_pandas_for_any_chunks(spark, dirty):
    df = spark.createDataFrame(dirty).withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("open", "high", "low", "close", "volume")})
    got = [rows(W.feature_matrix(df, s)) for s in SERIES]
    want = wanted(dirty)
    for col in want.columns[2:]:
        for g in got:
            a, b = g[col].astype(float), want[col]
            np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9, err_msg=col)
    for col in got[0].columns[2:]:
        np.testing.assert_allclose(got[0][col].astype(float), got[1][col].astype(float), rtol=1e-9, atol=1e-12, err_msg=col)


def test_outages_longer_than_a_chunk(spark):
    """Closes missing for 1,900 rows, at the start, across whole chunks, and at the end of a series."""
    n = 3000
    p = make_bars({"a": n, "b": 700})
    a, b = p.index[p.symbol == "a"], p.index[p.symbol == "b"]
    p.loc[a[600:2500], "close"] = np.nan
    p.loc[b[:250], "close"] = np.nan
    p.loc[b[600:], "close"] = np.inf
    p["close"] = p["close"].astype(float)
    df = spark.createDataFrame(p).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    want = []
    for _, g in p.groupby("symbol", sort=False):
        c = g["close"].replace([np.inf, -np.inf], np.nan)
        want.append(pd.DataFrame({f"ema_{k}": c.ewm(span=k, adjust=False).mean() for k in (1, 5, 50)}))
    want = pd.concat(want).reset_index(drop=True)
    for size in (400, 100, 500_000):
        out = rows(W.ema(df, Series(rows_per_chunk=size, levels=(Level("ts", 3600.0),)), spans=(1, 5, 50)))
        assert out["ema_5"].isna().sum() == 250
        for k in (1, 5, 50):
            np.testing.assert_allclose(out[f"ema_{k}"].astype(float), want[f"ema_{k}"], rtol=1e-10, err_msg=f"{k} {size}")
