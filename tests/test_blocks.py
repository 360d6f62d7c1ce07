"""Touches over long horizons against a loop, for chunks and blocks of any size."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import make_bars, rows
from tidemark.operators import labels as L
from tidemark.operators import trades as B
from tidemark.plans.blocks import first_touches
from tidemark.plans.chunks import Level, Series

SMALL = Series(rows_per_chunk=90, levels=(Level("ts", 36_000.0), Level("ts", 3_600.0)))


@pytest.fixture(scope="module")
def walk():
    p = make_bars({"a": 700, "b": 61, None: 40})
    p.loc[p.index[100:130], ["high", "low"]] = np.nan
    return p


def frame(spark, p):
    return spark.createDataFrame(p).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("high", "low")})


@pytest.mark.parametrize("horizon", [1, 300, 5000])
def test_first_touches_against_a_loop(spark, walk, horizon):
    tests = {"up": ("high", ">=", F.col("close") * 1.01), "down": ("low", "<=", F.col("close") * 0.985), "never": ("high", ">=", F.col("close") * 100)}
    out = first_touches(frame(spark, walk), SMALL, horizon, tests).toPandas()
    want = {}
    for symbol, g in walk.groupby("symbol", dropna=False):
        high, low, close = (g[c].to_numpy() for c in ("high", "low", "close"))
        for i in range(len(g)):
            ahead = slice(i + 1, i + 1 + horizon)
            up, down = np.flatnonzero(high[ahead] >= close[i] * 1.01), np.flatnonzero(low[ahead] <= close[i] * 0.985)
            want[(None if pd.isna(symbol) else symbol, g["ts"].iloc[i])] = (i, len(g), up[0] + 1 if len(up) else None, down[0] + 1 if len(down) else None)
    assert len(out) == len(walk)
    for r in out.itertuples():
        one = lambda x: None if pd.isna(x) else int(x)
        assert want[(None if pd.isna(r.symbol) else r.symbol, r.ts)][2:] == (one(r.up), one(r.down)) and pd.isna(r.never)


@pytest.mark.parametrize("side", ["long", "short"])
def test_long_and_short_ways_agree(spark, walk, side, monkeypatch):
    df = frame(spark, walk[walk.symbol.notna()])
    rules = replace(B.TradeRules(), side=side, take_profit=0.03, stop_loss=0.02, timeout=60)
    short = rows(L.triple_barrier(df, SMALL, 60, 0.03, 0.02)), rows(B.exit_outcomes(df, SMALL, rules).withColumnRenamed("entry_ts", "ts"))
    monkeypatch.setattr(L, "SHORT", 10)
    monkeypatch.setattr(B, "SHORT", 10)
    long = rows(L.triple_barrier(df, SMALL, 60, 0.03, 0.02)), rows(B.exit_outcomes(df, SMALL, rules).withColumnRenamed("entry_ts", "ts"))
    for a, b in zip(short, long):
        pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert set(long[0]["label"]) == {-1, 0, 1} and {"take_profit", "stop_loss"} <= set(long[1]["exit_reason"])
    with pytest.raises(ValueError):
        first_touches(df, SMALL, 0, {})
