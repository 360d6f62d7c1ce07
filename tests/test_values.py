"""Hand-checked values and the invariants of the metric definitions."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import gates as G
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators.labels import LabelConfig, make_labels
from tidemark.plans.chunks import Series

S = Series()


def equity(spark, values, name="s"):
    ts = pd.date_range("2024-01-01", periods=len(values), freq="min")
    return spark.createDataFrame(pd.DataFrame({"strategy": name, "ts": ts, "equity": [float(v) for v in values]}))


def returns(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "r double")


def test_max_drawdown(spark):
    row = M.max_drawdown(equity(spark, [100, 105, 102, 108, 95, 110])).first()
    assert row["max_drawdown"] == -13 and math.isclose(row["max_drawdown_pct"], -13 / 108)
    assert row["drawdown_duration"] == 1 and row["peak_value"] == 108 and row["trough_value"] == 95
    flat = M.max_drawdown(equity(spark, [5, 5, 5])).first()
    assert flat["max_drawdown"] == 0 and flat["drawdown_duration"] == 0


def test_ratios(spark):
    d = returns(spark, [0.01, 0.02, -0.01, 0.015, -0.005])
    row = d.agg(M.profit_factor(F.col("r")).alias("pf"), M.hit_rate(F.col("r")).alias("hr"), M.sharpe(F.col("r")).alias("sh"), M.sortino(F.col("r")).alias("so")).first()
    x = pd.Series([0.01, 0.02, -0.01, 0.015, -0.005])
    assert math.isclose(row["pf"], 0.045 / 0.015) and row["hr"] == 0.6
    assert math.isclose(row["sh"], x.mean() / x.std(ddof=0) * math.sqrt(252 * 1440))
    assert math.isclose(row["so"], x.mean() / x[x < 0].std(ddof=0) * math.sqrt(252 * 1440))


@pytest.mark.parametrize("values,pf,sharpe,sortino", [([0.01, 0.02], math.inf, None, math.inf), ([-0.01, -0.02], 0.0, None, None), ([0.01, 0.01], math.inf, 0.0, math.inf), ([], 0.0, 0.0, 0.0)])
def test_edges(spark, values, pf, sharpe, sortino):
    row = returns(spark, values).agg(M.profit_factor(F.col("r")).alias("pf"), M.sharpe(F.col("r")).alias("sh"), M.sortino(F.col("r")).alias("so")).first()
    assert row["pf"] == pf
    assert sharpe is None or row["sh"] == sharpe
    assert sortino is None or row["so"] == sortino


def test_skew_and_kurtosis_are_bias_corrected(spark):
    x = pd.Series([0.1, 0.4, -0.2, 0.9, 0.3, -0.7])
    row = returns(spark, x).agg(M.skewness(F.col("r")).alias("s"), M.kurtosis(F.col("r")).alias("k")).first()
    assert math.isclose(row["s"], x.skew()) and math.isclose(row["k"], x.kurtosis())


def test_portfolio_metrics_of_two_strategies(spark):
    d = equity(spark, [100, 101, 99, 102, 103], "a").unionByName(equity(spark, [100, 100, 100, 100], "b"))
    out = M.portfolio_metrics(d).toPandas().set_index("strategy")
    assert math.isclose(out["total_return"]["a"], 0.03) and out["sharpe_ratio"]["b"] == 0 and out["calmar_ratio"]["b"] == 0
    x = pd.Series([100.0, 101, 99, 102, 103]).pct_change().dropna()
    assert math.isclose(out["var_95"]["a"], x.quantile(0.05)) and math.isclose(out["cvar_95"]["a"], x[x <= x.quantile(0.05)].mean())


def bars(spark, rows):
    ts = pd.date_range("2024-01-01", periods=len(rows), freq="min")
    return spark.createDataFrame(pd.DataFrame([(*r, 10.0) for r in rows], columns=["open", "high", "low", "close", "volume"]).assign(symbol="a", ts=ts))


def test_barrier_timeouts_and_tail(spark):
    d = L.triple_barrier(bars(spark, [(100.0, 100.5, 99.5, 100.0)] * 50), S, 15).toPandas()
    assert (d["label"] == 0).all()
    up = L.triple_barrier(bars(spark, [(c, c + 0.5, c - 0.5, c) for c in (100.0, 101.0, 102.0, 103.0, 104.0)]), S, 2).toPandas().sort_values("ts")
    assert list(up["label"])[:2] == [1, 1] and list(up["label"])[-2:] == [0, 0]


def test_both_barriers_on_one_row_is_a_profit(spark):
    d = L.triple_barrier(bars(spark, [(100.0, 100.0, 100.0, 100.0), (100.0, 110.0, 90.0, 100.0), (100.0, 100.0, 100.0, 100.0)]), S, 1).toPandas().sort_values("ts")
    assert list(d["label"]) == [1, 0, 0]


def test_label_dispatch(spark):
    d = bars(spark, [(1.0, 1.0, 1.0, float(i)) for i in range(1, 11)])
    y = make_labels(d, S, LabelConfig("sign_return_h", "3m")).toPandas().sort_values("ts")["y"]
    assert list(y[:7]) == [1.0] * 7 and y[7:].isna().all()
    with pytest.raises(ValueError):
        make_labels(d, S, LabelConfig("other"))


def test_durations():
    assert C.duration_to_bars("4h", "5m") == 48 and C.duration_to_bars("15m") == 15 and C.duration_to_bars("1d", "1h") == 24
    with pytest.raises(ValueError):
        C.duration_to_bars("soon")


def test_gate(spark):
    d = spark.createDataFrame([("a", 0.2, 1.5, 0.6, -0.1), ("b", 0.3, 0.4, 0.6, -0.1)], "model string, total_return double, sharpe_ratio double, win_rate double, max_drawdown double")
    row = G.promotion_gate(d).first()
    assert row["candidate"] == "b" and not row["sharpe_ok"] and row["win_rate_ok"] and not row["passed"]
    assert G.promotion_gate(d.filter("model = 'a'")).first()["passed"]


def test_regression_check(spark):
    runs = spark.createDataFrame([("q", i, 1.0 + 0.001 * (i % 2)) for i in range(12)] + [("q", 99, 2.0)], "benchmark string, run long, seconds double")
    row = G.run_baseline_check(runs, ("benchmark",), ("run",)).first()
    assert row["verdict"] == "regression" and row["n_runs"] == 10
