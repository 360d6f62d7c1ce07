"""Operators against naive loops, with chunks small enough that every seam is crossed."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import ensembles as E
from tidemark.operators import labels as L
from tidemark.operators import ledger as A
from tidemark.operators import metrics as M
from tidemark.operators import regimes as G
from tidemark.operators import search as X
from tidemark.operators import splits as T
from tidemark.operators import trades as D
from tidemark.operators import windows as W
from tidemark.plans.chunks import Level, Series

DAY = 86_400.0


def make_bars(sizes, seed=5):
    rng = np.random.default_rng(seed)
    parts = []
    for sym, n in sizes.items():
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        open_ = np.concatenate([[close[0]], close[:-1]])
        high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.005, n))
        low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.005, n))
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h")
        parts.append(pd.DataFrame({"symbol": sym, "ts": ts, "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 100, n).astype(float)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def pbars():
    return make_bars({"hot": 900, "b": 120, "c": 7})


@pytest.fixture(scope="module")
def bars(spark, pbars):
    return spark.createDataFrame(pbars)


SMALL = Series(rows_per_chunk=60)


def rows(df, by=("symbol", "ts")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


@pytest.mark.parametrize("series", [SMALL, Series()])
def test_feature_matrix_equals_pandas(bars, pbars, series):
    out = rows(W.feature_matrix(bars, series))
    assert len(out) == len(pbars)
    want = []
    for _, g in pbars.groupby("symbol", sort=False):
        c, v = g["close"], g["volume"]
        r = c.pct_change()
        d = c.diff()
        gain, loss = d.where(d > 0, 0).rolling(14, min_periods=1).mean(), (-d.where(d < 0, 0)).rolling(14, min_periods=1).mean()
        tp = (g["high"] + g["low"] + c) / 3
        rng = (g["high"] - g["low"]).replace(0, np.nan)
        bb_m, bb_s = c.rolling(20).mean(), c.rolling(20).std()
        want.append(pd.DataFrame({
            "symbol": g["symbol"], "ts": g["ts"],
            "ret_60m": c.pct_change(60), "ema_5": c.ewm(span=5, adjust=False).mean(), "ema_50": c.ewm(span=50, adjust=False).mean(),
            "rsi_14": 100 - 100 / (1 + gain / loss), "vwap_10": (tp * v).rolling(10).sum() / v.rolling(10).sum(),
            "volume_momentum_20": (r * v).rolling(20).sum(), "intraday_strength_5": ((c - g["low"]) / rng).rolling(5).mean(),
            "vol_adj_returns_10": r * np.log1p(v / v.rolling(10).mean()), "bb_upper": bb_m + 2 * bb_s, "bb_position": (c - (bb_m - 2 * bb_s)) / (4 * bb_s),
            "volatility_20m": r.rolling(20).std(), "volume_ratio_20": v / v.rolling(20).mean()}))
    want = pd.concat(want).sort_values(["symbol", "ts"]).reset_index(drop=True)
    for col in want.columns[2:]:
        np.testing.assert_allclose(out[col].astype(float), want[col], rtol=1e-8, atol=1e-10, err_msg=col)


def test_ema_of_one_span_and_long_history(spark):
    n = 5000
    x = np.random.default_rng(1).normal(100, 5, n)
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"), "close": x})
    out = rows(W.ema(spark.createDataFrame(pdf), Series(rows_per_chunk=700, levels=(Level("ts", 3600.0),)), spans=(1, 2, 10, 200)))
    for s in (1, 2, 10, 200):
        np.testing.assert_allclose(out[f"ema_{s}"], pdf["close"].ewm(span=s, adjust=False).mean(), rtol=1e-11)


def test_flat_prices(spark):
    pdf = make_bars({"a": 40}).assign(open=5.0, high=5.0, low=5.0, close=5.0)
    out = rows(W.feature_matrix(spark.createDataFrame(pdf), SMALL))
    assert out["rsi_14"].isna().all()
    assert out["intraday_strength_5"].isna().all()
    assert out["bb_position"].isna().all()
    assert (out["volatility_20m"].dropna() == 0).all()


def naive_barrier(g, h, pt, sl):
    out = []
    for i in range(len(g)):
        lab = 0
        if i < len(g) - h:
            for j in range(i + 1, i + 1 + h):
                if g["high"].iloc[j] >= g["close"].iloc[i] * (1 + pt):
                    lab = 1
                    break
                if g["low"].iloc[j] <= g["close"].iloc[i] * (1 - sl):
                    lab = -1
                    break
        out.append(lab)
    return out


def test_triple_barrier_equals_loop(bars, pbars):
    out = rows(L.triple_barrier(bars, SMALL, 12, 0.015, 0.02))
    want = pbars.sort_values(["symbol", "ts"]).groupby("symbol", group_keys=False)[["high", "low", "close"]].apply(lambda g: pd.Series(naive_barrier(g, 12, 0.015, 0.02), index=g.index))
    np.testing.assert_array_equal(out["label"], want.to_numpy())


def simulate(g, prob, rules):
    """Bar-by-bar twin of the trade operators for one series."""
    capital, curve, done, pos = rules.initial_capital, [], [], []
    for i, (price, p) in enumerate(zip(g["close"], prob)):
        for q in list(pos):
            q["held"] += 1
            why = "take_profit" if price >= q["tp"] else "stop_loss" if price <= q["sl"] else "timeout" if q["held"] >= rules.timeout else None
            if why:
                pos.remove(q)
                capital += (price - q["price"]) * q["size"] - price * q["size"] * rules.commission
                done.append((q["i"], i, why))
        if p > rules.threshold and len(pos) < rules.max_positions:
            value = capital * rules.position_size
            pos.append({"i": i, "price": price, "size": value / price, "tp": price * (1 + rules.take_profit), "sl": price * (1 - rules.stop_loss), "held": 0})
            capital -= value * rules.commission
        curve.append(capital + sum((price - q["price"]) * q["size"] for q in pos))
    done += [(q["i"], len(g) - 1, "market_close") for q in pos]
    return done, curve


@pytest.mark.parametrize("positions", [1, 3])
def test_trades_equal_simulation(spark, bars, pbars, positions):
    rng = np.random.default_rng(9)
    pred = pbars[["symbol", "ts"]].assign(model="m", prob=rng.uniform(0, 1, len(pbars)))
    rules = D.TradeRules(threshold=0.3, take_profit=0.02, stop_loss=0.015, timeout=8, position_size=0.4, commission=0.001, max_positions=positions)
    sp = spark.createDataFrame(pred)
    got = D.non_overlapping(D.candidate_trades(bars, sp, SMALL, rules), max_positions=positions, rows_per_chunk=50)
    want, curves = [], {}
    for sym, g in pbars.groupby("symbol"):
        g = g.reset_index(drop=True)
        done, curves[sym] = simulate(g, pred[pred["symbol"] == sym]["prob"], rules)
        want += [(sym, g["ts"][a], g["ts"][b], why) for a, b, why in done]
    have = [tuple(r) for r in got.select("symbol", "entry_ts", "exit_ts", "exit_reason").toPandas().itertuples(index=False)]
    assert sorted(have) == sorted(want)
    if positions == 1:
        led = D.trade_ledger(bars, sp, SMALL, rules)
        out = rows(D.mark_to_market(bars, sp, led, SMALL, rules))
        np.testing.assert_allclose(out["equity"], np.concatenate([curves[s] for s in sorted(curves)]), rtol=1e-10)


def test_average_cost_and_replay_equal_loops(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"symbol": np.where(rng.uniform(size=n) < 0.7, "hot", "b"), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 3, unit="h"), "id": np.arange(n),
                        "side": np.where(rng.uniform(size=n) < 0.55, "buy", "sell"), "quantity": rng.integers(1, 20, n).astype(float), "price": rng.uniform(10, 20, n)})
    s = Series(order=("ts", "id"), levels=(Level("ts", 1000 * DAY), Level("ts", 36_000.0), Level("id", 5.0)), rows_per_chunk=64)
    got = rows(A.average_cost(spark.createDataFrame(pdf), s), ("symbol", "id"))
    rep = rows(A.replayed_positions(spark.createDataFrame(pdf), s), ("symbol", "id"))
    for sym, g in pdf.groupby("symbol"):
        q = a = 0.0
        rq = ra = 0.0
        for (_, t), (_, r), (_, p) in zip(g.iterrows(), got[got["symbol"] == sym].iterrows(), rep[rep["symbol"] == sym].iterrows()):
            if t["side"] == "buy":
                a = (q * a + t["quantity"] * t["price"]) / (q + t["quantity"]) if q + t["quantity"] > 0 else t["price"]
                q += t["quantity"]
                ra = (rq * ra + t["quantity"] * t["price"]) / (rq + t["quantity"])
                rq += t["quantity"]
            else:
                q -= t["quantity"]
                rq -= t["quantity"]
                if rq <= 0:
                    rq = ra = 0.0
            assert math.isclose(r["position"], q, abs_tol=1e-9) and math.isclose(r["avg_price"], a, rel_tol=1e-9)
            assert math.isclose(p["position"], rq, abs_tol=1e-9) and math.isclose(p["entry_price"], ra, rel_tol=1e-9, abs_tol=1e-9)


def test_order_rate_counts_approved_only(spark):
    rng = np.random.default_rng(4)
    n = 500
    pdf = pd.DataFrame({"account": np.where(rng.uniform(size=n) < 0.8, 1, 2), "order_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 900, n).cumsum(), unit="s"), "notional": rng.uniform(0, 1200, n)})
    s = Series(keys=("account",), order=("ts", "order_id"), levels=(Level("ts", 3600.0),), rows_per_chunk=30)
    limits = A.OrderLimits(orders_per_hour=4)
    got = rows(A.validate_orders(spark.createDataFrame(pdf), s, limits), ("account", "ts", "order_id"))
    want = []
    for _, g in pdf.groupby("account"):
        ok = []
        for _, o in g.iterrows():
            near = [t for t in ok if t > o["ts"] - pd.Timedelta("1h") and t.date() == o["ts"].date()]
            why = "too_small" if o["notional"] < 10 else "too_large" if o["notional"] > 1000 else "rate" if len(near) >= 4 else "approved"
            if why == "approved":
                ok.append(o["ts"])
            want.append(why)
    assert list(got["reason"]) == want
    assert "rate" in want


def test_drawdown_streak_and_breaker(spark):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"account": np.where(rng.uniform(size=n) < 0.8, 1, 2), "order_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 10, unit="min"), "pnl": rng.normal(0, 100, n)})
    df = spark.createDataFrame(pdf)
    s = Series(keys=("account",), order=("ts", "order_id"), levels=(Level("ts", 3600.0),), rows_per_chunk=32)
    by = ("account", "order_id")
    streak, brk, dd = (rows(x, by) for x in (A.loss_streak(df, s, 3), A.daily_loss_breaker(df, s, 300.0), A.drawdown_state(df, s, 1000.0)))
    k = 0
    for acc, g in pdf.sort_values(list(by)).groupby("account"):
        run, bal, peak, day, low = 0, 1000.0, -np.inf, None, np.inf
        for _, e in g.iterrows():
            run = run + 1 if e["pnl"] < 0 else 0
            bal += e["pnl"]
            peak = max(peak, bal)
            if e["ts"].date() != day:
                day, total, low = e["ts"].date(), 0.0, np.inf
            assert streak["streak"][k] == run and bool(streak["tripped"][k]) == (run >= 3)
            assert bool(brk["blocked"][k]) == (low < -300)
            total += e["pnl"]
            low = min(low, total)
            assert math.isclose(dd["drawdown"][k], (peak - bal) / peak, abs_tol=1e-9)
            k += 1


def test_asof_join(spark):
    left = pd.DataFrame({"symbol": ["a"] * 50 + ["b"] * 5, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.r_[np.arange(50) * 7, np.arange(5)], unit="h")})
    right = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2024-01-02") + pd.to_timedelta(np.arange(40) * 5, unit="h"), "px": np.arange(40.0)})
    out = rows(A.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ("symbol",), "ts", ["px"], rows_per_chunk=10))
    want = pd.merge_asof(left.sort_values("ts"), right, on="ts", by="symbol").sort_values(["symbol", "ts"])
    np.testing.assert_array_equal(out["px"].astype(float), want["px"])


def test_auc_and_pareto_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    p = pd.DataFrame({"model": np.where(rng.uniform(size=400) < 0.7, "x", "y"), "prob": np.round(rng.uniform(size=400), 2), "y": rng.integers(0, 2, 400)})
    got = E.auc(spark.createDataFrame(p), rows_per_chunk=16).toPandas().set_index("model")["auc"]
    for m, g in p.groupby("model"):
        pos, neg = g[g["y"] == 1]["prob"].to_numpy()[:, None], g[g["y"] == 0]["prob"].to_numpy()[None, :]
        assert math.isclose(got[m], ((pos > neg) + 0.5 * (pos == neg)).mean(), rel_tol=1e-12)
    t = pd.DataFrame({"study": "s", "trial": np.arange(300), "value": np.round(rng.uniform(0, 2, 300), 2), "drawdown": np.round(rng.uniform(0, 1, 300), 2)})
    s = Series(keys=("study",), order=("-value",), levels=(Level("-value", 0.1),), rows_per_chunk=20)
    front = set(X.pareto_front(spark.createDataFrame(t), s).toPandas()["trial"])
    want = {a.trial for a in t.itertuples() if not any(b.value >= a.value and b.drawdown <= a.drawdown and (b.value > a.value or b.drawdown < a.drawdown) for b in t.itertuples())}
    assert front == want


def test_splits_and_folds(bars, pbars):
    d = T.time_split(bars, SMALL)
    T.assert_no_leakage(d)
    n = d.groupBy("symbol", "split").count().toPandas().set_index(["symbol", "split"])["count"]
    assert n["hot", "train"] == 540 and n["hot", "test"] == 180 and n["c", "train"] == 4 and n["c", "test"] == 1
    folds = T.time_series_folds(bars, SMALL, 4).filter("symbol = 'hot'").groupBy("fold", "role").count().toPandas().set_index(["fold", "role"])["count"]
    assert folds[0, "test"] == 180 and folds[0, "train"] == 180 and folds[3, "train"] == 720
    with pytest.raises(ValueError):
        T.assert_no_leakage(d.withColumn("split", F.when(F.hour("ts") < 12, "train").otherwise("test")))


def test_sequences_short_series_is_padded(bars):
    d = W.padded_sequences(L.sign_return_label(bars, SMALL, 0 + 1), SMALL, ["open", "close"], 10, "y").filter("symbol = 'c'").toPandas()
    assert d.empty  # the only window of the short series ends on a row without a label
    d = W.padded_sequences(bars.withColumn("y", F.lit(1)), SMALL, ["open", "close"], 10, "y").filter("symbol = 'c'").toPandas()
    assert len(d) == 1 and len(d["seq"][0]) == 10 and list(d["seq"][0][0]) == [0.0, 0.0] and d["seq"][0][3][0] > 0


def test_regimes_cover_all_rows(spark, pbars):
    eq = spark.createDataFrame(pbars.assign(strategy=pbars["symbol"], equity=pbars["close"])[["strategy", "ts", "equity"]])
    d = G.label_regimes(eq, Series(keys=("strategy",), rows_per_chunk=80), 20, 10)
    out = d.groupBy("strategy", "vol_regime").count().toPandas().set_index(["strategy", "vol_regime"])["count"]
    assert out["hot", "unknown"] == 20 and out["hot"].sum() == 900


def test_clean_and_integrity(spark, pbars):
    bad = pbars.copy()
    bad.loc[3, "high"] = bad.loc[3, "low"] - 1
    bad.loc[5, "close"] = bad.loc[4, "close"] * 3
    df = spark.createDataFrame(bad)
    assert B.check_integrity(df).first()["high_below_low"] == 1
    with pytest.raises(ValueError):
        B.assert_integrity(df)
    assert B.clean_bars(df, SMALL).count() == len(bad) - 3 - 2  # first rows of three series, the jump and the fall back


def test_empty_and_single_row(spark, bars):
    none = bars.filter("symbol = 'nobody'")
    assert W.feature_matrix(none, SMALL).count() == 0
    assert L.triple_barrier(none, SMALL).count() == 0
    one = bars.filter("symbol = 'c'").limit(1)
    assert W.feature_matrix(one, SMALL).count() == 1
    assert M.period_returns(one.select(F.col("symbol").alias("strategy"), "ts", F.col("close").alias("equity"))).first()["ret"] is None
