"""Total losses, and rows that a model cannot score."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import regimes as G
from tidemark.operators import trades as D
from tidemark.operators import training as M


def test_capital_stays_lost(spark):
    t = pd.Timestamp("2024-01-01")
    chain = pd.DataFrame({
        "symbol": "a", "model": ["m"] * 2 + ["n"] * 3, "entry_ts": [t, t + pd.Timedelta("1h")] + [t + pd.Timedelta(hours=k) for k in range(3)],
        "entry_price": 100.0, "return_pct": [-1.0, 0.1, -3.0, 0.5, 0.0],
    })
    rules = D.TradeRules(position_size=1.0, commission=0.0, initial_capital=100_000.0)
    got = D.compound_equity(spark.createDataFrame(chain), rules, ("symbol", "model")).orderBy("model", "entry_ts").toPandas()
    assert got.capital_before.tolist() == pytest.approx([1e5, 0, 1e5, -2e5, -3e5])
    assert got.capital_after.tolist() == pytest.approx([0, 0, -2e5, -3e5, -3e5])


def test_total_return_of_a_lost_regime(spark):
    d = spark.createDataFrame([("s", "low_vol", "uptrend", -1.0), ("s", "low_vol", "uptrend", 0.1), ("s", "high_vol", "uptrend", 0.1)], "strategy string, vol_regime string, trend_regime string, returns double")
    got = {r.regime: r.total_return for r in G.regime_performance(d).collect()}
    assert got["low_vol"] == pytest.approx(-1) and got["high_vol"] == pytest.approx(0.1)


def test_every_row_is_scored(spark):
    d = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 6 > 0, F.rand(1)).alias("b"), (F.col("id") % 2).cast("double").alias("y"))
    model = M.train_boosted_trees(d, ["a", "b"], params=M.BoostParams(rounds=2, depth=2))
    got = M.batch_score(model, d, ["a", "b"])
    assert got.count() == 60 and got.where("prob is null").count() == 10
    assert M.batch_score(model, d, ["a", "b"], fill=True).where("prob is not null").count() == 60


def test_failures_are_not_hidden(spark):
    d = spark.range(40).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("y"))
    with pytest.raises(RuntimeError, match="every trial failed"):
        M.multi_model_search(d, d, ["a"], {"boost": M.Space(ints={"rounds": (1, 1), "depth": (99, 99)})}, 1)
