"""Signals from probabilities and ensembles of model predictions.

Predictions are a long table (row keys, model, prob[, y]).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.metrics import INF, MINUTES_PER_YEAR, max_drawdown, sharpe
from tidemark.plans.chunks import DAY, Level, Series, over_chunks, running
from tidemark.session import stage

ROW_KEYS = ("symbol", "ts")
# Predictions of one model over all symbols, in time order.
MODEL_TIMELINE = Series(keys=("model",), order=("ts", "symbol"), levels=(Level("ts", DAY), Level("ts", 60.0)))

# Weight multipliers by regime and model family.
REGIME_MULTIPLIERS = {
    "high_volatility": {"lightgbm": 1.2, "lgb": 1.2, "xgboost": 1.1, "xgb": 1.1, "catboost": 1.0, "cb": 1.0, "lstm": 0.8, "randomforest": 0.9, "rf": 0.9},
    "bull_trend": {"lightgbm": 1.1, "lgb": 1.1, "xgboost": 1.0, "xgb": 1.0, "catboost": 1.2, "cb": 1.2, "lstm": 0.9, "randomforest": 0.8, "rf": 0.8},
    "bear_trend": {"lightgbm": 1.0, "lgb": 1.0, "xgboost": 1.2, "xgb": 1.2, "catboost": 1.1, "cb": 1.1, "lstm": 0.8, "randomforest": 0.9, "rf": 0.9},
}


def signal_from_prob(
    df: DataFrame, prob: str = "prob", min_confidence: float = 0.6, buy: float = 0.6, sell: float = 0.4, max_size: float = 0.1
) -> DataFrame:
    """BUY / SELL / HOLD, confidence and a size that grows with the confidence above its minimum."""
    p = F.col(prob)
    conf = F.greatest(p, 1 - p)
    kind = (
        F.when(conf < min_confidence, "HOLD").when(p > buy, "BUY").when(F.lit(1.0) - p > F.lit(1 - sell), "SELL").otherwise("HOLD")
    )
    size = F.least(F.lit(max_size) * (F.col("confidence") - min_confidence) / F.lit(1 - min_confidence), F.lit(max_size))
    d = df.withColumns({"confidence": conf, "signal": kind})
    return d.withColumn("position_size", F.when(F.col("signal") != "HOLD", size).otherwise(F.lit(0.0)))


def threshold_signal(df: DataFrame, models: DataFrame, value: str = "prediction", size: float = 0.1) -> DataFrame:
    """BUY above 0.5, SELL below -0.5, else HOLD; symbols without a model hold with confidence 0."""
    d = df.join(models.select("symbol", F.lit(True).alias("_has")).dropDuplicates(["symbol"]), "symbol", "left")
    v, has = F.col(value), F.col("_has").isNotNull()
    kind = F.when(~has, "HOLD").when(v > 0.5, "BUY").when(v < -0.5, "SELL").otherwise("HOLD")
    d = d.withColumns({"signal": kind, "confidence": F.when(has, F.abs(v)).otherwise(0.0), "probability": F.when(has, v).otherwise(0.0)})
    return d.withColumn("position_size", F.when(F.col("signal") == "HOLD", 0.0).otherwise(F.lit(size))).drop("_has")


def signal_stats(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    count = lambda s: F.count_if(F.col("signal") == s)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_signals"), count("BUY").alias("buy_signals"), count("SELL").alias("sell_signals"),
        count("HOLD").alias("hold_signals"), F.avg("confidence").alias("avg_confidence"), F.max(ts).alias("last_signal"),
    )


def soft_vote(df: DataFrame, keys: tuple[str, ...] = ROW_KEYS) -> DataFrame:
    """Mean probability; class 1 above one half. Blending uses the same mean."""
    d = df.groupBy(*keys).agg(F.avg("prob").alias("prob"))
    return d.withColumn("label", (F.col("prob") > 0.5).cast("int"))


def hard_vote(df: DataFrame, keys: tuple[str, ...] = ROW_KEYS) -> DataFrame:
    """Share of models above one half; a tie votes 0."""
    d = df.groupBy(*keys).agg(F.avg((F.col("prob") > 0.5).cast("double")).alias("prob"))
    return d.withColumn("label", (F.col("prob") > 0.5).cast("int"))


def weighted_vote(df: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ROW_KEYS) -> DataFrame:
    """Weighted mean probability; models without a weight do not vote."""
    d = df.join(weights.select("model", "weight"), "model").groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("weight") * F.col("prob")), F.sum("weight")).alias("prob")
    )
    return d.withColumn("label", (F.col("prob") > 0.5).cast("int"))


def _normalise(df: DataFrame, raw: str = "_w") -> DataFrame:
    """One row per model: divide by the total, or share equally when the total is 0."""
    total = df.agg(F.sum(raw).alias("_t"), F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    d = df.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    w = F.when(F.col("_t") > 0, F.col(raw) / F.col("_t")).otherwise(1 / F.col("_n"))
    return d.withColumn("weight", w).drop(raw, "_t", "_n", "_one")


def prob_returns(df: DataFrame, series: Series = MODEL_TIMELINE) -> DataFrame:
    return over_chunks(df, series, lambda c: {"ret": ratio("prob", F.lag("prob").over(c.window)) - 1}, before=1)


def performance_weights(df: DataFrame, series: Series = MODEL_TIMELINE, floor: float = 0.1) -> DataFrame:
    """Weight by the Sharpe ratio of the probability series read as a price, at least ``floor`` each."""
    d = prob_returns(df, series).groupBy("model").agg(sharpe(F.col("ret")).alias("performance"))
    return _normalise(d.withColumn("_w", F.greatest(F.col("performance"), F.lit(floor))))


def equal_weights(df: DataFrame) -> DataFrame:
    return _normalise(df.select("model").distinct().withColumn("_w", F.lit(1.0)))


def wide(df: DataFrame, models: list[str], keys: tuple[str, ...] = ROW_KEYS) -> DataFrame:
    """One row per row key and one probability column per model (one shuffle, no pairs of rows)."""
    return df.groupBy(*keys).pivot("model", models).agg(F.first("prob"))


def _pairwise(df: DataFrame, models: list[str], keys: tuple[str, ...], measure) -> DataFrame:
    """(model_a, model_b, value) for every two models, all from one aggregate over the wide table."""
    pairs = list(combinations(models, 2))
    w = wide(df, models, keys).agg(*[measure(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"p{i}").alias("value")) for i, (a, b) in enumerate(pairs)])
    return w.select(F.inline(rows))


def _disagree(a: Column, b: Column) -> Column:
    return F.avg((a != b).cast("double"))


def prediction_correlation(df: DataFrame, models: list[str], keys: tuple[str, ...] = ROW_KEYS) -> DataFrame:
    d = _pairwise(df, models, keys, F.corr).withColumnRenamed("value", "correlation")
    mean = d.agg(F.avg("correlation").alias("mean_correlation")).withColumn("_one", F.lit(1))
    return d.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one").drop("_one")


def diversity_weights(df: DataFrame, models: list[str], metric: str = "correlation", keys: tuple[str, ...] = ROW_KEYS) -> DataFrame:
    """Weight by the mean distance to the other models: 1 - |corr|, or how often the probabilities differ."""
    if metric == "correlation":
        d = _pairwise(df, models, keys, F.corr).withColumn("value", 1 - F.abs("value"))
    else:
        d = _pairwise(df, models, keys, _disagree)
    both = F.explode(F.array("model_a", "model_b")).alias("model")
    per = d.select(both, "value").groupBy("model").agg((F.sum(F.coalesce("value", F.lit(0.0))) / len(models)).alias("diversity"))
    return _normalise(per.withColumn("_w", F.col("diversity")))


def regime_weights(base: DataFrame, regime: str | Column, multipliers: dict[str, dict[str, float]] = REGIME_MULTIPLIERS) -> DataFrame:
    """Base weights times the multiplier of (regime, model), normalised again; unknown pairs count 1."""
    r = F.lit(regime) if isinstance(regime, str) else regime
    m = F.lit(1.0)
    for name, table in multipliers.items():
        for model, value in table.items():
            m = F.when((r == name) & (F.col("model") == model), F.lit(value)).otherwise(m)
    return _normalise(base.withColumn("_w", F.col("weight") * m).drop("weight"))


def top_variance(df: DataFrame, cols: list[str], n: int = 10) -> list[str]:
    """Names of the ``n`` columns of highest variance (one row of numbers reaches the driver)."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first().asDict()
    return sorted(cols, key=lambda c: (row[c] is None, -(row[c] or 0.0), c))[:n]


def stack_features(df: DataFrame, features: DataFrame, models: list[str], cols: list[str], n: int = 10, keys: tuple[str, ...] = ROW_KEYS) -> DataFrame:
    """Model probabilities side by side plus the features of highest variance."""
    best = top_variance(features, cols, n)
    return wide(df, models, keys).join(features.select(*keys, *best), list(keys))


def auc(df: DataFrame, keys: tuple[str, ...] = ("model",), rows_per_chunk: int = 500_000) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs in the right order, ties one half.

    Rows are first reduced to one per distinct probability; negatives below come from a running sum.
    """
    d = df.filter(F.col("y").isNotNull() & F.col("prob").isNotNull()).groupBy(*keys, "prob").agg(
        F.sum((F.col("y") == 1).cast("double")).alias("_p"), F.sum((F.col("y") != 1).cast("double")).alias("_q")
    )
    s = Series(keys=keys, order=("prob",), levels=(Level("prob", 1e-3), Level("prob", 1e-8)), rows_per_chunk=rows_per_chunk)
    d = running(stage(d, "auc"), s, {"_below": ("sum", F.col("_q"))})
    g = d.groupBy(*keys).agg(
        F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"), F.sum(F.col("_p") * (F.col("_below") - F.col("_q") / 2)).alias("_u")
    )
    one_class = (F.col("_np") == 0) | (F.col("_nq") == 0)
    return g.select(*keys, F.when(one_class, 0.5).otherwise(F.try_divide(F.col("_u"), F.col("_np") * F.col("_nq"))).alias("auc"))


def classification_metrics(df: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on empty denominators) and AUC."""
    d = df.filter(F.col("y").isNotNull() & F.col("prob").isNotNull())
    hit, pos = F.col("prob") > 0.5, F.col("y") == 1
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & pos).alias("_tp"), F.count_if(hit & ~pos).alias("_fp"),
        F.count_if(~hit & pos).alias("_fn"), F.count_if(~hit & ~pos).alias("_tn"),
    )
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("_tp", "_fp", "_fn", "_tn"))
    g = g.select(
        *keys, "n", safe(tp + tn, tp + tn + fp + fn).alias("accuracy"), safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    return g.join(auc(df, keys), list(keys))


def prediction_sharpe_drawdown(df: DataFrame, series: Series = MODEL_TIMELINE) -> DataFrame:
    """Sharpe of the probability series read as a price; drawdown of its running sum read as equity."""
    keys = list(series.keys)
    s = prob_returns(df, series).groupBy(*keys).agg(sharpe(F.col("ret")).alias("sharpe_ratio"))
    eq = stage(running(df, series, {"equity": ("sum", F.col("prob"))}), "prob-equity")
    return s.join(max_drawdown(eq, series).select(*keys, F.col("max_drawdown_pct").alias("max_drawdown")), keys)


def composite_objective(objectives: list[dict]) -> Column:
    """Sum of weighted metrics; a metric that misses its target is replaced by minus (maximise) or plus its distance."""
    total = F.lit(0.0)
    for o in objectives:
        m, w, target = F.col(o["metric"]), float(o.get("weight", 1.0)), o.get("target")
        if o["direction"] == "maximize":
            if target:
                m = F.when(m < target, -F.abs(F.lit(target) - m)).otherwise(m)
            total = total + m * w
        else:
            if target:
                m = F.when(m > target, F.abs(F.lit(target) - m)).otherwise(m)
            total = total - m * w
    return total
