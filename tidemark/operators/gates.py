"""Promotion gate, model catalogue and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import dedupe_last

REQUIRED_FEATURES = ("close", "volume", "returns")


def promotion_gate(results: DataFrame, min_sharpe: float = 1.0, min_win: float = 0.55, max_dd: float = 0.2, name: str = "model") -> DataFrame:
    """The best result by (total_return, sharpe_ratio) and whether it passes the three limits."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    top = results.orderBy(zero("total_return").desc(), zero("sharpe_ratio").desc(), name).limit(1)
    d = top.select(
        F.col(name).alias("candidate"), zero("total_return").alias("total_return"), zero("sharpe_ratio").alias("sharpe_ratio"),
        zero("win_rate").alias("win_rate"), zero("max_drawdown").alias("max_drawdown"),
    )
    d = d.withColumns(
        {"sharpe_ok": F.col("sharpe_ratio") >= min_sharpe, "win_rate_ok": F.col("win_rate") >= min_win, "max_drawdown_ok": F.abs("max_drawdown") <= max_dd}
    )
    return d.withColumn("passed", F.col("sharpe_ok") & F.col("win_rate_ok") & F.col("max_drawdown_ok"))


def latest_per_model(runs: DataFrame, keys: tuple[str, ...] = ("model",), order: tuple[str, ...] = ("run_ts",)) -> DataFrame:
    return dedupe_last(runs, keys, order)


def best_model(models: DataFrame, kind: str | None = None, score: str = "auc", name: str = "model") -> DataFrame:
    """Model of the highest score; a missing score counts 0. Ties go to the first name."""
    if kind is not None:
        models = models.filter(F.col("model_type") == kind)
    return models.withColumn("_s", F.coalesce(F.col(score), F.lit(0.0))).orderBy(F.col("_s").desc(), name).limit(1).select(F.col(name).alias("best"), F.col("_s").alias(score))


def model_compatibility(models: DataFrame, features: str = "feature_names", required: tuple[str, ...] = REQUIRED_FEATURES, auc: str = "auc") -> DataFrame:
    missing = F.array_except(F.array(*[F.lit(x) for x in required]), F.col(features))
    return models.withColumns(
        {
            "missing_features": missing,
            "compatible": F.size(missing) == 0,
            "low_auc": F.coalesce(F.col(auc), F.lit(0.0)) < 0.5,
            "feature_count": F.size(features),
        }
    )


def performance_table(metrics: DataFrame, trades: DataFrame | None = None, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Report metrics per strategy, with trade statistics where there are trades."""
    if trades is None:
        return metrics
    t = trades.select(*keys, "total_trades", "hit_rate", F.col("profit_factor"))
    return metrics.join(t, list(keys), "left")


def drawdown_summary(table: DataFrame, name: str = "strategy", col: str = "max_drawdown") -> DataFrame:
    return table.agg(
        F.min(col).alias("lowest"), F.min_by(name, F.struct(col, name)).alias("lowest_name"), F.max(col).alias("highest"), F.avg(col).alias("average")
    )


def _newest(col: str, keys: tuple[str, ...], order: tuple[str, ...]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]))


def run_baseline(runs: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str = "seconds", last: int = 10) -> DataFrame:
    """Mean, sample deviation (0 for one run), min and max of the newest runs. The rank limit is applied before the shuffle."""
    d = runs.withColumn("_rank", _newest(value, keys, order)).filter(F.col("_rank") <= last)
    return d.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_runs")
    )


def check_regression(current: DataFrame, baseline: DataFrame, keys: tuple[str, ...], value: str = "seconds", threshold: float = 0.1) -> DataFrame:
    """Change of the current run against the baseline mean; outside max(threshold, 2 sigma) it is a regression or an improvement."""
    d = current.join(baseline.filter(F.col("mean") > 0), list(keys))
    change = (F.col(value) - F.col("mean")) / F.col("mean")
    limit = F.greatest(F.lit(threshold), 2 * F.col("std") / F.col("mean"))
    d = d.withColumns({"change": change, "limit": limit})
    return d.withColumn("verdict", F.when(F.col("change") > F.col("limit"), "regression").when(F.col("change") < -F.col("limit"), "improvement").otherwise("stable"))


def run_baseline_check(runs: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str = "seconds", last: int = 10, threshold: float = 0.1) -> DataFrame:
    """The newest run of each benchmark against the ``last`` runs before it."""
    d = runs.withColumn("_rank", _newest(value, keys, order)).filter(F.col("_rank") <= last + 1)
    now = d.filter(F.col("_rank") == 1).select(*keys, value)
    past = d.filter(F.col("_rank") > 1).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_runs")
    )
    return check_regression(now, past, keys, value, threshold)
