"""Tables about hyper-parameter trials and cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import INF
from tidemark.plans.chunks import Level, Series, over_chunks, running
from tidemark.session import stage

TRIALS = Series(keys=("study",), order=("trial",), levels=(Level("trial", 1e12), Level("trial", 10_000.0)))
BY_VALUE = Series(keys=("study",), order=("-value",), levels=(Level("-value", 1e9), Level("-value", 1.0), Level("-value", 1e-6)))


def _cv(mean, dev):
    return F.when(mean == 0, F.lit(INF)).otherwise(F.try_divide(dev, mean))


def fold_stability(folds: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Spread of Sharpe, drawdown and accuracy over folds and a High / Medium / Low rating."""
    ok = F.col("error").isNull() if "error" in folds.columns else F.lit(True)
    v = lambda c: F.when(ok, F.col(c))
    d = folds.groupBy(*keys).agg(
        F.avg(v("sharpe_ratio")).alias("sharpe_mean"), F.stddev_pop(v("sharpe_ratio")).alias("sharpe_std"),
        F.min(v("sharpe_ratio")).alias("sharpe_min"), F.max(v("sharpe_ratio")).alias("sharpe_max"),
        F.avg(v("max_drawdown")).alias("drawdown_mean"), F.stddev_pop(v("max_drawdown")).alias("drawdown_std"),
        F.avg(v("accuracy")).alias("accuracy_mean"), F.stddev_pop(v("accuracy")).alias("accuracy_std"),
        F.count_if(ok).alias("n_successful_folds"), F.count(F.lit(1)).alias("total_folds"),
    ).filter(F.col("n_successful_folds") > 0)
    d = d.withColumns(
        {"sharpe_cv": _cv(F.col("sharpe_mean"), F.col("sharpe_std")), "drawdown_cv": _cv(F.col("drawdown_mean"), F.col("drawdown_std"))}
    )
    s, w = F.col("sharpe_cv"), F.col("drawdown_cv")
    return d.withColumn("rating", F.when((s < 0.2) & (w < 0.3), "High").when((s < 0.5) & (w < 0.7), "Medium").otherwise("Low"))


def trial_statistics(trials: DataFrame, keys: tuple[str, ...] = ("study",)) -> DataFrame:
    state = lambda s: F.count_if(F.col("state") == s)
    best = F.when(F.col("state") == "complete", F.struct(F.col("value"), -F.col("trial")))
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trials"), state("complete").alias("completed_trials"), state("pruned").alias("pruned_trials"),
        state("fail").alias("failed_trials"), F.max_by("trial", best).alias("best_trial"), F.max(best)["value"].alias("best_value"),
        F.sum("seconds").alias("optimization_time"), F.avg("seconds").alias("average_trial_time"),
    )


def trial_stability(trials: DataFrame, keys: tuple[str, ...] = ("study",)) -> DataFrame:
    d = trials.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("best"), F.min("value").alias("worst")
    ).filter(F.col("n") > 1)
    return d.withColumns({"cv": F.try_divide(F.col("std"), F.col("mean")), "range": F.col("best") - F.col("worst")})


def param_importance(trials: DataFrame, params: list[str], keys: tuple[str, ...] = ("study",)) -> DataFrame:
    """|correlation| of each parameter with the value, one row per parameter."""
    d = trials.groupBy(*keys).agg(*[F.abs(F.corr(p, "value")).alias(p) for p in params])
    return d.unpivot(list(keys), params, "param", "importance")


def pareto_front(trials: DataFrame, series: Series = BY_VALUE) -> DataFrame:
    """Trials that no other trial of the study beats (value up, drawdown down).

    Only the lowest drawdown of each value can be on the front, and it is there if it lies below
    the lowest drawdown of all higher values: a running minimum, no pairs of trials.
    """
    keys = list(series.keys)
    best = stage(trials.groupBy(*keys, "value").agg(F.min("drawdown").alias("drawdown")), "front")
    d = running(best, series, {"_above": ("min", F.col("drawdown"))}, exclusive=True)
    front = d.filter(F.col("_above").isNull() | (F.col("drawdown") < F.col("_above"))).select(*keys, "value", "drawdown")
    return trials.join(front, [*keys, "value", "drawdown"], "left_semi")


def best_compromise(front: DataFrame, keys: tuple[str, ...] = ("study",), ideal: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """The front trial nearest to the ideal (value, drawdown)."""
    dist = F.sqrt((F.col("value") - ideal[0]) ** 2 + (F.col("drawdown") - ideal[1]) ** 2)
    d = front.withColumn("distance", dist)
    row = F.struct("trial", "value", "drawdown", "distance")
    return d.groupBy(*keys).agg(F.min_by(row, F.struct("distance", "trial")).alias("_r")).select(*keys, "_r.*")


def hypervolume(front: DataFrame, series: Series = BY_VALUE, ref: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Area between the front and a reference point worse than all of it."""
    keys = list(series.keys)
    d = front.filter((F.col("value") > ref[0]) & (F.col("drawdown") < ref[1])).select(*keys, "value", "drawdown").distinct()
    d = over_chunks(stage(d, "front"), series, lambda c: {"_prev": F.coalesce(F.lag("drawdown").over(c.window), F.lit(ref[1]))}, before=1)
    area = F.sum((F.col("value") - ref[0]) * (F.col("_prev") - F.col("drawdown")))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_solutions"), area.alias("hypervolume"))


def model_comparison_matrix(trials: DataFrame, keys: tuple[str, ...] = ("study",)) -> DataFrame:
    method = F.first("method") if "method" in trials.columns else F.lit("search")
    return trials.groupBy(*keys).agg(
        F.max(F.when(F.col("state") == "complete", F.col("value"))).alias("best_value"), method.alias("method"),
        F.count(F.lit(1)).alias("trials"), F.sum("seconds").alias("opt_time_s"),
    )
