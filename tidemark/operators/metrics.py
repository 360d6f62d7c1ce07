"""Performance and risk metrics per strategy."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.plans.chunks import Chunks, Series, over_chunks, running
from tidemark.plans.quantiles import exact_percentiles
from tidemark.session import stage

MINUTES_PER_YEAR = 252 * 24 * 60
DAYS_PER_YEAR = 252
INF = float("inf")
STRATEGY = Series(keys=("strategy",))


def period_returns(df: DataFrame, series: Series = STRATEGY, col: str = "equity", out: str = "ret") -> DataFrame:
    return over_chunks(df, series, lambda c: {out: ratio(col, F.lag(col).over(c.window)) - 1}, before=1)


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def sharpe(ret: Column, rf: float = 0.0, periods: int = MINUTES_PER_YEAR) -> Column:
    """Aggregate: mean excess return over the population deviation, annualised; 0 without variance."""
    dev = F.stddev_pop(ret)
    return F.when(_or_zero(dev) == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.avg(ret) - F.lit(rf / periods), dev) * math.sqrt(periods)
    )


def sortino(ret: Column, rf: float = 0.0, periods: int = MINUTES_PER_YEAR) -> Column:
    """Aggregate: as :func:`sharpe` with the deviation of returns below the risk-free rate."""
    floor = F.lit(rf / periods)
    down = _or_zero(F.stddev_pop(F.when(ret < floor, ret)))
    excess = F.avg(ret) - floor
    none = F.when(excess > 0, F.lit(INF)).otherwise(F.lit(0.0))
    return F.when(F.count(ret) == 0, F.lit(0.0)).when(down == 0, none).otherwise(
        F.try_divide(excess, down) * math.sqrt(periods)
    )


def profit_factor(ret: Column) -> Column:
    gains = _or_zero(F.sum(F.when(ret > 0, ret)))
    losses = F.abs(_or_zero(F.sum(F.when(ret < 0, ret))))
    return F.when(losses > 0, F.try_divide(gains, losses)).when(gains > 0, F.lit(INF)).otherwise(F.lit(0.0))


def hit_rate(ret: Column) -> Column:
    return _or_zero(F.avg(F.when(ret.isNotNull(), (ret > 0).cast("double"))))


def skewness(ret: Column) -> Column:
    """Bias-corrected, as pandas reports it; null below three values."""
    n = F.count(ret).cast("double")
    g = F.coalesce(F.skewness(ret), F.lit(0.0)) * F.sqrt(F.greatest(n * (n - 1), F.lit(0.0)))
    return F.when(n > 2, F.try_divide(g, n - 2))


def kurtosis(ret: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(ret).cast("double")
    g = F.kurtosis(ret)
    corrected = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6)
    return F.when(n > 3, F.coalesce(corrected, F.lit(0.0)))


def add_drawdown(df: DataFrame, series: Series = STRATEGY, col: str = "equity") -> DataFrame:
    """Running peak, drawdown and drawdown_pct, with the time of the last row at the peak."""
    return _drawdown_columns(running(df, series, _peak(series, col)), col)


def _peak(series: Series, col: str) -> dict[str, tuple[str, Column]]:
    return {"_p": ("max", F.struct(F.col(col).alias("v"), F.col(series.order[0]).alias("t")))}


def _drawdown_columns(d: DataFrame, col: str) -> DataFrame:
    peak = F.col("_p.v")
    return d.withColumns(
        {"peak": peak, "peak_ts": F.col("_p.t"), "drawdown": F.col(col) - peak, "drawdown_pct": ratio(F.col(col) - peak, peak)}
    ).drop("_p")


def max_drawdown(df: DataFrame, series: Series = STRATEGY, col: str = "equity", prepared: bool = False) -> DataFrame:
    """Row of the deepest absolute drawdown (first on ties): depth, percent, peak, trough, rows since the peak."""
    ts, keys = series.order[0], list(series.keys)
    d = df if prepared else add_drawdown(df.select(*keys, *series.order, col), series, col)
    row = F.struct("drawdown", "drawdown_pct", "peak", F.col(col).alias("trough"), "peak_ts", F.col(ts).alias("trough_ts"))
    worst = d.groupBy(*keys).agg(F.min_by(row, F.struct("drawdown", ts)).alias("_w")).select(*keys, "_w.*")
    held = df.join(worst.select(*keys, "peak_ts", "trough_ts").withColumnsRenamed({"peak_ts": "_from", "trough_ts": "_to"}), keys)
    held = held.filter((F.col(ts) > F.col("_from")) & (F.col(ts) <= F.col("_to"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"))
    return worst.join(held, keys, "left").select(
        *keys, F.col("drawdown").alias("max_drawdown"), F.col("drawdown_pct").alias("max_drawdown_pct"),
        F.coalesce("_d", F.lit(0)).alias("drawdown_duration"), F.col("peak").alias("peak_value"), F.col("trough").alias("trough_value"),
    )


def value_at_risk(df: DataFrame, keys: list[str], ret: str = "ret", level: float = 0.05) -> DataFrame:
    return exact_percentiles(df, keys, F.col(ret), {"var": level})


def cvar(df: DataFrame, keys: list[str], ret: str = "ret", level: float = 0.05) -> DataFrame:
    """Percentile and mean of the returns at or below it."""
    v = value_at_risk(df, keys, ret, level)
    return df.join(v, keys).groupBy(*keys).agg(
        F.first("var").alias("var"), F.avg(F.when(F.col(ret) <= F.col("var"), F.col(ret))).alias("cvar")
    )


def calmar(mean: Column, max_dd_pct: Column, periods: int = MINUTES_PER_YEAR) -> Column:
    year, depth = mean * periods, F.abs(max_dd_pct)
    return F.when(depth == 0, F.when(year > 0, F.lit(INF)).otherwise(F.lit(0.0))).otherwise(F.try_divide(year, depth))


def trade_metrics(df: DataFrame, keys: list[str], ret: str = "return_pct") -> DataFrame:
    r = F.col(ret)
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    d = df.groupBy(*keys).agg(
        F.count(r).alias("total_trades"),
        F.count(win).alias("winning_trades"),
        F.count(loss).alias("losing_trades"),
        hit_rate(r).alias("hit_rate"),
        _or_zero(F.avg(win)).alias("avg_win"),
        _or_zero(F.avg(loss)).alias("avg_loss"),
        _or_zero(F.max(win)).alias("largest_win"),
        _or_zero(F.min(loss)).alias("largest_loss"),
        profit_factor(r).alias("profit_factor"),
        _or_zero(F.avg(r)).alias("avg_trade"),
    )
    wl = F.when(F.col("avg_loss") != 0, F.abs(F.try_divide(F.col("avg_win"), F.col("avg_loss")))).when(
        F.col("avg_win") > 0, F.lit(INF)
    )
    return d.withColumn("win_loss_ratio", wl.otherwise(F.lit(0.0)))


def _core(df: DataFrame, series: Series, col: str, rf: float, periods: int) -> DataFrame:
    """Return moments, drawdown and tail of every strategy from one staged pass over the ordered rows."""
    ts, keys, r = series.order[0], list(series.keys), F.col("ret")
    c = Chunks(df, series, before=1, carry=_peak(series, col))
    d = c.df.withColumns({"ret": ratio(col, F.lag(col).over(c.window)) - 1, **c.running()})
    d = _drawdown_columns(c.close(d), col)
    d = stage(d.select(*keys, ts, col, "ret", "peak", "peak_ts", "drawdown", "drawdown_pct"), "metrics")
    moments = d.groupBy(*keys).agg(
        F.count(r).alias("n"),
        F.min_by(col, ts).alias("first_equity"),
        F.max_by(col, ts).alias("last_equity"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("dev"),
        sharpe(r, rf, periods).alias("sharpe_ratio"),
        sortino(r, rf, periods).alias("sortino_ratio"),
        skewness(r).alias("skewness"),
        kurtosis(r).alias("kurtosis"),
    )
    tail = cvar(d, keys).withColumnsRenamed({"var": "var_95", "cvar": "cvar_95"})
    return moments.join(max_drawdown(d, series, col, prepared=True), keys).join(tail, keys, "left").filter("n > 0")


def portfolio_metrics(df: DataFrame, series: Series = STRATEGY, col: str = "equity", rf: float = 0.0) -> DataFrame:
    p = MINUTES_PER_YEAR
    return _core(df, series, col, rf, p).select(
        *series.keys,
        (F.try_divide(F.col("last_equity") - F.col("first_equity"), F.col("first_equity"))).alias("total_return"),
        (F.col("mean") * p).alias("annualized_return"),
        (F.col("dev") * math.sqrt(p)).alias("volatility"),
        "sharpe_ratio", "sortino_ratio",
        calmar(F.col("mean"), F.col("max_drawdown_pct"), p).alias("calmar_ratio"),
        "max_drawdown", "max_drawdown_pct", "drawdown_duration", "var_95", "cvar_95", "skewness", "kurtosis",
    )


def report_metrics(df: DataFrame, series: Series = STRATEGY, col: str = "equity") -> DataFrame:
    """The report's set: percent units, volatility scaled by the square root of 252."""
    return _core(df, series, col, 0.0, MINUTES_PER_YEAR).select(
        *series.keys,
        ((ratio("last_equity", "first_equity") - 1) * 100).alias("total_return"),
        "sharpe_ratio", "sortino_ratio",
        (F.abs("max_drawdown_pct") * 100).alias("max_drawdown"),
        calmar(F.col("mean"), F.col("max_drawdown_pct")).alias("calmar_ratio"),
        (F.col("var_95") * 100).alias("var_95"),
        (F.col("cvar_95") * 100).alias("cvar_95"),
        (F.col("dev") * math.sqrt(DAYS_PER_YEAR) * 100).alias("volatility"),
        F.coalesce("skewness", F.lit(0.0)).alias("skewness"),
        F.coalesce("kurtosis", F.lit(0.0)).alias("kurtosis"),
    )


def benchmark_stats(returns: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("strategy",), ts: str = "ts", ret: str = "ret", bench: str = "bench_ret") -> DataFrame:
    """Beta (sample covariance over population variance), alpha and correlation on common times."""
    r, b = F.col(ret), F.col(bench)
    d = returns.filter(r.isNotNull()).join(benchmark.filter(b.isNotNull()).select(ts, bench), ts)
    d = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp(r, b).alias("_cov"), F.var_pop(b).alias("_var"), F.avg(r).alias("_r"),
        F.avg(b).alias("_b"), F.corr(r, b).alias("correlation"),
    ).filter((F.col("n") > 1) & (F.col("_var") > 0))
    beta = F.col("_cov") / F.col("_var")
    return d.select(*keys, "n", beta.alias("beta"), (F.col("_r") - beta * F.col("_b")).alias("alpha"), "correlation")


def daily_sharpe(df: DataFrame, series: Series = STRATEGY, col: str = "equity") -> DataFrame:
    """Mean over sample deviation of daily returns times the square root of 252; from bar returns if there is one day only."""
    ts, keys = series.order[0], list(series.keys)
    daily = df.groupBy(*keys, F.date_trunc("day", ts).alias("day")).agg(F.max_by(col, ts).alias("_eq"))
    by_day = Series(keys=series.keys, order=("day",), rows_per_chunk=series.rows_per_chunk)
    d = period_returns(daily, by_day, "_eq", "_dr").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_days"), F.count("_dr").alias("_dn"), F.avg("_dr").alias("_dm"), F.stddev_samp("_dr").alias("_ds")
    )
    b = period_returns(df, series, col, "_br").groupBy(*keys).agg(
        F.count("_br").alias("_bn"), F.avg("_br").alias("_bm"), F.stddev_samp("_br").alias("_bs")
    )
    by_days = F.when((F.col("_dn") > 1) & (F.col("_ds") > 0), F.try_divide(F.col("_dm"), F.col("_ds")) * math.sqrt(DAYS_PER_YEAR)).otherwise(0.0)
    by_bars = F.try_divide(F.col("_bm"), F.col("_bs")) * math.sqrt(MINUTES_PER_YEAR)
    out = F.when((F.col("_bn") > 1) & (F.col("_bs") > 0), F.when(F.col("_days") > 1, by_days).otherwise(by_bars)).otherwise(0.0)
    return d.join(b, keys).select(*keys, out.alias("sharpe_ratio"))


def backtest_summary(trades: DataFrame, equity: DataFrame, capital: DataFrame, series: Series, col: str = "equity") -> DataFrame:
    """Result table of a run: ``capital`` holds initial_capital and final_capital per key."""
    keys = list(series.keys)
    dd = add_drawdown(equity, series, col).groupBy(*keys).agg(F.min("drawdown_pct").alias("max_drawdown"))
    t = trade_metrics(trades, keys)
    d = capital.join(dd, keys).join(daily_sharpe(equity, series, col), keys).join(t, keys, "left")
    n = F.coalesce("total_trades", F.lit(0))
    traded = lambda c: F.when(n > 0, F.col(c)).otherwise(0.0)
    return d.select(
        *keys,
        F.when(n > 0, F.try_divide(F.col("final_capital") - F.col("initial_capital"), F.col("initial_capital"))).otherwise(0.0).alias("total_return"),
        n.alias("num_trades"),
        traded("hit_rate").alias("win_rate"),
        traded("avg_trade").alias("avg_return"),
        traded("max_drawdown").alias("max_drawdown"),
        traded("sharpe_ratio").alias("sharpe_ratio"),
        traded("profit_factor").alias("profit_factor"),
        F.coalesce("winning_trades", F.lit(0)).alias("winning_trades"),
        F.coalesce("losing_trades", F.lit(0)).alias("losing_trades"),
        traded("avg_win").alias("avg_win"),
        traded("avg_loss").alias("avg_loss"),
        "initial_capital", "final_capital",
    )
