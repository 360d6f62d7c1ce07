"""Performance metrics and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import regimes as G
from tidemark.plans.quantiles import exact_percentiles
from tidemark.registry.core import R, R_list, query, r, rounded
from tidemark.registry.tables import bars, equity, with_views
from tidemark.session import stage

S = M.STRATEGY
K = ["strategy"]
P = 252 * 24 * 60
INF = "'Infinity'::DOUBLE"

SQL_SHARPE = f"CASE WHEN stddev_pop(ret) = 0 OR count(ret) = 0 THEN 0 ELSE avg(ret) / stddev_pop(ret) * sqrt({P}) END"
SQL_DOWN = "coalesce(stddev_pop(ret) FILTER (ret < 0), 0)"
SQL_SORTINO = f"CASE WHEN {SQL_DOWN} = 0 THEN CASE WHEN avg(ret) > 0 THEN {INF} ELSE 0 END ELSE avg(ret) / ({SQL_DOWN}) * sqrt({P}) END"
SQL_PF = f"CASE WHEN coalesce(sum(ret) FILTER (ret < 0), 0) < 0 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / abs(sum(ret) FILTER (ret < 0)) WHEN sum(ret) FILTER (ret > 0) > 0 THEN {INF} ELSE 0 END"

DD = {
    "worst": "SELECT * FROM (SELECT *, equity - peak AS dd, row_number() OVER (PARTITION BY strategy ORDER BY equity - peak, ts) AS pick FROM er) WHERE pick = 1",
    "mdd": """SELECT w.strategy, any_value(w.dd) AS max_drawdown, any_value(w.dd / w.peak) AS max_drawdown_pct,
      any_value(w.rn) - max(e.rn) AS drawdown_duration, any_value(w.peak) AS peak_value, any_value(w.equity) AS trough_value
      FROM worst w JOIN er e ON e.strategy = w.strategy AND e.rn <= w.rn AND e.equity = e.peak GROUP BY 1""",
}
TAIL = {
    "va": "SELECT strategy, quantile_cont(ret, 0.05) AS var FROM er GROUP BY 1",
    "cv": "SELECT strategy, any_value(var) AS var, avg(ret) FILTER (ret <= var) AS cvar FROM er JOIN va USING (strategy) GROUP BY 1",
}


def returns(spark, sf):
    return M.period_returns(equity(spark, sf), S)


@query("m1_period_returns", with_views("er", f"SELECT strategy, ts, {R('ret')} AS ret FROM er"))
def m1(spark, sf):
    return returns(spark, sf).select("strategy", "ts", r("ret").alias("ret"))


def simple(name: str, col: str, agg, sql: str, digits: int = 6):
    @query(name, with_views("er", f"SELECT strategy, {R(sql, digits)} AS {col} FROM er GROUP BY 1"))
    def run(spark, sf):
        return returns(spark, sf).groupBy("strategy").agg(r(agg(F.col("ret")), digits).alias(col))


simple("m2_sharpe", "sharpe", M.sharpe, SQL_SHARPE)
simple("m3_sortino", "sortino", M.sortino, SQL_SORTINO)
simple("m5_profit_factor", "profit_factor", M.profit_factor, SQL_PF)
simple("m6_hit_rate", "hit_rate", M.hit_rate, "avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INTEGER) END)")


@query("m4_max_drawdown", with_views("er", f"""SELECT strategy, {R_list(['max_drawdown', 'max_drawdown_pct'])}, drawdown_duration,
    {R_list(['peak_value', 'trough_value'])} FROM mdd""", DD))
def m4(spark, sf):
    d = M.max_drawdown(equity(spark, sf), S)
    return rounded(d, ["strategy", "drawdown_duration"], ["max_drawdown", "max_drawdown_pct", "peak_value", "trough_value"])


SQL_CALMAR = f"CASE WHEN max_drawdown_pct = 0 THEN CASE WHEN m > 0 THEN {INF} ELSE 0 END ELSE m * {P} / abs(max_drawdown_pct) END"


@query("m7_calmar", with_views("er", f"SELECT strategy, {R(SQL_CALMAR)} AS calmar FROM mdd JOIN (SELECT strategy, avg(ret) AS m FROM er GROUP BY 1) USING (strategy)", DD))
def m7(spark, sf):
    d = returns(spark, sf).groupBy("strategy").agg(F.avg("ret").alias("m")).join(M.max_drawdown(equity(spark, sf), S), K)
    return d.select("strategy", r(M.calmar(F.col("m"), F.col("max_drawdown_pct"))).alias("calmar"))


@query("m8_value_at_risk", with_views("er", f"SELECT strategy, {R('quantile_cont(ret, 0.05)')} AS var_95, {R('quantile_cont(ret, 0.01)')} AS var_99 FROM er GROUP BY 1"))
def m8(spark, sf):
    d = exact_percentiles(stage(returns(spark, sf), "returns"), K, F.col("ret"), {"var_95": 0.05, "var_99": 0.01})
    return rounded(d, K, ["var_95", "var_99"])


@query("m9_cvar", with_views("er", f"SELECT strategy, {R('var')} AS var, {R('cvar')} AS cvar FROM cv", TAIL))
def m9(spark, sf):
    return rounded(M.cvar(stage(returns(spark, sf), "returns"), K), K, ["var", "cvar"])


TRADE_COLS = ["hit_rate", "avg_win", "avg_loss", "largest_win", "largest_loss", "profit_factor", "avg_trade", "win_loss_ratio"]


def sql_trade_metrics(key: str, ret: str, source: str) -> str:
    w, l = f"FILTER ({ret} > 0)", f"FILTER ({ret} < 0)"
    return f"""SELECT {key}, count({ret}) AS total_trades, count({ret}) {w} AS winning_trades, count({ret}) {l} AS losing_trades,
      avg(CASE WHEN {ret} IS NOT NULL THEN CAST({ret} > 0 AS INTEGER) END) AS hit_rate, coalesce(avg({ret}) {w}, 0) AS avg_win,
      coalesce(avg({ret}) {l}, 0) AS avg_loss, coalesce(max({ret}) {w}, 0) AS largest_win, coalesce(min({ret}) {l}, 0) AS largest_loss,
      CASE WHEN coalesce(sum({ret}) {l}, 0) < 0 THEN coalesce(sum({ret}) {w}, 0) / abs(sum({ret}) {l}) WHEN sum({ret}) {w} > 0 THEN {INF} ELSE 0 END AS profit_factor,
      avg({ret}) AS avg_trade,
      CASE WHEN coalesce(avg({ret}) {l}, 0) <> 0 THEN abs(coalesce(avg({ret}) {w}, 0) / avg({ret}) {l}) WHEN coalesce(avg({ret}) {w}, 0) > 0 THEN {INF} ELSE 0 END AS win_loss_ratio
      FROM {source} GROUP BY {key}"""


@query("m10_trade_metrics", with_views("er", f"SELECT strategy, total_trades, winning_trades, losing_trades, {R_list(TRADE_COLS)} FROM tm", {"tm": sql_trade_metrics("strategy", "ret", "er")}))
def m10(spark, sf):
    d = M.trade_metrics(returns(spark, sf), K, "ret")
    return rounded(d, ["strategy", "total_trades", "winning_trades", "losing_trades"], TRADE_COLS)


CORE = {
    **DD, **TAIL,
    "core": f"""SELECT strategy, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, avg(ret) AS m, stddev_pop(ret) AS dev,
      {SQL_SHARPE} AS sharpe_ratio, {SQL_SORTINO} AS sortino_ratio, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis FROM er GROUP BY 1""",
    "pm": f"SELECT *, {SQL_CALMAR} AS calmar_ratio FROM core JOIN mdd USING (strategy) JOIN cv USING (strategy)",
}
PM = {
    "total_return": "total_return", "annualized_return": f"m * {P}", "volatility": f"dev * sqrt({P})", "sharpe_ratio": "sharpe_ratio",
    "sortino_ratio": "sortino_ratio", "calmar_ratio": "calmar_ratio", "max_drawdown": "max_drawdown", "max_drawdown_pct": "max_drawdown_pct",
    "var_95": "var", "cvar_95": "cvar", "skewness": "skewness", "kurtosis": "kurtosis",
}


@query("m11_portfolio_metrics", with_views("er", f"SELECT strategy, drawdown_duration, {', '.join(f'{R(e)} AS {n}' for n, e in PM.items())} FROM pm", CORE))
def m11(spark, sf):
    return rounded(M.portfolio_metrics(equity(spark, sf), S), ["strategy", "drawdown_duration"], list(PM))


BENCH = {
    "bench": "SELECT ts, ret AS b FROM er WHERE strategy = 'view' AND ret IS NOT NULL",
    "bs": """SELECT strategy, count(*) AS n, covar_samp(ret, b) / var_pop(b) AS beta,
      avg(ret) - covar_samp(ret, b) / var_pop(b) * avg(b) AS alpha, corr(ret, b) AS correlation
      FROM er JOIN bench USING (ts) WHERE ret IS NOT NULL AND strategy <> 'view' GROUP BY 1""",
}


@query("m12_benchmark_stats", with_views("er", f"SELECT strategy, n, {R_list(['beta', 'alpha', 'correlation'])} FROM bs", BENCH))
def m12(spark, sf):
    d = returns(spark, sf)
    bench = d.filter(F.col("strategy") == "view").select("ts", F.col("ret").alias("bench_ret"))
    return rounded(M.benchmark_stats(d.filter(F.col("strategy") != "view"), bench), ["strategy", "n"], ["beta", "alpha", "correlation"])


RM = {
    "total_return": "total_return * 100", "sharpe_ratio": "sharpe_ratio", "sortino_ratio": "sortino_ratio", "max_drawdown": "abs(max_drawdown_pct) * 100",
    "calmar_ratio": "calmar_ratio", "var_95": "var * 100", "cvar_95": "cvar * 100", "volatility": "dev * sqrt(252) * 100", "skewness": "skewness", "kurtosis": "kurtosis",
}


@query("m13_report_metrics", with_views("er", f"SELECT strategy, {', '.join(f'{R(e, 5)} AS {n}' for n, e in RM.items())} FROM pm", CORE))
def m13(spark, sf):
    return rounded(M.report_metrics(equity(spark, sf), S), K, list(RM), 5)


def sql_daily(key: str, source: str) -> dict[str, str]:
    """Daily Sharpe of a table with ``key``, ts, equity (several days, some variance)."""
    return {
        "daily": f"SELECT {key}, date_trunc('day', ts) AS day, arg_max(equity, ts) AS eq FROM {source} GROUP BY ALL",
        "dr": f"SELECT {key}, eq / lag(eq) OVER (PARTITION BY {key} ORDER BY day) - 1 AS x FROM daily",
        "ds": f"SELECT {key}, CASE WHEN count(x) > 1 AND stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(252) ELSE 0 END AS sharpe_ratio FROM dr GROUP BY ALL",
    }


@query("m14_daily_sharpe", with_views("er", f"SELECT strategy, {R('sharpe_ratio')} AS sharpe_ratio FROM ds", sql_daily("strategy", "er")))
def m14(spark, sf):
    return rounded(M.daily_sharpe(equity(spark, sf), S), K, ["sharpe_ratio"])


# --- regimes -----------------------------------------------------------------------------------

REG = {
    "rv": """SELECT *, CASE WHEN count(ret) OVER v = 100 THEN stddev_samp(ret) OVER v END AS rolling_vol,
      CASE WHEN count(*) OVER t = 50 THEN regr_slope(equity, rn) OVER t END AS rolling_slope FROM er
      WINDOW v AS (PARTITION BY strategy ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),
             t AS (PARTITION BY strategy ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "qs": """SELECT strategy, quantile_cont(rolling_vol, 0.33) AS v1, quantile_cont(rolling_vol, 0.67) AS v2,
      quantile_cont(rolling_slope, 0.33) AS s1, quantile_cont(rolling_slope, 0.67) AS s2 FROM rv GROUP BY 1""",
    "rg": """SELECT *, CASE WHEN rolling_vol IS NULL THEN 'unknown' WHEN rolling_vol <= v1 + 1e-12 THEN 'low_vol' WHEN rolling_vol <= v2 + 1e-12 THEN 'medium_vol' ELSE 'high_vol' END AS vol_regime,
      CASE WHEN rolling_slope IS NULL THEN 'unknown' WHEN rolling_slope <= s1 + 1e-9 THEN 'downtrend' WHEN rolling_slope <= s2 + 1e-9 THEN 'sideways' ELSE 'uptrend' END AS trend_regime
      FROM rv JOIN qs USING (strategy)""",
}


@query("r1_vol_regime", with_views("er", f"SELECT strategy, ts, {R('rolling_vol', 8)} AS rolling_vol, vol_regime FROM rg", REG))
def r1(spark, sf):
    return G.vol_regime(equity(spark, sf), S).select("strategy", "ts", r("rolling_vol", 8).alias("rolling_vol"), "vol_regime")


@query("r2_trend_regime", with_views("er", f"SELECT strategy, ts, {R('rolling_slope')} AS rolling_slope, trend_regime FROM rg", REG))
def r2(spark, sf):
    return G.trend_regime(equity(spark, sf), S).select("strategy", "ts", r("rolling_slope").alias("rolling_slope"), "trend_regime")


PERF_AGG = """count(*) AS n, avg(ret) AS mean_return, stddev_samp(ret) AS std_return,
    CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE 0 END AS sharpe, avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INTEGER) END) AS win_rate,
    exp(coalesce(sum(ln(1 + ret)), 0)) - 1 AS total_return"""
PERF = {**REG, "perf": f"""SELECT strategy, 'volatility' AS kind, vol_regime AS regime, {PERF_AGG} FROM rg WHERE vol_regime <> 'unknown' GROUP BY 1, 2, 3
    UNION ALL SELECT strategy, 'trend', trend_regime, {PERF_AGG} FROM rg WHERE trend_regime <> 'unknown' GROUP BY 1, 2, 3
    UNION ALL SELECT strategy, 'combined', vol_regime || '_' || trend_regime, {PERF_AGG} FROM rg WHERE vol_regime <> 'unknown' AND trend_regime <> 'unknown' GROUP BY 1, 2, 3"""}
PCOLS = ["mean_return", "std_return", "sharpe", "win_rate", "total_return"]


def perf(spark, sf):
    return G.regime_performance(G.label_regimes(equity(spark, sf), S))


@query("r3_regime_performance", with_views("er", f"SELECT strategy, kind, regime, n, {R_list(PCOLS)} FROM perf", PERF))
def r3(spark, sf):
    return rounded(perf(spark, sf), ["strategy", "kind", "regime", "n"], PCOLS)


@query("r4_regime_extremes", with_views("er", f"""SELECT strategy, arg_max(regime, sharpe) FILTER (kind = 'volatility') AS best_vol, arg_min(regime, sharpe) FILTER (kind = 'volatility') AS worst_vol,
    arg_max(regime, sharpe) FILTER (kind = 'trend') AS best_trend, arg_min(regime, sharpe) FILTER (kind = 'trend') AS worst_trend,
    {R('stddev_pop(sharpe)')} AS sharpe_std, {R("max(sharpe) FILTER (regime = 'high_vol')")} AS high_vol_sharpe,
    stddev_pop(sharpe) < 0.1 AS consistent, stddev_pop(sharpe) > 0.5 AS unstable FROM perf WHERE kind <> 'combined' GROUP BY 1""", PERF))
def r4(spark, sf):
    d = G.regime_extremes(perf(spark, sf))
    return d.select("strategy", "best_vol", "worst_vol", "best_trend", "worst_trend", r("sharpe_std").alias("sharpe_std"),
                    r("high_vol_sharpe").alias("high_vol_sharpe"), "consistent", "unstable")


# The mode with the smallest name where several regimes are as frequent.
INSIGHT = {**PERF, "ext": """SELECT strategy, arg_max(regime, sharpe) FILTER (kind = 'volatility') AS best_vol, arg_min(regime, sharpe) FILTER (kind = 'volatility') AS worst_vol,
    max(sharpe) FILTER (regime = 'high_vol') AS high, stddev_pop(sharpe) < 0.1 AS consistent, stddev_pop(sharpe) > 0.5 AS unstable FROM perf WHERE kind <> 'combined' GROUP BY 1""",
    "ins": """SELECT min(strategy) FILTER (consistent) AS steady, min(strategy) FILTER (unstable) AS shaky,
    (SELECT best_vol FROM ext GROUP BY 1 ORDER BY count(*) DESC, best_vol LIMIT 1) AS best, (SELECT worst_vol FROM ext GROUP BY 1 ORDER BY count(*) DESC, worst_vol LIMIT 1) AS worst,
    avg(high) AS high, arg_min(strategy, struct_pack(less := -high, name := strategy)) FILTER (high IS NOT NULL) AS high_name, max(high) AS high_best FROM ext"""}


@query("r5_regime_insights", with_views("er", """SELECT CAST(rank AS INTEGER) AS rank, lines[rank] AS insight FROM (SELECT list_filter([
      CASE WHEN steady IS NOT NULL THEN steady || ' is stable across regimes: consider a larger allocation' WHEN best IS NOT NULL THEN 'most strategies do best in ' || best || ': size positions by regime' END,
      CASE WHEN shaky IS NOT NULL THEN shaky || ' varies much across regimes: review features or combine models' WHEN worst IS NOT NULL THEN 'several strategies struggle in ' || worst || ': add features or filters for it' END,
      CASE WHEN high < 0 THEN format('high volatility hurts (average Sharpe {:.3f}): adapt features or stops', high) WHEN high IS NOT NULL THEN format('{} does well in high volatility (Sharpe {:.3f}): select models by volatility', high_name, high_best) END
    ], lambda x: x IS NOT NULL) || ['not enough regime data: use longer back-tests', 'not enough regime data: use longer back-tests', 'not enough regime data: use longer back-tests'] AS lines FROM ins), (VALUES (1), (2), (3)) v(rank)""", INSIGHT))
def r5(spark, sf):
    return G.regime_insights(G.regime_extremes(perf(spark, sf)))


RF = ("open", "high", "low", "close")


@query("r6_current_regime", with_views("ret", f"""SELECT symbol, {R('volatility')} AS volatility, {R('s10')} AS sma_short, {R('s30')} AS sma_long,
    CASE WHEN volatility > 0.02 * 1.5 THEN 'high_volatility' WHEN s10 > s30 THEN 'bull_trend' ELSE 'bear_trend' END AS regime FROM (
    SELECT symbol, ({' + '.join(f'stddev_samp({c}) FILTER (cnt - rn < 20)' for c in RF)}) / 4 AS volatility,
      ({' + '.join(f'avg({c}) FILTER (cnt - rn < 10)' for c in RF)}) / 4 AS s10, ({' + '.join(f'avg({c}) FILTER (cnt - rn < 30)' for c in RF)}) / 4 AS s30 FROM ret GROUP BY 1)"""))
def r6(spark, sf):
    from tidemark.registry.tables import BAR_SERIES

    d = G.current_regime(bars(spark, sf), BAR_SERIES, list(RF))
    return rounded(d, ["symbol", "regime"], ["volatility", "sma_short", "sma_long"])
