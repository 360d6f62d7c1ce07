"""Volatility and trend regimes and the performance inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.windows import rolling_slope, volatility
from tidemark.plans.chunks import Chunks, Series
from tidemark.plans.quantiles import exact_percentiles
from tidemark.session import stage

VOL_REGIMES = ("low_vol", "medium_vol", "high_vol")
TREND_REGIMES = ("downtrend", "sideways", "uptrend")


def add_rolling_slope(df: DataFrame, series: Series, n: int = 50, col: str = "equity") -> DataFrame:
    c = Chunks(df, series, before=n - 1)
    d = c.df.withColumn("_at", c.position.cast("double"))
    return c.close(d.withColumn("rolling_slope", rolling_slope(c, col, n))).drop("_at")


def _by_thirds(df: DataFrame, keys: list[str], col: str, names: tuple[str, ...], out: str) -> DataFrame:
    q = exact_percentiles(df, keys, F.col(col), {"_q1": 0.33, "_q2": 0.67})
    name = (
        F.when(F.col(col).isNull(), "unknown")
        .when(F.col(col) <= F.col("_q1"), names[0])
        .when(F.col(col) <= F.col("_q2"), names[1])
        .otherwise(names[2])
    )
    return df.join(q, keys, "left").withColumn(out, name).drop("_q1", "_q2")


def vol_regime(df: DataFrame, series: Series, n: int = 100, col: str = "equity") -> DataFrame:
    """Rolling deviation of returns, cut at its .33 and .67 quantiles per series."""
    c = Chunks(df, series, before=n)
    d = c.df.withColumn("returns", ratio(col, F.lag(col).over(c.window)) - 1)
    d = stage(c.close(d.withColumn("rolling_vol", volatility(c, n))), "regimes")
    return _by_thirds(d, list(series.keys), "rolling_vol", VOL_REGIMES, "vol_regime")


def trend_regime(df: DataFrame, series: Series, n: int = 50, col: str = "equity") -> DataFrame:
    """Rolling slope, cut at its .33 and .67 quantiles per series."""
    d = stage(add_rolling_slope(df, series, n, col), "regimes")
    return _by_thirds(d, list(series.keys), "rolling_slope", TREND_REGIMES, "trend_regime")


def label_regimes(df: DataFrame, series: Series, vol_n: int = 100, trend_n: int = 50, col: str = "equity") -> DataFrame:
    """Both regimes in one layout of the rows."""
    keys = list(series.keys)
    c = Chunks(df, series, before=max(vol_n, trend_n))
    d = c.df.withColumns({"returns": ratio(col, F.lag(col).over(c.window)) - 1, "_at": c.position.cast("double")})
    d = d.withColumns({"rolling_vol": volatility(c, vol_n), "rolling_slope": rolling_slope(c, col, trend_n)})
    d = stage(c.close(d).drop("_at"), "regimes")
    d = _by_thirds(d, keys, "rolling_vol", VOL_REGIMES, "vol_regime")
    return _by_thirds(d, keys, "rolling_slope", TREND_REGIMES, "trend_regime")


def regime_performance(df: DataFrame, keys: tuple[str, ...] = ("strategy",), ret: str = "returns") -> DataFrame:
    """Statistics per volatility regime, trend regime and their combination, from one expand and one shuffle."""
    k = [F.col(x) for x in keys]
    known = lambda c: F.when(F.col(c) != "unknown", F.col(c))
    d = df.select(*keys, known("vol_regime").alias("v"), known("trend_regime").alias("t"), F.col(ret).alias("r"))
    r = F.col("r")
    dev = F.stddev_samp(r)
    g = d.groupingSets([[*k, F.col("v")], [*k, F.col("t")], [*k, F.col("v"), F.col("t")]], *k, F.col("v"), F.col("t")).agg(
        F.grouping("v").alias("_gv"),
        F.grouping("t").alias("_gt"),
        F.count(F.lit(1)).alias("n"),
        F.avg(r).alias("mean_return"),
        dev.alias("std_return"),
        F.when(dev > 0, F.try_divide(F.avg(r), dev)).otherwise(F.lit(0.0)).alias("sharpe"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("win_rate"),
        (F.coalesce(F.product(1 + r), F.lit(1.0)) - 1).alias("total_return"),
    )
    g = g.filter(((F.col("_gv") == 1) | F.col("v").isNotNull()) & ((F.col("_gt") == 1) | F.col("t").isNotNull()))
    kind = F.when(F.col("_gt") == 1, "volatility").when(F.col("_gv") == 1, "trend").otherwise("combined")
    return g.select(
        *keys, kind.alias("kind"), F.concat_ws("_", "v", "t").alias("regime"),
        "n", "mean_return", "std_return", "sharpe", "win_rate", "total_return",
    )


# Fixed order in which regimes of equal Sharpe win.
_ORDER = {r: i for i, r in enumerate((*VOL_REGIMES, *TREND_REGIMES))}


def _order(col: Column) -> Column:
    out = F.lit(len(_ORDER))
    for name, i in _ORDER.items():
        out = F.when(col == name, F.lit(i)).otherwise(out)
    return out


def regime_extremes(perf: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Best and worst regime by Sharpe, the spread over regimes, and consistent / unstable marks."""
    single = perf.filter(F.col("kind") != "combined")
    aggs = []
    for kind, name in (("volatility", "vol"), ("trend", "trend")):
        this = F.when(F.col("kind") == kind, F.col("regime"))
        place = _order(F.col("regime"))
        at = F.when(F.col("kind") == kind, F.struct(F.col("sharpe"), -place))
        low = F.when(F.col("kind") == kind, F.struct(F.col("sharpe"), place))
        aggs += [F.max_by(this, at).alias(f"best_{name}"), F.min_by(this, low).alias(f"worst_{name}")]
    d = single.groupBy(*keys).agg(
        *aggs, F.stddev_pop("sharpe").alias("sharpe_std"), F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("regime") == "high_vol", F.col("sharpe"))).alias("high_vol_sharpe"),
    )
    many = F.col("_n") > 1
    return d.withColumns(
        {"consistent": many & (F.col("sharpe_std") < 0.1), "unstable": many & (F.col("sharpe_std") > 0.5)}
    ).drop("_n")


def regime_insights(extremes: DataFrame, name: str = "strategy") -> DataFrame:
    """Three rule-based lines over all strategies; a line without ground is left out and made up for at the end. Of tied strategies the first by name."""
    d = extremes.agg(
        F.min(F.when(F.col("consistent"), F.col(name))).alias("steady"),
        F.min(F.when(F.col("unstable"), F.col(name))).alias("shaky"),
        F.mode("best_vol", deterministic=True).alias("best"),
        F.mode("worst_vol", deterministic=True).alias("worst"),
        F.avg("high_vol_sharpe").alias("high"),
        F.min_by(name, F.when(F.col("high_vol_sharpe").isNotNull(), F.struct((-F.col("high_vol_sharpe")).alias("less"), F.col(name).alias("name")))).alias("high_name"),
        F.max("high_vol_sharpe").alias("high_best"),
    )
    more = F.lit("not enough regime data: use longer back-tests")
    first = F.when(F.col("steady").isNotNull(), F.format_string("%s is stable across regimes: consider a larger allocation", "steady")).when(
        F.col("best").isNotNull(), F.format_string("most strategies do best in %s: size positions by regime", "best")
    )
    second = F.when(F.col("shaky").isNotNull(), F.format_string("%s varies much across regimes: review features or combine models", "shaky")).when(
        F.col("worst").isNotNull(), F.format_string("several strategies struggle in %s: add features or filters for it", "worst")
    )
    third = F.when(F.col("high") < 0, F.format_string("high volatility hurts (average Sharpe %.3f): adapt features or stops", "high")).when(
        F.col("high").isNotNull(), F.format_string("%s does well in high volatility (Sharpe %.3f): select models by volatility", "high_name", "high_best")
    )
    lines = F.slice(F.concat(F.array_compact(F.array(first, second, third)), F.array(more, more, more)), 1, 3)
    return d.select(F.posexplode(lines).alias("rank", "insight")).withColumn("rank", F.col("rank") + 1)


def current_regime(
    df: DataFrame, series: Series, cols: list[str], window: int = 20, threshold: float = 0.02, short: int = 10, long: int = 30
) -> DataFrame:
    """Regime at the last row: mean rolling deviation of the features against 1.5 times the threshold, then
    the mean of the short averages against the long ones. Reads the newest rows of each series only."""
    keys = list(series.keys)
    newest = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in series.order])
    d = df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= max(window, long))

    def mean_of(agg, n):
        inside = lambda c: F.when(F.col("_rank") <= n, F.col(c))
        parts = [F.when(F.count(inside(c)) == n, agg(inside(c))) for c in cols]
        have = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
        total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
        return F.when(have > 0, total / have)

    g = d.groupBy(*keys).agg(
        mean_of(F.stddev_samp, window).alias("volatility"), mean_of(F.avg, short).alias("sma_short"), mean_of(F.avg, long).alias("sma_long")
    )
    regime = (
        F.when(F.col("volatility") > threshold * 1.5, "high_volatility")
        .when(F.col("sma_short") > F.col("sma_long"), "bull_trend")
        .otherwise("bear_trend")
    )
    return g.withColumn("regime", regime)
