"""Window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import bars as B
from tidemark.operators import windows as W
from tidemark.plans.chunks import Chunks, Series, over_chunks, running
from tidemark.registry.core import R, R_list, query, r, rounded
from tidemark.registry.tables import BAR_SERIES as S
from tidemark.registry.tables import bars, bars_dirty, equity, trials, with_views

KEYS = ["symbol", "ts"]
EQUITY = Series(keys=("strategy",))


def on_bars(name: str, make, before: int, cols: dict[str, str], extra: dict[str, str] | None = None):
    """A window query on the bars: ``make(chunks, rolling)`` in Spark, ``cols`` as SQL over the view ``ret`` (or ``extra``)."""
    source = list(extra)[-1] if extra else "ret"
    sql = with_views("ret", f"SELECT symbol, ts, {', '.join(f'{R(e)} AS {n}' for n, e in cols.items())} FROM {source}", extra)

    @query(name, sql)
    def run(spark, sf):
        c = Chunks(bars(spark, sf), S, before=before + 1)
        roll = W.bar_rolling(c)
        d = roll.add(c.df.withColumns(W.bar_terms(c)))
        return rounded(c.close(d.withColumns(make(c, roll))), KEYS, list(cols))


def plain(name: str, make, before: int, cols: dict[str, str]):
    """As :func:`on_bars` for features that need neither returns nor rolling sums."""

    @query(name, with_views("ret", f"SELECT symbol, ts, {', '.join(f'{R(e)} AS {n}' for n, e in cols.items())} FROM ret"))
    def run(spark, sf):
        return rounded(over_chunks(bars(spark, sf), S, make, before=before), KEYS, list(cols))


def win(n: int, expr: str) -> str:
    """SQL frame over the last n rows."""
    return f"{expr} OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n: int, expr: str, value: str) -> str:
    return f"CASE WHEN {win(n, f'count({value})')} = {n} THEN {expr} END"


def lag(col: str, n: int) -> str:
    return f"lag({col}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"


PREP = {
    "prep": """SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) AS d,
      (high + low + close) / 3 AS tp, (close - low) / nullif(high - low, 0) AS place FROM ret"""
}


def sql_rsi(n: int) -> str:
    g, l = win(n, "sum(greatest(d, 0))"), win(n, "sum(greatest(-d, 0))")
    return f"CASE WHEN {l} = 0 THEN CASE WHEN {g} > 0 THEN 100.0 END ELSE 100 - 100 / (1 + {g} / {l}) END"


def sql_vwap(n: int) -> str:
    return full(n, f"{win(n, 'sum(tp * volume)')} / nullif({win(n, 'sum(volume)')}, 0)", "tp")


def sql_vol(n: int) -> str:
    return full(n, win(n, "stddev_samp(ret)"), "ret")


def sql_mean(n: int, col: str) -> str:
    return full(n, win(n, f"avg({col})"), col)


def sql_var(n: int) -> str:
    return f"ret * ln(1 + volume / nullif({sql_mean(n, 'volume')}, 0))"


BB_MEAN, BB_STD = sql_mean(20, "close"), full(20, win(20, "stddev_samp(close)"), "close")
SQL_BB = {
    "bb_upper": f"{BB_MEAN} + 2 * {BB_STD}",
    "bb_lower": f"{BB_MEAN} - 2 * {BB_STD}",
    "bb_position": f"(close - ({BB_MEAN} - 2 * {BB_STD})) / nullif(4 * {BB_STD}, 0)",
}

SQL_VWAP = {n: sql_vwap(n) for n in (5, 10, 20)}

plain("w1_returns", W.returns, 60, {f"ret_{n}m": f"close / {lag('close', n)} - 1" for n in (1, 5, 15, 60)})
on_bars("w4_rsi", lambda c, x: {f"rsi_{n}": W.rsi(x, n) for n in (7, 14, 21)}, 21, {f"rsi_{n}": sql_rsi(n) for n in (7, 14, 21)}, PREP)
on_bars("w5_vwap", lambda c, x: {f"vwap_{n}": W.vwap(x, n) for n in (5, 10, 20)}, 20, {f"vwap_{n}": q for n, q in SQL_VWAP.items()}, PREP)
on_bars("w6_price_vwap_ratio", lambda c, x: {f"price_vwap_ratio_{n}": C.ratio("close", W.vwap(x, n)) for n in (5, 10, 20)}, 20,
        {f"price_vwap_ratio_{n}": f"close / nullif({q}, 0)" for n, q in SQL_VWAP.items()}, PREP)
on_bars("w7_volume_momentum", lambda c, x: {f"volume_momentum_{n}": W.volume_momentum(x, n) for n in (5, 10, 20)}, 20,
        {f"volume_momentum_{n}": full(n, win(n, "sum(ret * volume)"), "ret") for n in (5, 10, 20)}, PREP)
on_bars("w8_intraday_strength", lambda c, x: {f"intraday_strength_{n}": W.intraday_strength(x, n) for n in (5, 10, 20)}, 20,
        {f"intraday_strength_{n}": sql_mean(n, "place") for n in (5, 10, 20)}, PREP)
on_bars("w9_vol_adj_returns", lambda c, x: {f"vol_adj_returns_{n}": W.volume_adjusted_return(x, n) for n in (5, 10, 20)}, 20,
        {f"vol_adj_returns_{n}": sql_var(n) for n in (5, 10, 20)}, PREP)
on_bars("w11_volatility", lambda c, x: {"volatility_5m": W.volatility(c, 5), "volatility_20m": W.volatility(c, 20),
                                        "volatility_ratio": F.try_divide(W.volatility(c, 5), W.volatility(c, 20))}, 20,
        {"volatility_5m": sql_vol(5), "volatility_20m": sql_vol(20), "volatility_ratio": f"{sql_vol(5)} / nullif({sql_vol(20)}, 0)"})
on_bars("w12_volume_sma", lambda c, x: {"volume_sma_20": W.volume_mean(x), "volume_ratio_20": C.ratio("volume", W.volume_mean(x))}, 20,
        {"volume_sma_20": sql_mean(20, "volume"), "volume_ratio_20": f"volume / nullif({sql_mean(20, 'volume')}, 0)"})
plain("w13_volume_ma5", lambda c: {"volume_ma_5": F.avg("volume").over(c.last(5)), "volume_ratio": C.ratio("volume", F.avg("volume").over(c.last(5)))}, 4,
      {"volume_ma_5": win(5, "avg(volume)"), "volume_ratio": f"volume / nullif({win(5, 'avg(volume)')}, 0)"})
plain("w14_volume_change", W.volume_change, 20, {f"volume_change_{n}": f"volume / nullif({lag('volume', n)}, 0) - 1" for n in (5, 20)})
plain("w15_momentum_1h", lambda c: {"momentum_1h": W.momentum_1h(c)}, 59, {"momentum_1h": f"close / {lag('close', 59)} - 1"})
on_bars("w20_rolling_vol", lambda c, x: {"rolling_vol": W.volatility(c, 100)}, 100, {"rolling_vol": sql_vol(100)})


@query("w10_bollinger", with_views("ret", f"SELECT symbol, ts, {', '.join(f'{R(e)} AS {n}' for n, e in SQL_BB.items())} FROM ret"))
def w10(spark, sf):
    d = over_chunks(bars(spark, sf), S, lambda c: W.spread(c, "close", 20, "_c20"), before=19)
    return rounded(d.withColumns(W.bollinger_of("_c20")), KEYS, list(SQL_BB))


def sql_ema(spans=(5, 20, 50), digits: int | None = 6) -> str:
    """Weights of the recurrence written out: (1-a)^(t-i), the first row without the factor a."""
    def one(n):
        a = f"(2.0::DOUBLE / {n + 1})"
        e = f"sum(CASE WHEN i.rn = 1 THEN i.close ELSE {a} * i.close END * pow(1 - {a}, t.rn - i.rn))"
        return f"{R(e) if digits else e} AS ema_{n}"

    return f"SELECT t.symbol, t.ts, {', '.join(one(n) for n in spans)} FROM ret t JOIN ret i ON i.symbol = t.symbol AND i.rn <= t.rn GROUP BY 1, 2"


@query("w2_ema", with_views("ret", sql_ema()))
def w2(spark, sf):
    return rounded(W.ema(bars(spark, sf), S), KEYS, ["ema_5", "ema_20", "ema_50"])


@query("w3_ema_ratios", with_views("ret", f"""SELECT symbol, ts, {R('close / ema_5')} AS price_ema5_ratio,
    {R('close / ema_20')} AS price_ema20_ratio, {R('ema_5 / ema_20')} AS ema5_ema20_ratio FROM ret JOIN e USING (symbol, ts)""",
    {"e": sql_ema((5, 20), None)}))
def w3(spark, sf):
    d = W.ema(bars(spark, sf), S, spans=(5, 20))
    return d.select(*KEYS, r(C.ratio("close", "ema_5")).alias("price_ema5_ratio"),
                    r(C.ratio("close", "ema_20")).alias("price_ema20_ratio"), r(C.ratio("ema_5", "ema_20")).alias("ema5_ema20_ratio"))


MATRIX = {
    "returns": "ret", "ret_1m": "ret", **{f"ret_{n}m": f"close / {lag('close', n)} - 1" for n in (5, 15, 60)},
    **{f"rsi_{n}": sql_rsi(n) for n in (14, 7, 21)},
    **{k: v for n in (5, 10, 20) for k, v in {
        f"vwap_{n}": sql_vwap(n), f"price_vwap_ratio_{n}": f"close / nullif({sql_vwap(n)}, 0)",
        f"volume_momentum_{n}": full(n, win(n, "sum(ret * volume)"), "ret"),
        f"intraday_strength_{n}": sql_mean(n, "place"), f"vol_adj_returns_{n}": sql_var(n)}.items()},
    **SQL_BB,
    "volatility_5m": sql_vol(5), "volatility_20m": sql_vol(20), "volatility_ratio": f"{sql_vol(5)} / nullif({sql_vol(20)}, 0)",
    "volume_sma_20": sql_mean(20, "volume"), "volume_ratio_20": f"volume / nullif({sql_mean(20, 'volume')}, 0)",
    "high_low_ratio": "high / low", "open_close_ratio": "open / close",
    "ema_5": "ema_5", "ema_20": "ema_20", "ema_50": "ema_50",
    "price_ema5_ratio": "close / ema_5", "price_ema20_ratio": "close / ema_20", "ema5_ema20_ratio": "ema_5 / ema_20",
}


@query("w16_feature_matrix", with_views(
    "ret", f"SELECT symbol, ts, {', '.join(f'{R(e)} AS {n}' for n, e in MATRIX.items())} FROM prep JOIN e USING (symbol, ts)",
    {**PREP, "e": sql_ema(digits=None)}))
def w16(spark, sf):
    return rounded(W.feature_matrix(bars(spark, sf), S), KEYS, list(MATRIX))


def sql_gap_ema(spans=(5, 20, 50)) -> dict[str, str]:
    """The recurrence over the closes there are, with the weight of the average before a gap, carried over missing rows."""
    step = ", ".join(f"(pow(1 - 2.0::DOUBLE / {n + 1}, g) * w.ema_{n} + 2.0::DOUBLE / {n + 1} * close) / (pow(1 - 2.0::DOUBLE / {n + 1}, g) + 2.0::DOUBLE / {n + 1})" for n in spans)
    return {
        "obs": "SELECT symbol, rn, close, row_number() OVER w AS k, rn - lag(rn) OVER w AS g FROM prep WHERE close IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY rn)",
        "walk": f"SELECT symbol, k, rn, {', '.join(f'close AS ema_{n}' for n in spans)} FROM obs WHERE k = 1 UNION ALL SELECT o.symbol, o.k, o.rn, {step} FROM walk w JOIN obs o ON o.symbol = w.symbol AND o.k = w.k + 1",
        "e": f"SELECT p.symbol, p.ts, {', '.join(f'w.ema_{n}' for n in spans)} FROM prep p ASOF LEFT JOIN walk w ON p.symbol = w.symbol AND p.rn >= w.rn",
    }


@query("w16_feature_matrix_dirty", with_views(
    "dirty", f"SELECT symbol, ts, {', '.join(f'{R(e)} AS {n}' for n, e in MATRIX.items())} FROM prep JOIN e USING (symbol, ts)",
    {"gaps": """SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM dirty WHERE copy = 0""",
     "prep": PREP["prep"].replace("FROM ret", "FROM gaps"), **sql_gap_ema()}, recursive=True))
def w16_dirty(spark, sf):
    """The matrix over bars with missing closes, zero volumes and swapped highs and lows."""
    return rounded(W.feature_matrix(bars_dirty(spark, sf).where("copy = 0").drop("copy"), S), KEYS, list(MATRIX))


@query("w17_drawdown_series", with_views("er", f"SELECT strategy, ts, {R('peak')} AS running_max, {R('equity / peak - 1')} AS drawdown FROM er"))
def w17(spark, sf):
    d = running(equity(spark, sf), EQUITY, {"running_max": ("max", F.col("equity"))})
    return d.select("strategy", "ts", r("running_max").alias("running_max"), r(C.ratio("equity", "running_max") - 1).alias("drawdown"))


@query("w18_best_so_far", with_views("trials", f"""SELECT study, trial,
    {R('max(value) OVER (PARTITION BY study ORDER BY trial ROWS UNBOUNDED PRECEDING)')} AS best FROM trials"""))
def w18(spark, sf):
    from tidemark.operators.search import TRIALS

    d = running(trials(spark, sf), TRIALS, {"best": ("max", F.col("value"))})
    return d.select("study", "trial", r("best").alias("best"))


@query("w19_rolling_slope", with_views("er", f"""SELECT strategy, ts, {R("CASE WHEN count(*) OVER w = 50 THEN regr_slope(equity, rn) OVER w END")} AS slope
    FROM er WINDOW w AS (PARTITION BY strategy ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""))
def w19(spark, sf):
    from tidemark.operators.regimes import add_rolling_slope

    d = add_rolling_slope(equity(spark, sf), EQUITY, 50)
    return d.select("strategy", "ts", r("rolling_slope").alias("slope"))


SEQ_SQL = f"""SELECT symbol, ts, {R('list_sum(flatten(seq))', 4)} AS total, CAST(len(seq) AS INTEGER) AS steps,
    {R('seq[1][1]')} AS first_open, {R('seq[len(seq)][2]')} AS last_close, CAST(y AS DOUBLE) AS target FROM s WHERE %s"""
SEQ_STEP = """SELECT symbol, ts, rn, cnt, CASE WHEN lead(close, 3) OVER o IS NOT NULL THEN CAST(lead(close, 3) OVER o > close AS INTEGER) END AS y,
    list([open, close]) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS seq
    FROM ret WINDOW o AS (PARTITION BY symbol ORDER BY ts)"""


def _seq_out(d):
    flat = F.flatten("seq")
    return d.select(*KEYS, r(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("seq").alias("steps"),
                    r(F.col("seq")[0][0]).alias("first_open"), r(F.element_at(F.element_at("seq", -1), -1)).alias("last_close"), F.col("target").cast("double").alias("target"))


def _with_label(spark, sf):
    from tidemark.operators.labels import sign_return_label

    return sign_return_label(bars(spark, sf), S, 3)


@query("w21_sliding_sequences", with_views("ret", SEQ_SQL % "rn >= 30 AND (rn - 30) % 7 = 0", {"s": SEQ_STEP}))
def w21(spark, sf):
    return _seq_out(W.sliding_sequences(_with_label(spark, sf), S, ["open", "close"], 30, 7, "y"))


@query("w22_padded_sequences", with_views("ret", SEQ_SQL % "rn >= 30 AND y IS NOT NULL", {"s": SEQ_STEP}))
def w22(spark, sf):
    return _seq_out(W.padded_sequences(_with_label(spark, sf), S, ["open", "close"], 30, "y"))
