"""Signals to trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import trades as B
from tidemark.registry.core import R, R_list, query, r, rounded
from tidemark.registry.metrics import TRADE_COLS, sql_daily, sql_trade_metrics
from tidemark.registry.tables import BAR_SERIES as S
from tidemark.registry.tables import bars, once, predictions, with_views

RULES = B.TradeRules(threshold=0.6, take_profit=0.02, stop_loss=0.01, timeout=12, commission=0.001, position_size=0.5)
PC, CM, CAP = RULES.position_size, RULES.commission, RULES.initial_capital


def exits_sql(side: str, profit: str = "0.02", stop: str = "0.01", timeout: int = 12) -> dict[str, str]:
    up, down = (f"(1 + {profit}::DOUBLE)", f"(1 - {stop}::DOUBLE)") if side == "long" else (f"(1 - {profit}::DOUBLE)", f"(1 + {stop}::DOUBLE)")
    win, lose = (">=", "<=") if side == "long" else ("<=", ">=")
    ret = "(x.close - h.close) / h.close" if side == "long" else "(h.close - x.close) / h.close"
    return {
        "hit": f"""SELECT t.symbol, t.ts, t.close, t.rn, t.cnt, min(CASE WHEN f.close {win} t.close * {up} THEN f.rn END) AS w,
          min(CASE WHEN f.close {lose} t.close * {down} THEN f.rn END) AS l, CASE WHEN t.rn + {timeout} <= t.cnt THEN t.rn + {timeout} END AS o
          FROM ret t LEFT JOIN ret f ON f.symbol = t.symbol AND f.rn BETWEEN t.rn + 1 AND t.rn + {timeout} GROUP BY ALL""",
        "ex": f"""SELECT h.symbol, h.ts AS entry_ts, h.close AS entry_price, h.rn AS rn, x.rn AS xrn, x.ts AS exit_ts, x.close AS exit_price,
          x.rn - h.rn AS bars_held, {ret} AS return_pct, CASE WHEN w IS NULL AND l IS NULL AND o IS NULL THEN 'market_close'
            WHEN w <= least(w, l, o) THEN 'take_profit' WHEN l <= least(w, l, o) THEN 'stop_loss' ELSE 'timeout' END AS exit_reason
          FROM hit h JOIN ret x ON x.symbol = h.symbol AND x.rn = coalesce(least(h.w, h.l, h.o), h.cnt)""",
    }


CAND = {**exits_sql("long"), "cand": """SELECT e.*, model, row_number() OVER (PARTITION BY e.symbol, model ORDER BY e.rn) AS k,
    CASE WHEN exit_reason = 'market_close' THEN 1000000000 ELSE xrn END AS free FROM predictions p JOIN ex e ON e.symbol = p.symbol AND e.entry_ts = p.ts WHERE prob > 0.6"""}
CHAIN = {
    **CAND,
    "nxt": """SELECT c.symbol, c.model, c.k, min(d.k) AS nk FROM cand c LEFT JOIN cand d ON d.symbol = c.symbol AND d.model = c.model AND d.rn >= c.free AND d.k > c.k GROUP BY 1, 2, 3""",
    "walk": """SELECT symbol, model, k, CAST(1 AS BIGINT) AS n FROM cand WHERE k = 1 UNION ALL
      SELECT w.symbol, w.model, x.nk, w.n + 1 FROM walk w JOIN nxt x ON x.symbol = w.symbol AND x.model = w.model AND x.k = w.k WHERE x.nk IS NOT NULL""",
    "chain": "SELECT c.*, w.n FROM cand c JOIN walk w USING (symbol, model, k)",
    "led": f"""SELECT *, {CAP} * exp(g) AS capital_after, {CAP} * exp(g - f) AS capital_before FROM (SELECT *, sum(f) OVER (PARTITION BY symbol, model ORDER BY n) AS g FROM (
      SELECT *, ln(1 - {PC * CM}::DOUBLE + {PC}::DOUBLE * return_pct - {PC * CM}::DOUBLE * (1 + return_pct)) AS f FROM chain))""",
}
MTM = {
    **CHAIN,
    "evt": f"""SELECT symbol, model, entry_ts AS ts, 1 AS seq, capital_before * (1 - {PC * CM}::DOUBLE) AS capital, entry_price AS price, capital_before * {PC}::DOUBLE / entry_price AS size FROM led
      UNION ALL SELECT symbol, model, exit_ts, 0, capital_after, NULL, 0 FROM led WHERE exit_reason <> 'market_close'""",
    "ev": "SELECT symbol, model, ts, arg_max(struct_pack(cap := capital, px := price, sz := size), seq) AS e FROM evt GROUP BY 1, 2, 3",
    "mt": f"""SELECT symbol, model, ts, coalesce(state.cap, {CAP}) AS capital, coalesce((close - state.px) * state.sz, 0) AS unrealized_pnl, CAST(state.px IS NOT NULL AS INTEGER) AS num_positions, close AS price FROM (
      SELECT p.symbol, p.model, p.ts, b.close, last_value(e IGNORE NULLS) OVER (PARTITION BY p.symbol, p.model ORDER BY p.ts) AS state
      FROM predictions p JOIN bars b USING (symbol, ts) LEFT JOIN ev USING (symbol, model, ts))""",
    "mm": "SELECT *, capital + unrealized_pnl AS equity FROM mt",
}
KEY = ["symbol", "model"]


@query("b1_entry_candidates", with_views("predictions", "SELECT symbol, ts, model, prob FROM predictions WHERE prob > 0.6"))
def b1(spark, sf):
    return B.entry_candidates(predictions(spark, sf), 0.6).select("symbol", "ts", "model", "prob")


def _exits(name: str, side: str, profit: float = 0.02, stop: float = 0.01, timeout: int = 12):
    sql = exits_sql(side, str(profit), str(stop), timeout)

    @query(name, with_views("ret", f"SELECT symbol, entry_ts, exit_ts, bars_held, exit_reason, {R_list(['entry_price', 'exit_price', 'return_pct'])} FROM ex", sql))
    def run(spark, sf):
        from dataclasses import replace

        d = B.exit_outcomes(bars(spark, sf), S, replace(RULES, side=side, take_profit=profit, stop_loss=stop, timeout=timeout))
        return rounded(d, ["symbol", "entry_ts", "exit_ts", "bars_held", "exit_reason"], ["entry_price", "exit_price", "return_pct"])


_exits("b2_exit_outcome", "long")
_exits("b2_exit_outcome_short", "short")
_exits("b2_exit_outcome_long_timeout", "long", 0.6, 0.4, 150)


@query("b3_non_overlapping", with_views("ret predictions", "SELECT symbol, model, entry_ts, exit_ts, exit_reason FROM chain", CHAIN, recursive=True))
def b3(spark, sf):
    d = B.non_overlapping(B.candidate_trades(bars(spark, sf), predictions(spark, sf), S, RULES))
    return d.select("symbol", "model", "entry_ts", "exit_ts", "exit_reason")


@query("b3_three_positions")
def b3b(spark, sf):
    d = B.non_overlapping(B.candidate_trades(bars(spark, sf), predictions(spark, sf), S, RULES), max_positions=3)
    return d.select("symbol", "model", "entry_ts", "exit_ts", "exit_reason")


def ledger(spark, sf):
    return B.trade_ledger(bars(spark, sf), predictions(spark, sf), S, RULES)


@query("b4_trade_ledger", with_views("ret predictions", f"""SELECT symbol, model, entry_ts, exit_ts, 'long' AS side, bars_held, exit_reason, {R_list(['entry_price', 'exit_price', 'return_pct'])},
    {R(f'capital_before * {PC} / entry_price', 4)} AS size, {R(f'capital_before * {PC} * return_pct', 4)} AS pnl FROM led""", CHAIN, recursive=True))
def b4(spark, sf):
    return ledger(spark, sf).select(
        "symbol", "model", "entry_ts", "exit_ts", "side", "bars_held", "exit_reason", *[r(c).alias(c) for c in ("entry_price", "exit_price", "return_pct")],
        r("size", 4).alias("size"), r("pnl", 4).alias("pnl"))


@query("b5_compound_equity", with_views("ret predictions", f"SELECT symbol, model, entry_ts, {R_list(['capital_before', 'capital_after'], 4)} FROM led", CHAIN, recursive=True))
def b5(spark, sf):
    return rounded(ledger(spark, sf), ["symbol", "model", "entry_ts"], ["capital_before", "capital_after"], 4)


def kept_ledger(spark, sf):
    return once(spark, sf, "kept-ledger", lambda: ledger(spark, sf))


def marked(spark, sf):
    """The equity curve, kept for the queries that summarise it."""
    return once(spark, sf, "marked", lambda: B.mark_to_market(bars(spark, sf), predictions(spark, sf), kept_ledger(spark, sf), S, RULES))


@query("b6_mark_to_market", with_views("ret predictions", f"SELECT symbol, model, ts, num_positions, {R_list(['equity', 'capital', 'unrealized_pnl'], 4)}, {R('price')} AS price FROM mm", MTM, recursive=True))
def b6(spark, sf):
    d = B.mark_to_market(bars(spark, sf), predictions(spark, sf), kept_ledger(spark, sf), S, RULES)
    return d.select("symbol", "model", "ts", "num_positions", *[r(c, 4).alias(c) for c in ("equity", "capital", "unrealized_pnl")], r("price").alias("price"))


SUM = ["total_return", "win_rate", "avg_return", "max_drawdown", "sharpe_ratio", "profit_factor", "avg_win", "avg_loss"]
SUMMARY = {
    **MTM,
    "ddn": "SELECT symbol, model, min(equity / peak - 1) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY symbol, model ORDER BY ts) AS peak FROM mm) GROUP BY 1, 2",
    "daily": "SELECT symbol, model, date_trunc('day', ts) AS day, arg_max(equity, ts) AS eq FROM mm GROUP BY ALL",
    "dr": "SELECT symbol, model, eq / lag(eq) OVER (PARTITION BY symbol, model ORDER BY day) - 1 AS x FROM daily",
    "ds": "SELECT symbol, model, CASE WHEN count(x) > 1 AND stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(252) ELSE 0 END AS sharpe_ratio FROM dr GROUP BY ALL",
    "tm": sql_trade_metrics("symbol, model", "return_pct", "led"),
    "fin": "SELECT symbol, model, arg_max(capital_after, n) AS final_capital FROM led GROUP BY 1, 2",
    "sm": f"""SELECT symbol, model, (final_capital - {CAP}) / {CAP} AS total_return, total_trades AS num_trades, hit_rate AS win_rate, avg_trade AS avg_return, max_drawdown,
      sharpe_ratio, profit_factor, winning_trades, losing_trades, avg_win, avg_loss, {CAP}::DOUBLE AS initial_capital, final_capital
      FROM fin JOIN tm USING (symbol, model) JOIN ddn USING (symbol, model) JOIN ds USING (symbol, model)""",
}


def summary(spark, sf):
    led = kept_ledger(spark, sf)
    return M.backtest_summary(led, marked(spark, sf), B.final_capital(predictions(spark, sf), led, RULES), B.MODEL_SERIES)


@query("m15_backtest_summary", with_views("ret predictions", f"""SELECT symbol, model, num_trades, winning_trades, losing_trades, {R_list(SUM)}, {R_list(['initial_capital', 'final_capital'], 4)} FROM sm""", SUMMARY, recursive=True))
def m15(spark, sf):
    d = summary(spark, sf)
    return d.select(*KEY, "num_trades", "winning_trades", "losing_trades", *[r(c).alias(c) for c in SUM], *[r(c, 4).alias(c) for c in ("initial_capital", "final_capital")])


@query("b7_strategy_comparison", with_views("ret predictions", f"SELECT model, total_trades, winning_trades, losing_trades, {R_list(TRADE_COLS)} FROM tm",
                                            {**CHAIN, "tm": sql_trade_metrics("model", "return_pct", "chain")}, recursive=True))
def b7(spark, sf):
    d = B.strategy_comparison(B.non_overlapping(B.candidate_trades(bars(spark, sf), predictions(spark, sf), S, RULES)))
    return rounded(d, ["model", "total_trades", "winning_trades", "losing_trades"], TRADE_COLS)


@query("b7_best_strategy", with_views("ret predictions", f"SELECT arg_max(name, sharpe_ratio) AS best, {R('max(sharpe_ratio)')} AS sharpe_ratio FROM (SELECT symbol || '/' || model AS name, sharpe_ratio FROM sm)", SUMMARY, recursive=True))
def b7b(spark, sf):
    d = summary(spark, sf).withColumn("strategy", F.concat_ws("/", "symbol", "model"))
    return rounded(B.best_strategy(d), ["best"], ["sharpe_ratio"])


@query("b8_exit_reason_breakdown", with_views("ret predictions", f"SELECT model, exit_reason, count(*) AS n, {R('avg(return_pct)')} AS avg_return, {R('avg(bars_held)')} AS avg_bars FROM chain GROUP BY 1, 2", CHAIN, recursive=True))
def b8(spark, sf):
    d = B.exit_reason_breakdown(B.non_overlapping(B.candidate_trades(bars(spark, sf), predictions(spark, sf), S, RULES)))
    return rounded(d, ["model", "exit_reason", "n"], ["avg_return", "avg_bars"])
