"""Ledger, portfolio and order checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ledger as A
from tidemark.registry.core import R, R_list, query, r, rounded
from tidemark.registry.sources import scratch
from tidemark.registry.tables import ORDER_SERIES, TRADE_SERIES, bars, equity, order_requests, pnl_events, read, trades, with_views

S = TRADE_SERIES
ORDER = ", ".join(S.order)
IDS = ["symbol", "ts", "order_id", "line", "part", "side"]
SIGNED = "CASE WHEN side = 'buy' THEN quantity ELSE -quantity END"
# Price of the symbol = its supplier's account balance lifted above zero, a table-wide price list.
PRICE_SQL = "SELECT CAST(s_suppkey AS VARCHAR) AS symbol, 2000.0 + s_acctbal / 10 AS current_price FROM supplier"


def price_list(spark, sf):
    return read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), (F.lit(2000.0) + F.col("s_acctbal") / 10).alias("current_price"))


@query("a1_append_trades", with_views("requests", f"SELECT account, ts, order_id, {R('notional', 2)} AS notional FROM requests"))
def a1(spark, sf):
    """Two overlapping appends; the second adds only what is new."""
    path, o = scratch(spark, "append"), order_requests(spark, sf)
    A.append_rows(o.filter(F.col("order_id") % 3 != 0), path)
    A.append_new(o.filter(F.col("order_id") % 2 == 0).unionByName(o.filter(F.col("order_id") % 3 == 0)), path, ("order_id",), spark.read.schema(o.schema).parquet(path))
    return rounded(spark.read.schema(o.schema).parquet(path), ["account", "ts", "order_id"], ["notional"], 2)


@query("a2_position_by_symbol", with_views("trades", f"SELECT symbol, {R(f'sum({SIGNED})')} AS quantity FROM trades GROUP BY 1 HAVING sum({SIGNED}) <> 0"))
def a2(spark, sf):
    return rounded(A.position_by_symbol(trades(spark, sf)), ["symbol"], ["quantity"])


STEPS = {
    "t": f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {ORDER}) AS rn FROM trades",
    "c": """SELECT symbol, rn, CASE WHEN side = 'buy' THEN quantity ELSE -quantity END AS q,
        CASE WHEN side <> 'buy' THEN 0.0::DOUBLE ELSE price END AS a FROM t WHERE rn = 1
      UNION ALL SELECT t.symbol, t.rn, CASE WHEN side = 'buy' THEN c.q + quantity ELSE c.q - quantity END,
        CASE WHEN side <> 'buy' THEN c.a WHEN c.q + quantity > 0 THEN (c.q * c.a + quantity * price) / (c.q + quantity) ELSE price END
      FROM c JOIN t ON t.symbol = c.symbol AND t.rn = c.rn + 1""",
}


@query("a3_average_cost", with_views("trades", f"SELECT symbol, ts, order_id, line, part, side, {R('q')} AS position, {R('a', 4)} AS avg_price FROM c JOIN t USING (symbol, rn)", STEPS, recursive=True))
def a3(spark, sf):
    d = A.average_cost(trades(spark, sf), S)
    return d.select(*IDS, r("position").alias("position"), r("avg_price", 4).alias("avg_price"))


PORT = {**STEPS, "port": "SELECT symbol, arg_max(q, rn) AS quantity, arg_max(a, rn) AS avg_price FROM c GROUP BY 1 HAVING arg_max(q, rn) <> 0"}


@query("a3_portfolio", with_views("trades", f"SELECT symbol, {R('quantity')} AS quantity, {R('avg_price', 4)} AS avg_price FROM port", PORT, recursive=True))
def a3b(spark, sf):
    return A.portfolio(trades(spark, sf), S).select("symbol", r("quantity").alias("quantity"), r("avg_price", 4).alias("avg_price"))


@query("a4_recent_trades", with_views("trades", f"SELECT symbol, ts, order_id, line, part, side, {R('price')} AS price FROM trades WHERE symbol = '7' ORDER BY ts DESC, order_id DESC, line DESC, part DESC LIMIT 25"))
def a4(spark, sf):
    d = A.recent(trades(spark, sf), ("ts", "order_id", "line", "part"), symbol="7", limit=25)
    return d.select(*IDS, r("price").alias("price"))


@query("a4_recent_signals", with_views("predictions", """SELECT symbol, ts, model, prob, CAST(CAST(round(prob * 100) AS BIGINT) AS VARCHAR) AS pct FROM predictions
    ORDER BY ts DESC, symbol DESC, model DESC LIMIT 40"""))
def a4b(spark, sf):
    from tidemark.registry.tables import predictions

    d = predictions(spark, sf).withColumn("metadata", F.to_json(F.struct(F.round(F.col("prob") * 100).cast("long").alias("pct"))))
    d = A.parse_metadata(A.recent(d, ("ts", "symbol", "model"), limit=40))
    return d.select("symbol", "ts", "model", "prob", F.col("metadata")["pct"].alias("pct"))


@query("a5_ledger_stats", with_views("trades", f"""SELECT CAST(sum(n) AS BIGINT) AS total_trades, {R('sum(v)', 2)} AS total_volume, count(*) AS unique_symbols, count(*) FILTER (q <> 0) AS open_positions
    FROM (SELECT symbol, count(*) AS n, sum(quantity * price) AS v, sum({SIGNED}) AS q FROM trades GROUP BY 1)"""))
def a5(spark, sf):
    d = A.ledger_stats(trades(spark, sf))
    return d.select("total_trades", r("total_volume", 2).alias("total_volume"), "unique_symbols", "open_positions")


@query("a6_cash_replay", with_views("trades", f"""SELECT symbol, {R("1e9 + sum(CASE WHEN side = 'buy' THEN -quantity * price * 1.001 ELSE quantity * price * 0.999 END)", 3)} AS cash,
    {R('sum(quantity * price * 0.001)', 4)} AS fees, count(*) AS n_trades FROM trades GROUP BY 1"""))
def a6(spark, sf):
    d = A.cash_replay(trades(spark, sf), 1e9, 0.001, ("symbol",))
    return d.select("symbol", r("cash", 3).alias("cash"), r("fees", 4).alias("fees"), "n_trades")


REPLAY = {
    "t": STEPS["t"],
    "c": """SELECT symbol, rn, CASE WHEN side = 'buy' THEN quantity ELSE 0 END AS q, CASE WHEN side = 'buy' THEN price ELSE 0.0::DOUBLE END AS a FROM t WHERE rn = 1
      UNION ALL SELECT t.symbol, t.rn, CASE WHEN side = 'buy' THEN c.q + quantity ELSE greatest(c.q - quantity, 0) END,
        CASE WHEN side = 'buy' THEN (c.q * c.a + quantity * price) / (c.q + quantity) WHEN c.q - quantity <= 0 THEN 0 ELSE c.a END
      FROM c JOIN t ON t.symbol = c.symbol AND t.rn = c.rn + 1""",
}


@query("a6_replayed_positions", with_views("trades", f"SELECT symbol, ts, order_id, line, part, side, {R('q')} AS position, {R('a', 4)} AS entry_price FROM c JOIN t USING (symbol, rn)", REPLAY, recursive=True))
def a6b(spark, sf):
    d = A.replayed_positions(trades(spark, sf), S)
    return d.select(*IDS, r("position").alias("position"), r("entry_price", 4).alias("entry_price"))


VALUED = {**PORT, "pl": PRICE_SQL, "val": """SELECT *, pnl / (avg_price * abs(quantity)) AS pnl_pct FROM (
    SELECT *, CASE WHEN quantity > 0 THEN (current_price - avg_price) * quantity ELSE 0 END AS pnl FROM port JOIN pl USING (symbol))"""}


def valued(spark, sf):
    return A.position_pnl(A.portfolio(trades(spark, sf), S), price_list(spark, sf))


@query("a7_position_pnl", with_views("trades", f"SELECT symbol, {R('pnl', 3)} AS pnl, {R('pnl_pct')} AS pnl_pct FROM val", VALUED, recursive=True))
def a7(spark, sf):
    return valued(spark, sf).select("symbol", r("pnl", 3).alias("pnl"), r("pnl_pct").alias("pnl_pct"))


@query("a7_asof_price", with_views("ticks bars", f"""SELECT t.symbol, t.ts, t.event_id, {R('b.close')} AS close FROM ticks t
    ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, close FROM bars) b ON b.symbol = t.symbol AND t.ts >= b.ts"""))
def a7b(spark, sf):
    from tidemark.registry.tables import events_as_ticks

    closed = bars(spark, sf).select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), "close")
    d = A.asof_join(events_as_ticks(spark, sf).select("symbol", "ts", "event_id"), closed, ("symbol",), "ts", ["close"])
    return rounded(d, ["symbol", "ts", "event_id"], ["close"])


@query("a8_account_summary", with_views("trades", f"""SELECT {R('cash + held', 1)} AS balance, {R('(cash + held - 1e12) / 1e12 * 100')} AS return_pct, {R('fees', 3)} AS fees, n_trades, open_positions, {R('upl', 1)} AS unrealized_pnl
    FROM (SELECT 1e12 + sum(CASE WHEN side = 'buy' THEN -quantity * price * 1.001 ELSE quantity * price * 0.999 END) AS cash, sum(quantity * price * 0.001) AS fees, count(*) AS n_trades FROM trades),
         (SELECT sum(CASE WHEN quantity > 0 THEN quantity * current_price END) AS held, count(*) FILTER (quantity > 0) AS open_positions, sum(pnl) AS upl FROM val)""", VALUED, recursive=True))
def a8(spark, sf):
    d = A.account_summary(A.cash_replay(trades(spark, sf), 1e12, 0.001), valued(spark, sf), 1e12)
    return d.select(r("balance", 1).alias("balance"), r("return_pct").alias("return_pct"), r("fees", 3).alias("fees"), "n_trades", "open_positions", r("unrealized_pnl", 1).alias("unrealized_pnl"))


LIMITS = A.OrderLimits(min_notional=60_000.0, max_notional=400_000.0, orders_per_hour=2)


def busy_orders(spark, sf):
    """Orders of an order-priority desk: few accounts, many orders a day."""
    return order_requests(spark, sf).withColumn("account", F.col("account") % 5)


DESK = {"rq": "SELECT account % 5 AS account, ts, order_id, notional FROM requests"}


@query("a9_validate_orders_all", with_views("requests", """SELECT account, ts, order_id, reason, reason = 'approved' AS approved FROM (
    SELECT *, CASE WHEN notional < 60000 THEN 'too_small' WHEN notional > 400000 THEN 'too_large'
      WHEN date_trunc('day', old) = date_trunc('day', ts) AND old > ts - INTERVAL 1 HOUR THEN 'rate' ELSE 'approved' END AS reason
    FROM (SELECT *, lag(ts, 2) OVER (PARTITION BY account ORDER BY ts, order_id) AS old FROM rq))""", DESK))
def a9(spark, sf):
    return A.validate_orders(busy_orders(spark, sf), ORDER_SERIES, LIMITS, "all").select("account", "ts", "order_id", "reason", "approved")


# All orders of a day share one time here, so the rate rule takes the first two that fit by size.
@query("a9_validate_orders", with_views("requests", """SELECT account, ts, order_id, reason, reason = 'approved' AS approved FROM (
    SELECT *, CASE WHEN notional < 60000 THEN 'too_small' WHEN notional > 400000 THEN 'too_large'
      WHEN count(*) FILTER (notional BETWEEN 60000 AND 400000) OVER (PARTITION BY account, ts ORDER BY order_id) > 2 THEN 'rate' ELSE 'approved' END AS reason FROM rq)""", DESK))
def a9b(spark, sf):
    return A.validate_orders(busy_orders(spark, sf), ORDER_SERIES, LIMITS).select("account", "ts", "order_id", "reason", "approved")


@query("a10_daily_pnl", with_views("pnl", f"SELECT account, ts, order_id, {R('sum(pnl) OVER (PARTITION BY account, date_trunc(' + chr(39) + 'day' + chr(39) + ', ts) ORDER BY ts, order_id)', 4)} AS daily_pnl FROM pnl"))
def a10(spark, sf):
    return rounded(A.daily_pnl(pnl_events(spark, sf), ORDER_SERIES), ["account", "ts", "order_id"], ["daily_pnl"], 4)


@query("a10_drawdown_state", with_views("pnl", f"""SELECT account, ts, order_id, {R('balance', 4)} AS balance, {R('peak', 4)} AS peak_balance, {R('(peak - balance) / peak')} AS drawdown FROM (
    SELECT *, max(balance) OVER (PARTITION BY account ORDER BY ts, order_id) AS peak FROM (
      SELECT *, 5000000.0 + sum(pnl) OVER (PARTITION BY account ORDER BY ts, order_id) AS balance FROM pnl))"""))
def a10b(spark, sf):
    d = A.drawdown_state(pnl_events(spark, sf), ORDER_SERIES, 5_000_000.0)
    return d.select("account", "ts", "order_id", r("balance", 4).alias("balance"), r("peak_balance", 4).alias("peak_balance"), r("drawdown").alias("drawdown"))


@query("a11_exposure", with_views("trades", f"SELECT {R('sum(abs(quantity) * current_price) / 1e9')} AS exposure FROM port JOIN pl USING (symbol)", VALUED, recursive=True))
def a11(spark, sf):
    d = A.exposure(A.position_by_symbol(trades(spark, sf)), price_list(spark, sf), 1e9)
    return rounded(d, [], ["exposure"])


@query("a12_loss_streak", with_views("pnl", """SELECT account, ts, order_id, CAST(streak AS BIGINT) AS streak, streak >= 3 AS tripped FROM (
    SELECT *, count(*) FILTER (pnl < 0) OVER (PARTITION BY account, g ORDER BY ts, order_id) AS streak FROM (
      SELECT *, count(*) FILTER (pnl >= 0) OVER (PARTITION BY account ORDER BY ts, order_id) AS g FROM pnl))"""))
def a12(spark, sf):
    return A.loss_streak(pnl_events(spark, sf), ORDER_SERIES, 3).select("account", "ts", "order_id", "streak", "tripped")


@query("a13_daily_loss_breaker", with_views("pnl", """SELECT account, ts, order_id, coalesce(min(day_pnl) OVER (PARTITION BY account, ts ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < -100000, false) AS blocked FROM (
    SELECT *, sum(pnl) OVER (PARTITION BY account, ts ORDER BY order_id) AS day_pnl FROM (SELECT account % 5 AS account, ts, order_id, pnl FROM pnl))"""))
def a13(spark, sf):
    d = A.daily_loss_breaker(pnl_events(spark, sf).withColumn("account", F.col("account") % 5), ORDER_SERIES, 100_000.0)
    return d.select("account", "ts", "order_id", "blocked")


@query("a14_stop_loss_hits", with_views("trades", f"SELECT symbol, {R('pnl_pct')} AS pnl_pct FROM val WHERE quantity > 0 AND pnl_pct <= -0.02", VALUED, recursive=True))
def a14(spark, sf):
    return A.stop_loss_hits(valued(spark, sf), 0.02).select("symbol", r("pnl_pct").alias("pnl_pct"))


@query("a15_order_quantity", with_views("predictions bars", f"""SELECT symbol, ts, model, {R('greatest(lo, least(1000 * prob / close, hi))')} AS order_qty
    FROM predictions JOIN bars USING (symbol, ts) JOIN (SELECT symbol, CASE WHEN symbol = 'view' THEN 5.0 ELSE 0.001 END AS lo, CASE WHEN symbol = 'click' THEN 2.0 ELSE 100.0 END AS hi
      FROM (SELECT DISTINCT symbol FROM bars)) USING (symbol)"""))
def a15(spark, sf):
    from tidemark.registry.tables import predictions

    b = bars(spark, sf)
    limits = b.select("symbol").distinct().select("symbol", F.when(F.col("symbol") == "view", 5.0).alias("min_qty"), F.when(F.col("symbol") == "click", 2.0).alias("max_qty"))
    sig = predictions(spark, sf).withColumn("position_size", F.col("prob")).join(b.select("symbol", "ts", F.col("close").alias("price")), ["symbol", "ts"])
    d = A.order_quantity(sig, limits, F.lit(1000.0))
    return rounded(d, ["symbol", "ts", "model"], ["order_qty"])
