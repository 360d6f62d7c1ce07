"""Trade ledger, portfolio and order checks as tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp
from tidemark.plans.chunks import Series, affine_scan, fold, number_rows, over_chunks, running
from tidemark.session import stage


def signed_quantity() -> Column:
    return F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))


def append_rows(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_new(df: DataFrame, path: str, keys: tuple[str, ...], known: DataFrame | None) -> None:
    """Append the rows whose key is not in the ledger yet (a retried batch adds nothing)."""
    fresh = df.dropDuplicates(list(keys))
    if known is not None:
        fresh = fresh.join(known.select(*keys), list(keys), "left_anti")
    append_rows(fresh, path)


def position_by_symbol(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return trades.groupBy(*keys).agg(F.sum(signed_quantity()).alias("quantity")).filter(F.col("quantity") != 0)


def average_cost(trades: DataFrame, series: Series) -> DataFrame:
    """Position and average price after every trade.

    A buy mixes the old average with its price (or restarts at its price when the new position is
    not positive); a sell keeps the average. With the position known from a running sum this is a
    linear recurrence.
    """
    old = F.col("position") - F.col("quantity")
    mixes = (F.col("side") == "buy") & (F.col("position") > 0)
    restarts = (F.col("side") == "buy") & (F.col("position") <= 0)
    factor = F.when(mixes, F.try_divide(old, F.col("position"))).when(restarts, F.lit(0.0)).otherwise(F.lit(1.0))
    addend = (
        F.when(mixes, F.try_divide(F.col("quantity") * F.col("price"), F.col("position")))
        .when(restarts, F.col("price"))
        .otherwise(F.lit(0.0))
    )
    return affine_scan(trades, series, factor, addend, "avg_price", carry={"position": ("sum", signed_quantity())})


def portfolio(trades: DataFrame, series: Series) -> DataFrame:
    """Quantity and average price of every open position."""
    at = F.struct(*series.order)
    d = average_cost(trades, series).groupBy(*series.keys).agg(
        F.max_by("position", at).alias("quantity"), F.max_by("avg_price", at).alias("avg_price")
    )
    return d.filter(F.col("quantity") != 0)


def recent(df: DataFrame, order: tuple[str, ...], symbol: str | None = None, limit: int = 100) -> DataFrame:
    """Newest rows first, optionally of one symbol."""
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def parse_metadata(signals: DataFrame, schema: str = "map<string,string>", col: str = "metadata") -> DataFrame:
    return signals.withColumn(col, F.from_json(col, schema))


def ledger_stats(trades: DataFrame) -> DataFrame:
    """One row: trades, traded value, symbols, open positions."""
    per = trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("quantity") * F.col("price")).alias("value"), F.sum(signed_quantity()).alias("q")
    )
    return per.agg(
        F.sum("n").alias("total_trades"), F.sum("value").alias("total_volume"), F.count(F.lit(1)).alias("unique_symbols"),
        F.count_if(F.col("q") != 0).alias("open_positions"),
    )


def cash_flow(fee: float) -> Column:
    gross = F.col("quantity") * F.col("price")
    return F.when(F.col("side") == "buy", -gross * F.lit(1 + fee)).otherwise(gross * F.lit(1 - fee))


def cash_replay(trades: DataFrame, initial: float, fee: float = 0.001, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cash, fees and trade counts of an account after all its trades."""
    return trades.groupBy(*keys).agg(
        (F.lit(initial) + F.sum(cash_flow(fee))).alias("cash"),
        F.sum(F.col("quantity") * F.col("price") * F.lit(fee)).alias("fees"),
        F.count(F.lit(1)).alias("n_trades"),
    )


def replayed_positions(trades: DataFrame, series: Series) -> DataFrame:
    """Long positions after every trade: sold out (or over-sold) positions vanish and start anew.

    The position is the running sum of signed quantities, lifted by its own lowest point below
    zero; the entry price is the linear recurrence of :func:`average_cost` with a reset at zero.
    """
    d = stage(running(trades, series, {"_sum": ("sum", signed_quantity())}), "positions")
    position = F.col("_sum") - F.least(F.col("_low"), F.lit(0.0))
    buys = F.col("side") == "buy"
    old = F.col("position") - F.col("quantity")
    factor = F.when(buys, F.try_divide(old, F.col("position"))).when(F.col("position") <= 0, F.lit(0.0)).otherwise(F.lit(1.0))
    addend = F.when(buys, F.try_divide(F.col("quantity") * F.col("price"), F.col("position"))).otherwise(F.lit(0.0))
    out = affine_scan(d, series, factor, addend, "entry_price", {"_low": ("min", F.col("_sum"))}, {"position": position})
    return out.drop("_sum", "_low")


def latest_price(prices: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", price: str = "close") -> DataFrame:
    return prices.groupBy(*keys).agg(F.max_by(price, ts).alias("current_price"))


def asof_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], ts: str, cols: list[str], rows_per_chunk: int = 500_000) -> DataFrame:
    """Attach to each left row the newest right row of its key that is not later."""
    packed = right.select(*keys, ts, F.lit(0).alias("_side"), F.struct(*cols).alias("_r"))
    both = left.withColumn("_side", F.lit(1)).unionByName(packed, allowMissingColumns=True)
    s = Series(keys=keys, order=(ts, "_side"), rows_per_chunk=rows_per_chunk)
    d = running(both, s, {"_last": ("last", F.col("_r"))}).filter(F.col("_side") == 1)
    return d.select(*left.columns, *[F.col("_last")[c].alias(c) for c in cols])


def position_pnl(positions: DataFrame, prices: DataFrame, quantity: str = "quantity", entry: str = "avg_price") -> DataFrame:
    """Unrealised pnl of long positions at the latest price; 0 for shorts. pnl_pct is a fraction of the entry."""
    d = positions.join(prices, "symbol")
    pnl = F.when(F.col(quantity) > 0, (F.col("current_price") - F.col(entry)) * F.col(quantity)).otherwise(F.lit(0.0))
    return d.withColumn("pnl", pnl).withColumn("pnl_pct", F.try_divide(F.col("pnl"), F.col(entry) * F.abs(quantity)))


def account_summary(cash: DataFrame, valued: DataFrame, initial: float, closed: DataFrame | None = None) -> DataFrame:
    """Balance (cash plus positions at their price), return, fees, win rate and open positions."""
    held = valued.agg(
        F.coalesce(F.sum(F.when(F.col("quantity") > 0, F.col("quantity") * F.col("current_price"))), F.lit(0.0)).alias("_held"),
        F.count_if(F.col("quantity") > 0).alias("open_positions"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("unrealized_pnl"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    d = one(cash).join(one(held), "_one")
    if closed is not None:
        d = d.join(one(closed.agg(F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))), "_one")
    balance = F.col("cash") + F.col("_held")
    cols = [balance.alias("balance"), ((balance - initial) / initial * 100).alias("return_pct"), "fees", "n_trades", "open_positions", "unrealized_pnl"]
    return d.select(*cols, *(["win_rate"] if closed is not None else []))


@dataclass(frozen=True)
class OrderLimits:
    """Fixed default limits of the order check."""

    min_notional: float = 10.0
    max_notional: float = 1000.0
    orders_per_hour: int = 10
    max_position_pct: float = 0.1
    max_exposure_pct: float = 0.5
    max_daily_loss_pct: float = 0.05
    max_drawdown_pct: float = 0.1
    base_capital: float = 10_000.0


def _late_rules(df: DataFrame, limits: OrderLimits) -> list[tuple[str, Column]]:
    """Rules after the rate limit that the columns of ``df`` allow to check: (reason, violated)."""
    have, n = set(df.columns), F.col("notional")
    rules = []
    if {"side", "cash"} <= have:
        rules.append(("cash", (F.col("side") == "buy") & (F.col("cash") < n)))
    if "position_value" in have:
        rules.append(("position", F.abs("position_value") + n > limits.base_capital * limits.max_position_pct))
    if {"exposure", "capital"} <= have:
        rules.append(("exposure", F.col("exposure") + n > F.col("capital") * limits.max_exposure_pct))
    if {"daily_pnl", "peak_balance"} <= have:
        loss = F.try_divide(-F.col("daily_pnl"), F.greatest(F.col("peak_balance"), F.lit(limits.base_capital)))
        rules.append(("daily_loss", (F.col("daily_pnl") < 0) & (loss > limits.max_daily_loss_pct)))
    if "drawdown" in have:
        rules.append(("drawdown", F.col("drawdown") > limits.max_drawdown_pct))
    return rules


def _reason(size: Column, rate: Column, late: list[tuple[str, Column]]) -> Column:
    out = F.when(size.isNotNull(), size).when(rate, "rate")
    for name, broken in late:
        out = out.when(F.coalesce(broken, F.lit(False)), name)
    return out.otherwise("approved")


def _size_reason(limits: OrderLimits) -> Column:
    n = F.col("notional")
    return F.when(n < limits.min_notional, "too_small").when(n > limits.max_notional, "too_large")


def validate_orders(orders: DataFrame, series: Series, limits: OrderLimits = OrderLimits(), count: str = "approved") -> DataFrame:
    """First broken rule per order, in the fixed order size, rate, cash, position, exposure, daily loss, drawdown.

    The rate rule looks at the orders of the last hour on the same day: at all orders
    (``count='all'``; the n-th previous order is recent) or at the approved ones only.
    """
    ts, k = series.order[0], limits.orders_per_hour
    late = _late_rules(orders, limits)
    if count == "all":
        d = over_chunks(orders, series, lambda c: {"_old": F.lag(ts, k).over(c.window)}, before=k)
        near = F.unix_micros("_old") > F.unix_micros(ts) - F.lit(3_600_000_000)
        rate = F.coalesce(near & (F.to_date("_old") == F.to_date(ts)), F.lit(False))
        d = d.withColumn("reason", _reason(_size_reason(limits), rate, late)).drop("_old")
        return d.withColumn("approved", F.col("reason") == "approved")
    size, ok = _size_reason(limits), F.lit(True)
    for _, broken in late:
        ok = ok & ~F.coalesce(broken, F.lit(False))
    d = orders.withColumns(
        {
            "_t": F.unix_micros(ts) / F.lit(1e6),
            "_asks": size.isNull(),
            "_fits": ok & size.isNull(),
        }
    )

    def step(rows: pd.DataFrame, state: list[float]) -> tuple[pd.DataFrame, list[float]]:
        recent_ok, full = list(state), []
        for t, asks, fits in zip(rows["_t"].tolist(), rows["_asks"].tolist(), rows["_fits"].tolist()):
            day = t // 86_400.0
            recent_ok = [x for x in recent_ok if x > t - 3600.0 and x // 86_400.0 == day]
            full.append(asks and len(recent_ok) >= k)
            if fits and not full[-1]:
                recent_ok.append(t)
        return rows.assign(_full=full), recent_ok

    d = fold(d, series, step, "_full boolean")
    d = d.withColumn("reason", _reason(size, F.col("_full"), late)).drop("_t", "_asks", "_fits", "_full")
    return d.withColumn("approved", F.col("reason") == "approved")


def daily_pnl(df: DataFrame, series: Series) -> DataFrame:
    """Running pnl of the day after each event."""
    ts = series.order[0]
    by_day = Series((*series.keys, "day"), series.order, series.levels, series.rows_per_chunk)
    return running(df.withColumn("day", F.to_date(ts)), by_day, {"daily_pnl": ("sum", F.col("pnl"))})


def drawdown_state(df: DataFrame, series: Series, initial: float) -> DataFrame:
    """Balance, peak balance and (peak - balance) / peak after each pnl event."""
    d = running(df, series, {"_sum": ("sum", F.col("pnl"))}).withColumn("balance", F.lit(initial) + F.col("_sum"))
    d = running(stage(d, "balance"), series, {"peak_balance": ("max", F.col("balance"))}).drop("_sum")
    return d.withColumn("drawdown", F.try_divide(F.col("peak_balance") - F.col("balance"), F.col("peak_balance")))


def exposure(positions: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """Sum of |quantity| * price over capital."""
    return positions.join(prices, "symbol").agg(
        (F.coalesce(F.sum(F.abs("quantity") * F.col("current_price")), F.lit(0.0)) / F.lit(capital)).alias("exposure")
    )


def loss_streak(df: DataFrame, series: Series, limit: int) -> DataFrame:
    """Consecutive losses up to each event and whether they reach the limit."""
    d = number_rows(df, series, "_pos", total=None)
    d = running(stage(d, "streak"), series, {"_last": ("max", F.when(F.col("pnl") >= 0, F.col("_pos")))})
    d = d.withColumn("streak", F.col("_pos") - F.coalesce(F.col("_last"), F.lit(-1))).drop("_pos", "_last")
    return d.withColumn("tripped", F.col("streak") >= limit)


def daily_loss_breaker(df: DataFrame, series: Series, limit: float) -> DataFrame:
    """Block the rest of a day once its running pnl fell below ``-limit``."""
    d = stage(daily_pnl(df, series), "daily-pnl")
    by_day = Series((*series.keys, "day"), series.order, series.levels, series.rows_per_chunk)
    d = running(d, by_day, {"_low": ("min", F.col("daily_pnl"))}, exclusive=True)
    return d.withColumn("blocked", F.coalesce(F.col("_low") < -abs(limit), F.lit(False))).drop("_low")


def stop_loss_hits(valued: DataFrame, limit: float) -> DataFrame:
    """Open positions whose pnl fraction is at or below ``-limit``."""
    return valued.filter((F.col("quantity") > 0) & (F.col("pnl_pct") <= -limit))


def order_quantity(signals: DataFrame, limits: DataFrame | None, cash: Column, low: float = 0.001, high: float = 100.0) -> DataFrame:
    """cash * position_size / price within the symbol's min and max quantity."""
    d = signals
    if limits is not None:
        d = d.join(limits.select("symbol", "min_qty", "max_qty"), "symbol", "left")
    else:
        d = d.withColumns({"min_qty": F.lit(None).cast("double"), "max_qty": F.lit(None).cast("double")})
    raw = F.try_divide(cash * F.col("position_size"), F.col("price"))
    q = F.greatest(F.coalesce("min_qty", F.lit(low)), F.least(raw, F.coalesce("max_qty", F.lit(high))))
    return d.withColumn("order_qty", F.when(raw.isNull(), F.lit(0.0)).otherwise(q)).drop("min_qty", "max_qty")
