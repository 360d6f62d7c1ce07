"""From probabilities to trades, equity and results, as set operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.labels import SHORT
from tidemark.operators.metrics import trade_metrics
from tidemark.plans.blocks import first_hit, first_touches
from tidemark.plans.chunks import Chunks, Series, fold, running, same_keys
from tidemark.session import stage

KEYS = ("symbol", "model")
MODEL_SERIES = Series(keys=KEYS)


@dataclass(frozen=True)
class TradeRules:
    threshold: float = 0.6
    take_profit: float = 0.04
    stop_loss: float = 0.02
    timeout: int = 60
    side: str = "long"
    max_positions: int = 1
    position_size: float = 0.1
    commission: float = 0.0
    initial_capital: float = 100_000.0


def entry_candidates(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.filter(F.col("prob") > threshold)


def exit_outcomes(bars: DataFrame, series: Series, rules: TradeRules) -> DataFrame:
    """For an entry at the close of each bar: when, where and why it would end.

    Looks at the next ``timeout`` closes; take-profit wins over stop-loss, both over the time-out on
    the same bar. Entries that run into the end of the series close at its last bar.
    """
    ts = series.order[0]
    up, down = F.lit(1 + rules.take_profit), F.lit(1 - rules.stop_loss)
    if rules.side == "short":
        up, down = F.lit(1 - rules.take_profit), F.lit(1 + rules.stop_loss)
    bars = bars.withColumns({"take_profit": F.col("close") * up, "stop_loss": F.col("close") * down})
    win, lose = (">=", "<=") if rules.side == "long" else ("<=", ">=")
    d = _long_exits(bars, series, rules.timeout, win, lose) if rules.timeout > SHORT else _short_exits(bars, series, rules.timeout, win, lose)
    reason = (
        F.when(F.col("_held").isNull(), "market_close")
        .when(F.col("_held") == F.col("_win"), "take_profit")
        .when(F.col("_held") == F.col("_lose"), "stop_loss")
        .otherwise("timeout")
    )
    sign = 1.0 if rules.side == "long" else -1.0
    d = d.withColumns({"exit_reason": reason, "bars_held": F.coalesce("_held", "_left")})
    d = d.withColumns({"exit_price": F.coalesce("_x.close", "close"), "exit_ts": F.coalesce(F.col("_x")[ts], F.col(ts))})
    return d.select(
        *series.keys, F.col(ts).alias("entry_ts"), "exit_ts", F.lit(rules.side).alias("side"), F.col("close").alias("entry_price"),
        "exit_price", "stop_loss", "take_profit", "bars_held", "exit_reason",
        (F.lit(sign) * (F.col("exit_price") - F.col("close")) / F.col("close")).alias("return_pct"),
    )


def _short_exits(bars: DataFrame, series: Series, timeout: int, win: str, lose: str) -> DataFrame:
    """``_win`` and ``_lose``, how many bars ahead the levels are reached, ``_held``, ``_left`` (bars ahead to the time-out or the end), and the exit bar ``_x``."""
    ts = series.order[0]
    c = Chunks(bars, series, after=timeout)
    d = c.close(c.df.withColumn("_path", F.collect_list(F.struct("close", ts)).over(c.next(timeout))))
    reached = {">=": lambda level: lambda p: p["close"] >= level, "<=": lambda level: lambda p: p["close"] <= level}
    d = d.withColumns({"_win": first_hit(F.col("_path"), reached[win](F.col("take_profit"))), "_lose": first_hit(F.col("_path"), reached[lose](F.col("stop_loss")))})
    left = F.size("_path").cast("long")
    d = d.withColumns({"_held": F.least("_win", "_lose", F.when(left >= timeout, F.lit(timeout).cast("long"))), "_left": left})
    held = F.coalesce("_held", "_left")
    return d.withColumn("_x", F.when(held > 0, F.element_at("_path", F.greatest(held, F.lit(1)).cast("int"))))


def _long_exits(bars: DataFrame, series: Series, timeout: int, win: str, lose: str) -> DataFrame:
    """The same for long time-outs; the exit bar is met by its place in the series."""
    ts, keys = series.order[0], list(series.keys)
    d = first_touches(bars, series, timeout, {"_win": ("close", win, F.col("take_profit")), "_lose": ("close", lose, F.col("stop_loss"))})
    left = F.least(F.lit(timeout).cast("long"), F.col("_n") - 1 - F.col("_pos"))
    d = d.withColumns({"_held": F.least("_win", "_lose", F.when(left >= timeout, F.lit(timeout).cast("long"))), "_left": left})
    d = stage(d.withColumn("_to", F.col("_pos") + F.coalesce("_held", "_left")), "exits")
    last = d.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pos").alias("_at"), F.struct("close", ts).alias("_x"))
    return d.join(last, same_keys(d, last, [(k, f"_k{i}") for i, k in enumerate(keys)]) & (d["_to"] == last["_at"]))


def candidate_trades(bars: DataFrame, predictions: DataFrame, series: Series, rules: TradeRules) -> DataFrame:
    """Outcomes are computed once per bar and joined to the candidates of every model."""
    picks = entry_candidates(predictions, rules.threshold).select(*series.keys, F.col(series.order[0]).alias("entry_ts"), "model", "prob")
    return picks.join(exit_outcomes(bars, series, rules), [*series.keys, "entry_ts"])


def non_overlapping(candidates: DataFrame, keys: tuple[str, ...] = KEYS, max_positions: int = 1, rows_per_chunk: int = 500_000) -> DataFrame:
    """Take candidates in time order while a slot is free; a slot closed on a bar is free on that bar."""
    s = Series(keys=keys, order=("entry_ts",), rows_per_chunk=rows_per_chunk)
    free = F.when(F.col("exit_reason") == "market_close", F.lit(float("inf"))).otherwise(F.unix_micros("exit_ts").cast("double"))
    d = stage(candidates, "candidates").withColumns({"_in": F.unix_micros("entry_ts").cast("double"), "_out": free})

    def take(rows: pd.DataFrame, state: list[float]) -> tuple[pd.DataFrame, list[float]]:
        open_until, keep = sorted(state), np.zeros(len(rows), dtype=bool)
        for i, (start, end) in enumerate(zip(rows["_in"].tolist(), rows["_out"].tolist())):
            open_until = [x for x in open_until if x > start]
            if len(open_until) < max_positions:
                keep[i] = True
                open_until.append(end)
        return rows[keep].assign(taken=True), sorted(open_until)

    return fold(d, s, take, "taken boolean").drop("_in", "_out", "taken")


def compound_equity(chain: DataFrame, rules: TradeRules, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Capital before and after each trade of a one-position chain, with size and pnl.

    A trade multiplies the capital by 1 - p*c + p*r - p*(1+r)*c, so capital is a running product: the sum of
    the logarithms, the parity of negative factors, and zero from the first factor of zero on.
    """
    p, c, ret = rules.position_size, rules.commission, F.col("return_pct")
    exit_value = 1 + ret if rules.side == "long" else 1 - ret
    factor = F.lit(1 - p * c) + F.lit(p) * ret - F.lit(p * c) * exit_value
    s = Series(keys=keys, order=("entry_ts",))
    f = F.col("_f")
    values = {"_log": F.when(f != 0, F.ln(F.abs(f))).otherwise(F.lit(0.0)), "_neg": (f < 0).cast("long"), "_zero": (f == 0).cast("long")}
    d = stage(chain, "chain").withColumn("_f", factor).withColumns(values)
    d = running(d, s, {f"_s{k}": ("sum", F.col(k)) for k in values})

    def capital(own: int) -> Column:
        log, neg, zero = (F.col(f"_s{k}") - own * F.col(k) for k in values)
        sign = F.when(neg % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        return F.lit(rules.initial_capital) * F.when(zero > 0, F.lit(0.0)).otherwise(sign * F.exp(log))

    before, after = capital(1), capital(0)
    d = d.withColumns({"capital_before": before, "capital_after": after})
    size = F.col("capital_before") * F.lit(p) / F.col("entry_price")
    return d.withColumns({"size": size, "pnl": size * F.col("entry_price") * ret}).drop("_f", *values, *[f"_s{k}" for k in values])


def trade_ledger(bars: DataFrame, predictions: DataFrame, series: Series, rules: TradeRules) -> DataFrame:
    """Candidates -> non-overlapping chain -> capital: one row per closed trade."""
    if rules.max_positions != 1:
        raise ValueError("capital compounds in closed form for one position at a time only")
    chain = non_overlapping(candidate_trades(bars, predictions, series, rules), (*series.keys, "model"))
    return stage(compound_equity(chain, rules, (*series.keys, "model")), "ledger")


def mark_to_market(bars: DataFrame, predictions: DataFrame, ledger: DataFrame, series: Series, rules: TradeRules) -> DataFrame:
    """Equity curve on every predicted bar: capital after the last event plus the open trade's unrealised pnl."""
    ts, keys = series.order[0], [*series.keys, "model"]
    sign = 1.0 if rules.side == "long" else -1.0
    entry = ledger.select(
        *keys, F.col("entry_ts").alias(ts), F.lit(1).alias("_seq"),
        (F.col("capital_before") * F.lit(1 - rules.position_size * rules.commission)).alias("capital"),
        F.col("entry_price").alias("at"), "size",
    )
    done = ledger.filter(F.col("exit_reason") != "market_close").select(
        *keys, F.col("exit_ts").alias(ts), F.lit(0).alias("_seq"), F.col("capital_after").alias("capital"),
        F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("size"),
    )
    events = entry.unionByName(done).groupBy(*keys, ts).agg(F.max_by(F.struct("capital", "at", "size"), "_seq").alias("_e"))
    grid = predictions.select(*keys, ts).join(bars.select(*series.keys, ts, "close"), [*series.keys, ts])
    d = running(stage(grid.join(events, [*keys, ts], "left"), "grid"), Series(keys=tuple(keys), order=series.order), {"_now": ("last", F.col("_e"))})
    capital = F.coalesce("_now.capital", F.lit(rules.initial_capital))
    pnl = F.coalesce(F.lit(sign) * (F.col("close") - F.col("_now.at")) * F.col("_now.size"), F.lit(0.0))
    return d.select(
        *keys, ts, (capital + pnl).alias("equity"), capital.alias("capital"), pnl.alias("unrealized_pnl"),
        F.col("_now.at").isNotNull().cast("int").alias("num_positions"), F.col("close").alias("price"),
    )


def final_capital(predictions: DataFrame, ledger: DataFrame, rules: TradeRules, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Initial and final capital of every (symbol, model), traded or not."""
    last = ledger.groupBy(*keys).agg(F.max_by("capital_after", "entry_ts").alias("_c"))
    every = predictions.select(*keys).distinct()
    return every.join(last, list(keys), "left").select(
        *keys, F.lit(rules.initial_capital).alias("initial_capital"), F.coalesce("_c", F.lit(rules.initial_capital)).alias("final_capital")
    )


def exit_reason_breakdown(trades: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    return trades.groupBy(*keys, "exit_reason").agg(
        F.count(F.lit(1)).alias("n"), F.avg("return_pct").alias("avg_return"), F.avg("bars_held").alias("avg_bars")
    )


def strategy_comparison(trades: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Trade statistics per strategy side by side."""
    return trade_metrics(trades, list(keys))


def best_strategy(table: DataFrame, name: str = "strategy", by: str = "sharpe_ratio") -> DataFrame:
    return table.agg(F.max_by(name, F.struct(F.coalesce(F.col(by), F.lit(float("-inf"))), F.col(name))).alias("best"), F.max(by).alias(by))
