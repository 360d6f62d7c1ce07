"""Features, signals and the order gate on a stream of bars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.ensembles import signal_from_prob
from tidemark.operators.windows import DEFAULT_USE, EMA_SPANS, LOOKBACK, feature_matrix
from tidemark.plans.chunks import Series
from tidemark.schemas import BARS
from tidemark.session import stage
from tidemark.streaming.state import EpochTable
from tidemark.streaming.stateful import with_context

class FeatureStream:
    """New bars in, their features out, by the batch feature matrix: ``run(each.through(bars), ..., each, "update")``.

    :meth:`through` keeps in Spark's state store the newest rows of each symbol, as many as rolling features read, and its exponential
    averages with the number of rows since its last value; it sends new rows with what their features read. The ``foreachBatch``
    handler computes the features. So they equal the batch ones, after an outage of any length too.
    ``history=150`` gives buffered behaviour, where the averages start anew at the edge of the buffer. Rows of a symbol before its
    ``min_rows``-th are kept but not sent. ``ttl_s`` drops the state of symbols that have been silent for so long.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        series: Series = Series(),
        use: tuple[str, ...] = DEFAULT_USE,
        history: int | None = None,
        min_rows: int = 1,
        then: Callable[[DataFrame], DataFrame] | None = None,
        ttl_s: float | None = None,
    ):
        self.series, self.use, self.min_rows, self.then, self.history, self.ttl_s = series, use, min_rows, then, history, ttl_s
        self.averages = history is None and any("ema" in u for u in use)
        out = feature_matrix(spark.createDataFrame([], BARS), series, use)
        self.out = EpochTable(spark, f"{path}/features", (then(out) if then else out).schema)

    def through(self, bars: DataFrame) -> DataFrame:
        return with_context(bars.select(*BARS.names), self.history or LOOKBACK, EMA_SPANS, "close", self.series.keys, self.series.order[0], self.ttl_s)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        keys, held = list(self.series.keys), ["_since", *(f"_h{n}" for n in EMA_SPANS)]
        batch = stage(batch, "context")
        rows = batch.drop(*held)
        if self.averages:
            past = batch.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in held])
            feats = feature_matrix(rows, self.series, self.use, "_new", past)
        else:
            feats = feature_matrix(rows, self.series, self.use)
        feats = feats.filter(F.col("_new") & (F.col("seen") >= self.min_rows)).drop("_new", "seen")
        self.out.write(self.then(feats) if self.then else feats, epoch)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.out.all(spark).drop("epoch")


def signal_stream(spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame], min_rows: int = 50, series: Series = Series(), **rules) -> FeatureStream:
    """Features -> ``score`` (adds ``prob``) -> signals, once a symbol has ``min_rows`` bars."""

    def signals(feats: DataFrame) -> DataFrame:
        d = signal_from_prob(score(feats), **rules)
        return d.select(*series.keys, series.order[0], "close", "prob", "signal", "confidence", "position_size")

    return FeatureStream(spark, path, series, min_rows=min_rows, then=signals)


GATE_OUT = "account string, symbol string, ts timestamp, signal string, position_size double, accepted boolean, reason string"
GATE_STATE = "symbols array<string>, sizes array<double>, orders array<double>"


def stream_gate(signals: DataFrame, max_exposure: float = 0.5, orders_per_hour: int = 10) -> DataFrame:
    """Accept or reject BUY and SELL signals per account, in time order within a micro-batch.

    Rejects at full exposure (buys), after too many orders in an hour, a second long in a symbol and
    a sale without a position. State: open positions and the order times of the last hour.
    """

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbols, sizes, orders = (list(x) for x in state.get) if state.exists else ([], [], [])
        held = dict(zip(symbols, sizes))
        # One trigger's signals of one account; the source limits how much a trigger reads.
        rows = pd.concat(list(batches)).sort_values(["ts", "symbol"], kind="stable")
        verdicts = []
        for t, symbol, signal, size in zip(rows["ts"].map(lambda x: x.timestamp()), rows["symbol"], rows["signal"], rows["position_size"]):
            orders = [x for x in orders if x > t - 3600.0]
            buy = signal == "BUY"
            if buy and round(sum(held.values()), 9) >= max_exposure:  # sums of sizes that end on the limit count as on it
                verdicts.append("exposure")
            elif len(orders) >= orders_per_hour:
                verdicts.append("rate")
            elif buy and symbol in held:
                verdicts.append("long_open")
            elif not buy and symbol not in held:
                verdicts.append("no_position")
            else:
                verdicts.append("accepted")
                orders.append(t)
                if buy:
                    held[symbol] = float(size)
                else:
                    held.pop(symbol)
        state.update((list(held), list(held.values()), orders))
        out = rows.assign(accepted=[v == "accepted" for v in verdicts], reason=verdicts)
        yield out[["account", "symbol", "ts", "signal", "position_size", "accepted", "reason"]]

    actionable = signals.filter(F.col("signal") != "HOLD").select("account", "symbol", "ts", "signal", "position_size")
    return actionable.groupBy("account").applyInPandasWithState(check, GATE_OUT, GATE_STATE, "append", GroupStateTimeout.NoTimeout)
