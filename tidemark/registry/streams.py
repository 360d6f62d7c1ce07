"""Streaming queries: files written from the given tables, read as a stream to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.ensembles import signal_from_prob
from tidemark.registry.core import R, R_list, query, r, rounded
from tidemark.registry.sources import KL, kline_lines, scratch
from tidemark.registry.tables import BAR_SERIES as S
from tidemark.registry.tables import bars, order_requests, predictions, ticks, with_views
from tidemark.registry.windows import MATRIX, PREP, sql_ema, sql_rsi
from tidemark.schemas import BARS
from tidemark.streaming import feeds
from tidemark.streaming.features import FeatureStream, signal_stream, stream_gate
from tidemark.streaming.stateful import drop_late, latest_rows

PARTS = 4


class Feed:
    """``df`` cut by time into ``PARTS`` slices with open ends, which arrive one after the other in ``order``.

    The cuts lie evenly between the first and the last time of the data; rows without a time belong to the first slice.
    """

    def __init__(self, spark, df, name: str, order=(0, 1, 2, 3)):
        self.spark, self.df, self.order, self.path = spark, df, order, scratch(spark, name)
        df.limit(0).write.parquet(self.path)  # a stream needs the folder
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        low, high = df.agg(F.min(at), F.max(at)).first()
        cuts = [low + (high - low) * k // PARTS for k in range(1, PARTS)] if low is not None else []
        self.slice = sum((F.coalesce((at >= F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))

    def stream(self):
        return self.spark.readStream.schema(self.df.schema).parquet(self.path)

    def drain(self, start) -> None:
        """Writes a slice, runs the query that ``start`` gives for the stream until it is worked off, and so on."""
        for i in self.order:
            self.df.filter(self.slice == i).write.mode("append").parquet(self.path)
            start(self.stream()).awaitTermination()

    def batches(self, each, mode: str = "append", through=lambda d: d) -> None:
        checkpoint = scratch(self.spark, "stream")
        self.drain(lambda d: feeds.run_batches(through(d), checkpoint, each, mode))

    def appended(self, through):
        """Rows that a query in append mode has written to files."""
        out, checkpoint = scratch(self.spark, "out"), scratch(self.spark, "stream")
        self.drain(lambda d: through(d).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start())
        return self.spark.read.schema(through(self.stream()).schema).parquet(out)


def sql_slice(table: str) -> str:
    """Number of the slice of each row, as :class:`Feed` cuts them."""
    cuts = " + ".join(f"CAST(epoch_us(ts) >= lo + (hi - lo) * {k} // {PARTS} AS INTEGER)" for k in range(1, PARTS))
    return f"SELECT *, {cuts} AS slice FROM {table}, (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM {table})"


@query("st1_stream_klines", with_views("ticks", f"SELECT symbol, ts, event_id % 1000 AS trade_count, {R('open', 6)} AS close FROM kl WHERE event_id % 10 <> 0", KL))
def st1(spark, sf):
    path, out = scratch(spark, "klines"), scratch(spark, "out")
    kline_lines(spark, sf).write.text(path)
    d = feeds.stream_klines(spark, path).select("symbol", "ts", "trade_count", r("close", 6).alias("close"))
    d.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "stream")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(d.schema).parquet(out)


@query("st2_stream_dedupe", with_views("ticks", f"SELECT symbol, ts, {R('open', 6)} AS close, volume FROM kd WHERE k = 1", KL))
def st2(spark, sf):
    path = scratch(spark, "klines")
    kline_lines(spark, sf).write.text(path)
    d = feeds.stream_klines(spark, path, files_per_trigger=1)
    d = feeds.dedupe_latest(d, ("close", "volume", "trade_count"), delay="60 days", tie=("trade_count",))
    sink = feeds.UpsertSink(spark, scratch(spark, "upsert"), d.schema, ("symbol", "ts"))
    feeds.run_batches(d, scratch(spark, "stream"), sink, "update").awaitTermination()
    return sink.read(spark).select("symbol", "ts", r("close", 6).alias("close"), "volume")


@query("st2_dedupe_first", with_views("ticks", "SELECT DISTINCT symbol, ts FROM kl WHERE event_id % 10 <> 0", KL))
def st2b(spark, sf):
    path, out = scratch(spark, "klines"), scratch(spark, "out")
    kline_lines(spark, sf).write.text(path)
    d = feeds.dedupe_first(feeds.stream_klines(spark, path), delay="60 days").select("symbol", "ts")
    d.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "stream")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(d.schema).parquet(out)


@query("st3_drop_late", with_views("bars", f"""SELECT symbol, ts, {R('close')} AS close FROM cut c
    WHERE NOT (slice = 1 AND ts <= (SELECT coalesce(max(ts), TIMESTAMP '0001-01-01') FROM cut x WHERE x.symbol = c.symbol AND x.slice = 2))""", {"cut": sql_slice("bars")}))
def st3(spark, sf):
    d = Feed(spark, bars(spark, sf), "late", order=(0, 2, 1, 3)).appended(drop_late)
    return rounded(d, ["symbol", "ts"], ["close"])


@query("st4_latest_n", with_views("ret", f"SELECT symbol, ts, CAST(cnt - rn + 1 AS INTEGER) AS rank, {R('close')} AS close FROM ret WHERE cnt - rn < 20"))
def st4(spark, sf):
    feed = Feed(spark, bars(spark, sf), "ring")
    ring = lambda d: latest_rows(d, 20)
    sink = feeds.UpsertSink(spark, scratch(spark, "latest"), ring(feed.stream()).schema, ("symbol", "rank"))
    feed.batches(sink, "update", ring)
    return rounded(sink.read(spark), ["symbol", "ts", "rank"], ["close"])


@query("st5_stream_features", with_views(
    "ret", f"SELECT symbol, ts, {', '.join(f'{R(e)} AS {n}' for n, e in MATRIX.items())} FROM prep JOIN e USING (symbol, ts)", {**PREP, "e": sql_ema(digits=None)}))
def st5(spark, sf):
    each = FeatureStream(spark, scratch(spark, "features"), S)
    Feed(spark, bars(spark, sf), "bars").batches(each, "update", each.through)
    return rounded(each.read(spark), ["symbol", "ts"], list(MATRIX))


def score(feats):
    return feats.withColumn("prob", F.coalesce(F.round(F.col("rsi_14") / 100, 6), F.lit(0.5)))


@query("st6_stream_signals", with_views("ret", f"""SELECT symbol, ts, prob, kind AS signal, {R('CASE WHEN kind = ' + chr(39) + 'HOLD' + chr(39) + ' THEN 0.0 ELSE least(0.1, 0.1 * (greatest(prob, 1 - prob) - 0.6::DOUBLE) / (1 - 0.6::DOUBLE)) END', 8)} AS position_size FROM (
    SELECT *, CASE WHEN greatest(prob, 1 - prob) < 0.6::DOUBLE THEN 'HOLD' WHEN prob > 0.6::DOUBLE THEN 'BUY' WHEN 1 - prob > 1 - 0.4::DOUBLE THEN 'SELL' ELSE 'HOLD' END AS kind
    FROM (SELECT symbol, ts, rn, coalesce(round(({sql_rsi(14)}) / 100, 6), 0.5) AS prob FROM prep)) WHERE rn >= 50""", PREP))
def st6(spark, sf):
    each = signal_stream(spark, scratch(spark, "signals"), score)
    Feed(spark, bars(spark, sf), "bars").batches(each, "update", each.through)
    return each.read(spark).select("symbol", "ts", "prob", "signal", r("position_size", 8).alias("position_size"))


# Signals of an account one by one, with the open positions and the order times of the last hour as lists.
GATE = {
    "kinds": """SELECT model AS account, symbol, ts, CASE WHEN greatest(prob, 1 - prob) < 0.6::DOUBLE THEN 'HOLD' WHEN prob > 0.6::DOUBLE THEN 'BUY' WHEN 1 - prob > 1 - 0.4::DOUBLE THEN 'SELL' ELSE 'HOLD' END AS kind,
      least(0.1, 0.1 * (greatest(prob, 1 - prob) - 0.6::DOUBLE) / (1 - 0.6::DOUBLE)) AS size FROM predictions""",
    "sig": "SELECT *, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY account ORDER BY ts, symbol) AS k FROM kinds WHERE kind <> 'HOLD'",
    "walk": """SELECT account, 0::BIGINT AS k, NULL::VARCHAR AS reason, []::STRUCT(s VARCHAR, z DOUBLE)[] AS held, []::DOUBLE[] AS orders FROM sig GROUP BY 1
      UNION ALL
      SELECT account, k, reason, CASE WHEN reason <> 'accepted' THEN held WHEN kind = 'BUY' THEN list_append(held, {'s': symbol, 'z': size}) ELSE list_filter(held, lambda x: x.s <> symbol) END,
        CASE WHEN reason = 'accepted' THEN list_append(orders, t) ELSE orders END
      FROM (SELECT *, CASE WHEN kind = 'BUY' AND round(coalesce(list_sum(list_transform(held, lambda x: x.z)), 0), 9) >= 0.25::DOUBLE THEN 'exposure' WHEN len(orders) >= 3 THEN 'rate'
              WHEN kind = 'BUY' AND len(list_filter(held, lambda x: x.s = symbol)) > 0 THEN 'long_open' WHEN kind = 'SELL' AND len(list_filter(held, lambda x: x.s = symbol)) = 0 THEN 'no_position' ELSE 'accepted' END AS reason
            FROM (SELECT s.account, s.k, s.symbol, s.kind, s.size, s.t, w.held, list_filter(w.orders, lambda x: x > s.t - 3600) AS orders FROM walk w JOIN sig s ON s.account = w.account AND s.k = w.k + 1))""",
}


@query("st7_stream_gate", with_views("predictions", "SELECT account, reason, count(*) AS n FROM walk WHERE k > 0 GROUP BY 1, 2", GATE, recursive=True))
def st7(spark, sf):
    sig = signal_from_prob(predictions(spark, sf)).withColumn("account", F.col("model"))
    feed = Feed(spark, sig.select("account", "symbol", "ts", "signal", "position_size"), "signals")
    d = feed.appended(lambda x: stream_gate(x, max_exposure=0.25, orders_per_hour=3))
    return d.groupBy("account", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("st8_stream_ledger_sink", with_views("requests", f"SELECT account, ts, order_id, {R('notional', 2)} AS notional FROM requests"))
def st8(spark, sf):
    o = order_requests(spark, sf)
    sink = feeds.LedgerSink(spark, scratch(spark, "ledger"), o.schema, ("order_id",))
    Feed(spark, o, "orders", order=(0, 1, 0, 2, 3, 2)).batches(sink)
    return rounded(sink.read(spark), ["account", "ts", "order_id"], ["notional"], 2)


@query("st9_build_bars", with_views("bars", f"SELECT symbol, ts, {R_list(['open', 'high', 'low', 'close', 'volume'])} FROM bars"))
def st9(spark, sf):
    from tidemark.operators.bars import build_bars

    return rounded(build_bars(ticks(spark, sf), "1 hour", tie=("event_id",)), ["symbol", "ts"], ["open", "high", "low", "close", "volume"])


@query("st9_stream_bars", with_views("bars", f"SELECT symbol, ts, {R_list(['open', 'high', 'low', 'close', 'volume'])} FROM bars"))
def st9b(spark, sf):
    feed = Feed(spark, ticks(spark, sf), "ticks")

    def make(d):
        return feeds.stream_bars(d, "1 hour", "10 minutes", tie=("event_id",))

    sink = feeds.UpsertSink(spark, scratch(spark, "bars"), make(feed.stream()).schema, ("symbol", "ts"))
    feed.batches(sink, "update", make)
    return rounded(sink.read(spark), ["symbol", "ts"], ["open", "high", "low", "close", "volume"])


@query("st10_feed_status", with_views("ticks", f"""SELECT symbol, count(*) AS messages, max(ts) AS last_ts, {R('arg_max(px, ts)')} AS last_price,
    {R("(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 1e6")} AS silence_s, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 1e6 > 1500 AS silent FROM ticks GROUP BY 1"""))
def st10(spark, sf):
    d = feeds.feed_status(ticks(spark, sf), "2024-01-31 00:00:00", 1500.0, price="px")
    return d.select("symbol", "messages", "last_ts", r("last_price").alias("last_price"), r("silence_s").alias("silence_s"), "silent")
