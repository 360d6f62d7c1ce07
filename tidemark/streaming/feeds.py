"""Streaming sources, bars, de-duplication and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.bars import build_bars, dedupe_last
from tidemark.sources.readers import parse_klines
from tidemark.streaming.state import EpochTable


def stream_klines(spark: SparkSession, path: str, files_per_trigger: int = 100, closed_only: bool = True) -> DataFrame:
    """Kline messages that land as text files; closed bars only."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    d = parse_klines(lines)
    return d.filter("is_closed") if closed_only else d


def klines_from_kafka(spark: SparkSession, servers: str, topic: str, closed_only: bool = True) -> DataFrame:
    """The same messages from a Kafka topic (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    d = parse_klines(raw.select(F.col("value").cast("string").alias("value")))
    return d.filter("is_closed") if closed_only else d


def stream_bars(ticks: DataFrame, interval: str = "1 minute", delay: str = "10 minutes", **kw) -> DataFrame:
    """Tumbling bars with a watermark; the aggregation is the batch one."""
    return build_bars(ticks.withWatermark(kw.get("ts", "ts"), delay), interval, **kw)


def dedupe_first(klines: DataFrame, keys: tuple[str, ...] = ("symbol", "ts"), event: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """First event of each bar; state is dropped behind the watermark."""
    return klines.withWatermark(event, delay).dropDuplicatesWithinWatermark(list(keys))


def dedupe_latest(klines: DataFrame, cols: tuple[str, ...], keys: tuple[str, ...] = ("symbol", "ts"), event: str = "event_time", delay: str = "1 day", tie: tuple[str, ...] = ()) -> DataFrame:
    """Latest event of each bar, for update mode: a later event sends the row again. ``ts`` bounds the state."""
    d = klines.withWatermark(keys[-1], delay)
    best = d.groupBy(*keys).agg(F.max_by(F.struct(event, *cols), F.struct(event, *tie)).alias("_r"))
    return best.select(*keys, "_r.*")


def run_batches(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", **trigger) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``each``; default is to work off what is there and stop."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return w.trigger(**(trigger or {"availableNow": True})).start()


class UpsertSink:
    """Keeps the newest version of each key from an update-mode query."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...]):
        self.table, self.keys = EpochTable(spark, path, schema), keys

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self.table.write(batch, epoch)

    def read(self, spark: SparkSession) -> DataFrame:
        return dedupe_last(self.table.all(spark), self.keys, ("epoch",)).drop("epoch")


class LedgerSink:
    """Appends trades or signals once: rows whose key is stored already, or repeated in the batch, are skipped."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...], ts: str = "ts"):
        self.table, self.keys, self.ts = EpochTable(spark, path, schema), keys, ts

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(self.keys))
        first = batch.agg(F.min(self.ts)).first()[0]
        if first is not None:
            # A copy carries the time of its original, so older rows cannot match.
            known = self.table.all(spark).filter((F.col("epoch") < epoch) & (F.col(self.ts) >= F.lit(first)))
            fresh = fresh.join(known.select(*self.keys), list(self.keys), "left_anti")
        self.table.write(fresh, epoch)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.table.all(spark).drop("epoch")


def feed_status(klines: DataFrame, now, silent_after_s: float = 300.0, price: str = "close", ts: str = "ts", order: str | None = None) -> DataFrame:
    """Per symbol: messages, last time and price, and whether it has been silent for too long."""
    d = klines.groupBy("symbol").agg(F.count(F.lit(1)).alias("messages"), F.max(ts).alias("last_ts"), F.max_by(price, order or ts).alias("last_price"))
    silence = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_ts")) / F.lit(1e6)
    return d.withColumn("silence_s", silence).withColumn("silent", F.col("silence_s") > silent_after_s)
