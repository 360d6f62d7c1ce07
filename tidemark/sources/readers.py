"""Batch readers: bars, kline lines, splits, equity files, result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import epoch_ms_to_ts
from tidemark.operators.bars import dedupe_last
from tidemark.schemas import BAR_COLUMNS, BARS_CSV, KLINE_FLAT

BAR_OUT = ("symbol", "ts", *BAR_COLUMNS)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """CSV bars with a header. Rows that do not parse become nulls for the cleaners; order is left to windows."""
    d = spark.read.schema(BARS_CSV).option("header", True).csv(path).withColumnRenamed("timestamp", "ts")
    return d.select(F.lit(symbol).cast("string").alias("symbol"), "ts", *BAR_COLUMNS) if symbol is not None else d


def parse_klines(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row per well-formed kline message: bar columns, close flag and times.

    Takes plain messages and messages inside a ``{stream, data}`` envelope. Other events, error
    events and broken JSON drop out. Works on batch and streaming frames.
    """
    # Field names differ by case only (t/T, l/L), which maps keep apart and structs do not.
    as_map = lambda c: F.from_json(c, "map<string,string>")
    m = lines.select("*", as_map(F.col(value)).alias("_m"))
    m = m.withColumn("_m", F.when(F.map_contains_key("_m", "data"), as_map(F.col("_m")["data"])).otherwise(F.col("_m")))
    m = m.withColumn("_k", as_map(F.col("_m")["k"]))
    whole = lambda c: c.try_cast("long")
    k = lambda name: F.col("_k")[name]
    kind = F.col("_m")["e"]
    row = F.struct(
        F.coalesce(F.col("_m")["s"], k("s")).alias("symbol"),
        epoch_ms_to_ts(whole(k("t"))).alias("ts"),
        epoch_ms_to_ts(whole(k("T"))).alias("close_time"),
        epoch_ms_to_ts(whole(F.col("_m")["E"])).alias("event_time"),
        k("i").alias("interval"),
        *[k(c).try_cast("double").alias(n) for c, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("q", "quote_volume"))],
        whole(k("n")).alias("trade_count"),
        F.coalesce(k("x") == "true", F.lit(False)).alias("is_closed"),
    )
    usable = whole(k("t")).isNotNull() & F.coalesce(kind == "kline", F.lit(True))
    # Filters on columns of a generator stay above it; below, each of them would parse the line again.
    return m.select(F.inline(F.when(usable, F.array(row))))


def valid_kline() -> Column:
    return (F.col("high") >= F.col("low")) & (F.col("open") > 0) & (F.col("close") > 0) & (F.col("volume") >= 0)


def finish_klines(klines: DataFrame, since=None, closed_only: bool = True, validate: bool = False) -> DataFrame:
    """Closed (or valid) klines since a time, the last event of each bar."""
    d = klines.filter(F.col("is_closed")) if closed_only else klines
    if validate:
        d = d.filter(valid_kline())
    if since is not None:
        d = d.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    return dedupe_last(d, ("symbol", "ts"), ("event_time", "trade_count")).select(*BAR_OUT)


def read_klines_nested(spark: SparkSession, path: str, since=None, closed_only: bool = True, validate: bool = False) -> DataFrame:
    return finish_klines(parse_klines(spark.read.text(path)), since, closed_only, validate)


def read_klines_flat(spark: SparkSession, path: str, since=None, closed_only: bool = True) -> DataFrame:
    """The flat one-object-per-line layout of the feed writer."""
    d = spark.read.schema(KLINE_FLAT).json(path).filter(F.col("open_time").isNotNull())
    if closed_only:
        d = d.filter("is_closed")
    d = d.withColumns({"ts": epoch_ms_to_ts("open_time"), "_at": F.col("event_time")})
    if since is not None:
        d = d.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    return dedupe_last(d, ("symbol", "ts"), ("_at", "received_at")).select(*BAR_OUT)


def read_klines(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Both line layouts mixed in the same files; the last event of each bar, of events at one time the one with most trades."""
    lines = spark.read.text(path)
    nested = parse_klines(lines).filter("is_closed").select(*BAR_OUT, F.col("event_time").alias("_at"), "trade_count")
    flat = lines.select(F.from_json("value", KLINE_FLAT).alias("r")).select("r.*").filter("open_time IS NOT NULL AND is_closed")
    flat = flat.select("symbol", epoch_ms_to_ts("open_time").alias("ts"), *BAR_COLUMNS, epoch_ms_to_ts("event_time").alias("_at"), "trade_count")
    d = nested.unionByName(flat)
    if since is not None:
        d = d.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    return dedupe_last(d, ("symbol", "ts"), ("_at", "trade_count", "close")).select(*BAR_OUT)


def read_splits(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All splits, or one of them (only its folder is read)."""
    d = spark.read.parquet(f"{path}/splits")
    return d.filter(F.col("split") == name) if name else d


def read_split_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("split string, n long, first_ts timestamp, last_ts timestamp, columns array<string>").json(f"{path}/metadata")


EQUITY_CSV = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("equity", T.DoubleType())])


def read_equity_files(spark: SparkSession, path: str, pattern: str = r"([^/]+)_equity\.csv$", schema=EQUITY_CSV) -> DataFrame:
    """Many equity CSVs; the strategy name comes from the file path."""
    d = spark.read.schema(schema).option("header", True).csv(path)
    return d.select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("strategy"), F.col("timestamp").alias("ts"), "equity")


RESULT_DOC = "model string, run_ts timestamp, model_path string, metrics struct<total_return double, sharpe_ratio double, win_rate double, max_drawdown double, num_trades long, profit_factor double>"


def read_metric_docs(spark: SparkSession, path: str, schema: str = RESULT_DOC) -> DataFrame:
    """Result documents, one row per model: the one with the greatest file name wins."""
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    d = d.select("*", F.col("_metadata.file_name").alias("_file")).filter("model IS NOT NULL")
    return dedupe_last(d, ("model",), ("_file",)).select("model", "run_ts", "model_path", "metrics.*")


MODEL_DOC = "model_name string, timestamp string, feature_names array<string>, metrics map<string,double>"


def read_model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Model catalogue from metadata documents, newest first."""
    d = spark.read.schema(MODEL_DOC).option("multiLine", True).json(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(_metadata)?\.json$", "")
    d = d.select(
        name.alias("model_id"), F.col("model_name").alias("model_type"), "timestamp", "metrics", "feature_names",
        F.coalesce(F.size("feature_names"), F.lit(0)).alias("feature_count"), F.col("metrics")["auc"].alias("auc"),
    )
    return d.orderBy(F.col("timestamp").desc())
