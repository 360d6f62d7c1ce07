"""Sources, sinks and scalar functions. Files are written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import bars as B
from tidemark.operators import labels as L
from tidemark.operators import splits as T
from tidemark.operators import windows as W
from tidemark.plans.chunks import DAY, Level, Series, over_chunks
from tidemark.registry.core import R, R_list, query, r, rounded
from tidemark.registry.tables import BAR_SERIES as S
from tidemark.registry.trades import SUMMARY
from tidemark.registry.tables import bars, bars_dirty, equity, events_as_ticks, predictions, read, ticks, trades, with_views
from tidemark.session import checkpoint_dir
from tidemark.sources import quarantine, readers, writers

KEYS = ["symbol", "ts"]
OHLCV = ["open", "high", "low", "close", "volume"]
VALID = "high >= low AND high >= open AND high >= close AND low <= open AND low <= close"


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


@query("s1_read_bars", with_views("bars", f"SELECT symbol, ts, {R_list(OHLCV)} FROM bars"))
def s1(spark, sf):
    path = scratch(spark, "csv")
    bars(spark, sf).select("symbol", F.col("ts").alias("timestamp"), *OHLCV).write.partitionBy("symbol").option("header", True).csv(path)
    return rounded(readers.read_bars(spark, path), KEYS, OHLCV)


def bar_lines(spark, sf):
    """Bars as CSV lines; every 11th has a word for its close, every 13th is cut off, every 17th has a field too many."""
    n = F.expr("unix_seconds(ts) div 3600 % 100000")
    cells = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *[F.format_string("%.4f", c) for c in OHLCV]]
    cells[4] = F.when(n % 11 == 0, "n/a").otherwise(cells[4])
    line = F.when(n % 13 == 0, F.concat_ws(",", *cells[:3])).when(n % 17 == 0, F.concat_ws(",", *cells, F.lit("x"))).otherwise(F.concat_ws(",", *cells))
    return bars(spark, sf).select(line.alias("value"))


BAR_PROBLEM = """CASE WHEN n % 13 = 0 THEN 'fields missing' WHEN n % 17 = 0 THEN 'too many fields' WHEN n % 11 = 0 THEN 'wrong type' ELSE 'none' END"""


@query("s1_rejected_lines", with_views("bars", f"SELECT {BAR_PROBLEM} AS problem, count(*) AS n FROM (SELECT CAST(epoch(ts) AS BIGINT) // 3600 % 100000 AS n FROM bars) GROUP BY 1"))
def s1b(spark, sf):
    path, kept = scratch(spark, "csv"), scratch(spark, "rejected")
    bar_lines(spark, sf).write.text(path)
    good, bad = quarantine.read_bars_checked(spark, path)
    quarantine.keep_rejected(bad, kept)
    return quarantine.rejected_counts(spark, kept).select("problem", "n").unionByName(good.agg(F.count("*").alias("n")).select(F.lit("none").alias("problem"), "n"))


@query("s2_check_bar_integrity", with_views("dirty", """SELECT count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (high < open) AS high_below_open, count(*) FILTER (high < close) AS high_below_close,
    count(*) FILTER (low > open) AS low_above_open, count(*) FILTER (low > close) AS low_above_close, count(*) FILTER (volume < 0) AS negative_volume FROM dirty"""))
def s2(spark, sf):
    return B.check_integrity(bars_dirty(spark, sf))


def kline_lines(spark, sf):
    """Ticks as kline messages of one minute; every tenth stays open, every 50th line is cut off."""
    return kline_texts(spark, sf).select("value")


def kline_texts(spark, sf):
    """The messages with the number of their tick."""
    t = ticks(spark, sf)
    ms = F.unix_millis(F.date_trunc("minute", "ts"))
    num = lambda c: F.format_string("%.6f", c)
    body = F.struct(
        ms.alias("t"), (ms + 59_999).alias("T"), F.col("symbol").alias("s"), F.lit("1m").alias("i"), num("px").alias("o"), num("px").alias("h"),
        num("px").alias("l"), num("px").alias("c"), num("qty").alias("v"), (F.col("event_id") % 1000).alias("n"), (F.col("event_id") % 10 != 0).alias("x"),
    )
    text = F.to_json(F.struct(F.lit("kline").alias("e"), F.unix_millis("ts").alias("E"), F.col("symbol").alias("s"), body.alias("k")))
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"stream":"x","data":'), text, F.lit("}"))).otherwise(text)
    return t.select("event_id", F.when(F.col("event_id") % 50 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"))


KL = {"kl": """SELECT symbol, date_trunc('minute', ts) AS ts, round(px, 6) AS open, qty AS volume, event_id, epoch_ms(ts) AS ms FROM ticks WHERE event_id % 50 <> 0""",
      "kd": "SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY ms DESC, event_id % 1000 DESC) AS k FROM kl WHERE event_id % 10 <> 0"}


@query("s3_read_klines_nested", with_views("ticks", f"SELECT symbol, ts, {R('open', 6)} AS close, volume FROM kd WHERE k = 1", KL))
def s3(spark, sf):
    path = scratch(spark, "klines")
    kline_lines(spark, sf).write.text(path)
    return readers.read_klines_nested(spark, path).select("symbol", "ts", r("close", 6).alias("close"), "volume")


@query("s3_read_klines_since", with_views("ticks", f"""SELECT symbol, ts, {R('open', 6)} AS close, volume FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY ms DESC, event_id % 1000 DESC) AS k FROM kl WHERE volume >= 0 AND ts >= TIMESTAMP '2024-01-20') WHERE k = 1""", KL))
def s3b(spark, sf):
    path = scratch(spark, "klines")
    kline_lines(spark, sf).write.text(path)
    d = readers.read_klines_nested(spark, path, since="2024-01-20 00:00:00", closed_only=False, validate=True)
    return d.select("symbol", "ts", r("close", 6).alias("close"), "volume")


BROKEN = {11: "no start time", 12: "wrong type", 13: "fields missing", 14: "impossible values", 15: "other event", 16: "no kline", 17: "empty"}


def broken_klines(spark, sf):
    """The kline messages of ticks, some of them with a field of the wrong type, without one, of another event or of no sense."""
    v, case = F.col("value"), F.col("event_id") % 23
    v = (
        F.when(case == 11, F.regexp_replace(v, '"t":[0-9]+', '"t":"soon"'))
        .when(case == 12, F.regexp_replace(v, '"o":"[^"]*"', '"o":"high"'))
        .when(case == 13, F.regexp_replace(v, '"v":"[^"]*",', ""))
        .when(case == 14, F.regexp_replace(v, '"l":"[^"]*"', '"l":"1e300"'))
        .when(case == 15, F.regexp_replace(v, '"e":"kline"', '"e":"trade"'))
        .when(case == 16, F.lit('{"result":null,"id":1}'))
        .when(case == 17, F.lit(""))
        .otherwise(v)
    )
    return kline_texts(spark, sf).select(v.alias("value"))


CASES = " ".join(f"WHEN event_id % 23 = {k} THEN '{v}'" for k, v in BROKEN.items())


@query("s3_rejected_klines", with_views("ticks", f"""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN event_id % 23 IN (16, 17) THEN CASE {CASES} END
    WHEN event_id % 50 = 0 THEN 'broken json' {CASES} WHEN px <= 0 OR qty < 0 THEN 'impossible values' END AS problem FROM ticks) WHERE problem IS NOT NULL GROUP BY 1"""))
def s3c(spark, sf):
    path, kept = scratch(spark, "klines"), scratch(spark, "rejected")
    broken_klines(spark, sf).write.text(path)
    quarantine.keep_rejected(quarantine.rejected_klines(quarantine.read_lines(spark, path)), kept)
    return quarantine.rejected_counts(spark, kept).select("problem", "n")


@query("s4_read_klines_flat", with_views("bars", f"SELECT symbol, ts, {R_list(OHLCV)} FROM bars"))
def s4(spark, sf):
    path = scratch(spark, "flat")
    flat = bars(spark, sf).select("symbol", F.unix_millis("ts").alias("open_time"), F.unix_millis("ts").alias("event_time"), *OHLCV, F.lit(True).alias("is_closed"))
    flat.write.json(path)
    return rounded(readers.read_klines_flat(spark, path), KEYS, OHLCV)


@query("s4_read_klines_mixed", with_views("ticks bars", f"""SELECT symbol, ts, {R('open', 6)} AS close FROM kd WHERE k = 1 AND (symbol, ts) NOT IN (SELECT (symbol, ts) FROM bars)
    UNION ALL SELECT symbol, ts, {R('close', 6)} FROM bars""", KL))
def s4b(spark, sf):
    path = scratch(spark, "mixed")
    kline_lines(spark, sf).write.text(path)
    late = F.unix_millis("ts") + 10**12
    flat = bars(spark, sf).select("symbol", F.unix_millis("ts").alias("open_time"), late.alias("event_time"), *OHLCV, F.lit(True).alias("is_closed"))
    flat.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
    return readers.read_klines(spark, path).select("symbol", "ts", r("close", 6).alias("close"))


@query("s5_normalise_columns", with_views("bars", f"SELECT ts, {R_list(OHLCV)} FROM bars"))
def s5(spark, sf):
    vendor = {"Date": "ts", "1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. volume": "volume"}
    d = bars(spark, sf).withColumnsRenamed({v: k for k, v in vendor.items()}).withColumn("Adj Close", F.lit(1.0))
    return rounded(B.normalise_columns(d, vendor), ["ts"], OHLCV)


@query("s6_union_chunks", with_views("bars", f"SELECT symbol, ts, {R('close')} AS close, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN volume END AS volume FROM bars"))
def s6(spark, sf):
    b = bars(spark, sf)
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    d = B.union_chunks([b.filter(~cut).select("symbol", "ts", "close", "volume"), b.filter(cut).select("symbol", "ts", "close")])
    return d.select("symbol", "ts", r("close").alias("close"), "volume")


@query("s7_dedupe_last", with_views("dirty", f"SELECT symbol, ts, {R_list(['open', 'high', 'low', 'close', 'volume'])}, copy FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY copy DESC) AS k FROM dirty) WHERE k = 1"))
def s7(spark, sf):
    return rounded(B.dedupe_last(bars_dirty(spark, sf), ("symbol", "ts"), ("copy",)), [*KEYS, "copy"], OHLCV)


@query("s8_tag_and_union_symbols", with_views("bars", f"SELECT 'X-' || symbol AS symbol, ts, {R('close')} AS close FROM bars"))
def s8(spark, sf):
    b = bars(spark, sf)
    names = [x.symbol for x in b.select("symbol").distinct().collect()]  # a handful of event types, one table each
    d = B.tag_and_union_symbols({f"X-{s}": b.filter(F.col("symbol") == s).drop("symbol") for s in names})
    return d.select("symbol", "ts", r("close").alias("close"))


SPL = {"sp": """SELECT *, CASE WHEN rn <= floor(cnt * 0.6::DOUBLE) THEN 'train' WHEN rn <= cnt - floor(cnt * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM ret"""}


@query("s9_write_read_splits", with_views("ret", f"SELECT symbol, ts, split, {R('close')} AS close FROM sp WHERE split = 'validation'", SPL))
def s9(spark, sf):
    path = scratch(spark, "splits")
    writers.write_splits(T.time_split(bars(spark, sf), S), path)
    return readers.read_splits(spark, path, "validation").select("symbol", "ts", "split", r("close").alias("close"))


@query("s9_split_metadata", with_views("ret", "SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, 7 AS n_columns FROM sp GROUP BY 1", SPL))
def s9b(spark, sf):
    path = scratch(spark, "splits")
    writers.write_splits(T.time_split(bars(spark, sf), S), path)
    return readers.read_split_metadata(spark, path).select("split", "n", "first_ts", "last_ts", F.size("columns").alias("n_columns"))


@query("s10_read_equity_files", with_views("equity", f"SELECT strategy, ts, {R('equity', 4)} AS equity FROM equity"))
def s10(spark, sf):
    path = scratch(spark, "equity")
    equity(spark, sf).select(F.col("ts").alias("timestamp"), "equity", "strategy").write.partitionBy("strategy").option("header", True).csv(path)
    d = readers.read_equity_files(spark, f"{path}/*", r"strategy=([^/]+)/")
    return d.select("strategy", "ts", r("equity", 4).alias("equity"))


DOC = ("total_return", "sharpe_ratio", "win_rate", "max_drawdown", "num_trades", "profit_factor")


@query("s11_read_metric_docs", with_views("ret predictions", f"SELECT symbol || '-' || model AS model, CAST(num_trades AS BIGINT) AS num_trades, {R_list([c for c in DOC if c != 'num_trades'])} FROM sm", SUMMARY, recursive=True))
def s11(spark, sf):
    from tidemark.registry.trades import summary

    path = scratch(spark, "docs")
    d = summary(spark, sf).select(F.concat_ws("-", "symbol", "model").alias("model"), F.struct(*DOC).alias("metrics"))
    d.repartition("model").write.option("maxRecordsPerFile", 1).json(path)
    return rounded(readers.read_metric_docs(spark, path), ["model", "num_trades"], [c for c in DOC if c != "num_trades"])


@query("s12_write_run", with_views("ret predictions", """SELECT run, model, (SELECT count(*) FROM led l WHERE l.model = m.model) AS n_trades, (SELECT count(*) FROM predictions p WHERE p.model = m.model) AS n_points,
    (SELECT count(*) FROM sm s WHERE s.model = m.model) AS n_results FROM (SELECT DISTINCT model FROM predictions) m, (VALUES ('first'), ('second')) v(run)""", SUMMARY, recursive=True))
def s12(spark, sf):
    """Two runs in one folder; both are there afterwards."""
    from tidemark.registry.trades import kept_ledger, marked, summary

    path = scratch(spark, "run")
    for run in ("first", "second"):
        writers.write_run(kept_ledger(spark, sf), marked(spark, sf), summary(spark, sf), path, run=run)

    def count(table: str, kind: str, name: str):
        return getattr(spark.read.option("header", True), kind)(f"{path}/{table}").groupBy("run", "model").agg(F.count(F.lit(1)).alias(name))

    d = count("equity", "csv", "n_points").join(count("trades", "csv", "n_trades"), ["run", "model"], "left").join(count("results", "json", "n_results"), ["run", "model"], "left")
    return d.select("run", "model", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "n_points", F.coalesce("n_results", F.lit(0)).alias("n_results"))


@query("s13_write_metrics", with_views("er", f"SELECT strategy, {R('avg(ret)', 9)} AS mean FROM er GROUP BY 1"))
def s13(spark, sf):
    from tidemark.registry.metrics import returns

    path = scratch(spark, "metrics")
    writers.write_metrics(returns(spark, sf).groupBy("strategy").agg(F.avg("ret").alias("mean")), path)
    return spark.read.schema("strategy string, mean double").json(path).select("strategy", r("mean", 9).alias("mean"))


@query("s14_export_ledger", with_views("trades", "SELECT symbol, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) AS quantity FROM trades GROUP BY 1 HAVING sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) <> 0"))
def s14(spark, sf):
    from tidemark.operators import ensembles as E
    from tidemark.operators import ledger as A

    path, t = scratch(spark, "ledger"), trades(spark, sf)
    writers.export_ledger(t, E.signal_from_prob(predictions(spark, sf)), A.position_by_symbol(t), A.ledger_stats(t), path)
    return spark.read.schema("symbol string, quantity double").json(f"{path}/portfolio")


@query("s15_read_model_metadata", f"""SELECT p_brand AS model_type, '2024' || lpad(CAST(max(p_partkey) AS VARCHAR), 8, '0') AS timestamp,
    CAST(count(DISTINCT p_type) AS INTEGER) AS feature_count, {R('avg(p_size) / 50')} AS auc FROM part GROUP BY 1""")
def s15(spark, sf):
    path = scratch(spark, "models")
    m = read(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_size").alias("size"), F.max("p_partkey").alias("k"), F.collect_set("p_type").alias("feature_names"))
    m = m.select(F.col("p_brand").alias("model_name"), F.format_string("2024%08d", "k").alias("timestamp"), "feature_names", F.create_map(F.lit("auc"), F.col("size") / 50).alias("metrics"))
    m.write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_model_metadata(spark, path).select("model_type", "timestamp", "feature_count", r("auc").alias("auc"))


@query("s16_write_features", with_views("ret", "SELECT split, count(*) AS n FROM sp GROUP BY 1", SPL))
def s16(spark, sf):
    path = scratch(spark, "features")
    writers.write_features(T.time_split(W.feature_matrix(bars(spark, sf), S), S), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("s16_write_sequences", with_views("ret", """SELECT split, count(*) AS n, 30 AS length, 2 AS width FROM (
    SELECT CASE WHEN k <= m - floor(m * 0.2::DOUBLE) - floor(m * 0.1::DOUBLE) THEN 'train' WHEN k <= m - floor(m * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT rn - 29 AS k, cnt - 29 AS m FROM ret WHERE rn >= 30)) GROUP BY 1"""))
def s16b(spark, sf):
    path = scratch(spark, "sequences")
    writers.write_sequences(T.sequence_split(W.sliding_sequences(bars(spark, sf), S, ["open", "close"], 30), S), path)
    return spark.read.schema("split string, n long, length int, width int").json(f"{path}/metadata")


# --- scalar functions --------------------------------------------------------------------------


@query("p1_p4_basic_features", with_views("ret", f"""SELECT symbol, ts, {R('ret')} AS returns, {R('ln(ret + 1)')} AS log_returns, {R('(high - low) / close')} AS price_range, {R('abs(close - open) / close')} AS body_size,
    {R('avg(volume) OVER w')} AS volume_ma_5, {R('volume / avg(volume) OVER w')} AS volume_ratio, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend
    FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""))
def p1(spark, sf):
    d = B.add_basic_features(bars(spark, sf), S)
    return rounded(d, [*KEYS, "hour", "day_of_week", "is_weekend"], ["returns", "log_returns", "price_range", "body_size", "volume_ma_5", "volume_ratio"])


@query("p3_live_ranges", with_views("bars", f"SELECT symbol, ts, {R('(high - low) / low')} AS price_range, {R('abs(close - open) / open')} AS body_size FROM bars"))
def p3(spark, sf):
    return bars(spark, sf).select(*KEYS, r(C.price_range_live()).alias("price_range"), r(C.body_size_live()).alias("body_size"))


@query("p5_ratios", with_views("bars", f"SELECT symbol, ts, {R('high / low')} AS high_low_ratio, {R('open / close')} AS open_close_ratio FROM bars"))
def p5(spark, sf):
    return bars(spark, sf).select(*KEYS, r(C.high_low_ratio()).alias("high_low_ratio"), r(C.open_close_ratio()).alias("open_close_ratio"))


@query("p6_ohlc_valid", with_views("dirty", f"""SELECT symbol, ts, copy, coalesce({VALID} AND low > 0 AND volume >= 0, false) AS valid, coalesce({VALID} AND low > 0 AND volume > 0, false) AS strict FROM dirty"""))
def p6(spark, sf):
    return bars_dirty(spark, sf).select(*KEYS, "copy", C.ohlc_valid().alias("valid"), C.ohlc_valid(True).alias("strict"))


@query("p7_drop_missing", with_views("dirty", f"SELECT symbol, ts, copy, {R('close')} AS close FROM dirty WHERE close IS NOT NULL"))
def p7(spark, sf):
    return rounded(B.drop_missing(bars_dirty(spark, sf)), [*KEYS, "copy"], ["close"])


def raw_bars(spark, sf):
    """Bars of the raw values, which jump and touch zero."""
    t = events_as_ticks(spark, sf).withColumn("px", F.col("value"))
    return B.build_bars(t, "1 hour", tie=("event_id",))


RAW = {"rb": """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
    sum(CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) AS volume FROM events GROUP BY 1, 2"""}


@query("p8_drop_nonpositive_prices", with_views("", f"SELECT symbol, ts, {R('close')} AS close FROM rb WHERE open > 0 AND high > 0 AND low > 0 AND close > 0", RAW))
def p8(spark, sf):
    return rounded(B.drop_nonpositive_prices(raw_bars(spark, sf)), KEYS, ["close"])


@query("p9_drop_extreme_moves", with_views("", f"""SELECT symbol, ts, {R('close')} AS close FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS m FROM rb) WHERE abs(m) <= 0.5""", RAW))
def p9(spark, sf):
    return rounded(B.drop_extreme_moves(raw_bars(spark, sf), S, 0.5), KEYS, ["close"])


@query("p10_drop_zero_volume", with_views("dirty", "SELECT symbol, ts, copy, volume FROM dirty WHERE volume > 0"))
def p10(spark, sf):
    return B.drop_zero_volume(bars_dirty(spark, sf)).select(*KEYS, "copy", "volume")


DIRTY_SERIES = Series(order=("ts", "copy"))


@query("p11_forward_fill", with_views("dirty", f"SELECT symbol, ts, copy, {R('last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, copy)')} AS close FROM dirty"))
def p11(spark, sf):
    return rounded(B.forward_fill(bars_dirty(spark, sf), DIRTY_SERIES, ["close"]), [*KEYS, "copy"], ["close"])


@query("p12_nan_inf_to_zero", with_views("dirty", f"SELECT symbol, ts, copy, {R('coalesce(close, 0)')} AS close FROM dirty"))
def p12(spark, sf):
    d = bars_dirty(spark, sf)
    odd = F.when(F.col("close").isNull() & (F.hour("ts") % 2 == 0), F.lit(float("inf"))).when(F.col("close").isNull(), F.lit(float("nan"))).otherwise(F.col("close"))
    return d.select(*KEYS, "copy", r(C.nan_inf_to_zero(odd)).alias("close"))


CLEAN = {"c1": "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts, copy) - 1 AS m FROM dirty WHERE close IS NOT NULL AND open > 0"}


@query("p13_clean_bars", with_views("dirty", f"SELECT symbol, ts, copy, {R_list(OHLCV)}, {R('f')} AS extra FROM (SELECT *, last_value(CASE WHEN hour(ts) % 3 <> 0 THEN open END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, copy) AS f FROM c1 WHERE abs(m) <= 0.03) WHERE f IS NOT NULL", CLEAN))
def p13(spark, sf):
    d = bars_dirty(spark, sf).withColumn("extra", F.when(F.hour("ts") % 3 != 0, F.col("open")))
    return rounded(B.clean_bars(d, DIRTY_SERIES, 0.03), [*KEYS, "copy"], [*OHLCV, "extra"])


@query("p13_clean_vendor_bars", with_views("dirty", f"SELECT symbol, ts, copy, {R_list(OHLCV)} FROM c2 WHERE abs(m) <= 0.03 AND volume > 0",
    {"c2": f"SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts, copy) - 1 AS m FROM dirty WHERE close IS NOT NULL AND {VALID} AND low > 0 AND volume >= 0"}))
def p13b(spark, sf):
    return rounded(B.clean_vendor_bars(bars_dirty(spark, sf), DIRTY_SERIES, 0.03), [*KEYS, "copy"], OHLCV)


@query("p14_select_features", with_views("ret", f"SELECT symbol, ts, {R_list(OHLCV)}, {R('ret')} AS returns, {R('ret')} AS ret_1m, {R('close / lag(close, 15) OVER (PARTITION BY symbol ORDER BY ts) - 1')} AS ret_15m FROM ret"))
def p14(spark, sf):
    f = W.feature_matrix(bars(spark, sf), S, ("ret_1m", "ema_5"))
    d = B.select_features(f, ["returns", "ret_1"]).drop("vol_adj_returns_5")
    return rounded(d, KEYS, [*OHLCV, "returns", "ret_1m", "ret_15m"])


@query("p15_date_range", with_views("bars", f"SELECT symbol, ts, {R('close')} AS close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"))
def p15(spark, sf):
    return rounded(B.date_range(bars(spark, sf), "2024-01-10", "2024-01-20"), KEYS, ["close"])


@query("p15_lookback", with_views("bars", f"SELECT symbol, ts, {R('close')} AS close FROM bars WHERE ts >= TIMESTAMP '2024-01-23 12:00:00'"))
def p15b(spark, sf):
    return rounded(B.lookback(bars(spark, sf), "2024-01-31 00:00:00", 7.5), KEYS, ["close"])


PAIR = "CASE p_partkey % 4 WHEN 0 THEN 'btc-usd' WHEN 1 THEN 'ETH/BTC' WHEN 2 THEN 'sol_usdt' ELSE 'ADA' END"


def pairs(spark, sf):
    k = F.col("p_partkey") % 4
    return read(spark, sf, "part").withColumn("pair", F.when(k == 0, "btc-usd").when(k == 1, "ETH/BTC").when(k == 2, "sol_usdt").otherwise("ADA"))


@query("p16_normalise_symbol", f"""SELECT p_partkey, CASE WHEN s LIKE '%USD' THEN s || 'T' ELSE s END AS spot, s AS plain,
    CASE WHEN s = 'BTCUSD' THEN 'BTCUSDT' WHEN right(c, 1) <> 'T' THEN upper(c) || 'T' ELSE upper(c) END AS feed
    FROM (SELECT p_partkey, regexp_replace({PAIR}, '[-/_]', '', 'g') AS c, upper(regexp_replace({PAIR}, '[-/_]', '', 'g')) AS s FROM part)""")
def p16(spark, sf):
    return pairs(spark, sf).select("p_partkey", C.normalise_symbol("pair").alias("spot"), C.strip_symbol("pair").alias("plain"), C.feed_symbol("pair").alias("feed"))


SPAN = "CASE p_partkey % 4 WHEN 0 THEN '15m' WHEN 1 THEN '4H' WHEN 2 THEN '1d' ELSE '7x' END"


@query("p17_durations", f"""SELECT p_partkey, CASE lower({SPAN}) WHEN '15m' THEN '15m' WHEN '4h' THEN '4h' WHEN '1d' THEN '1d' ELSE '1m' END AS interval,
    CAST(CASE lower({SPAN}) WHEN '15m' THEN 15 WHEN '4h' THEN 240 WHEN '1d' THEN 1440 END AS DOUBLE) AS minutes FROM part""".replace("AS interval", 'AS "interval"'))
def p17(spark, sf):
    k = F.col("p_partkey") % 4
    d = read(spark, sf, "part").withColumn("span", F.when(k == 0, "15m").when(k == 1, "4H").when(k == 2, "1d").otherwise("7x"))
    return d.select("p_partkey", C.normalise_interval("span").alias("interval"), C.duration_minutes("span").cast("double").alias("minutes"))


@query("p18_epoch_ms_to_ts", "SELECT event_id, date_trunc('milliseconds', ts) AS ts FROM events")
def p18(spark, sf):
    return read(spark, sf, "events").select("event_id", C.epoch_ms_to_ts(F.unix_millis("ts")).alias("ts"))


@query("p19_split_symbol", f"""SELECT p_partkey, regexp_matches(s, '^[A-Z]{{2,10}}(USDT|USD|BUSD|BTC|ETH|BNB)$') AS valid, left(s, length(s) - n) AS base, right(s, n) AS quote FROM (
    SELECT *, CASE WHEN s LIKE '%USDT' THEN 4 WHEN s LIKE '%USD' THEN 3 WHEN s LIKE '%BTC' THEN 3 WHEN s LIKE '%ETH' THEN 3 ELSE least(4, length(s)) END AS n
    FROM (SELECT p_partkey, upper(regexp_replace({PAIR}, '[-/_]', '', 'g')) AS s FROM part))""")
def p19(spark, sf):
    d = pairs(spark, sf).withColumn("s", C.strip_symbol("pair"))
    return d.select("p_partkey", C.valid_symbol("s").alias("valid"), C.split_symbol("s").alias("x")).select("p_partkey", "valid", "x.base", "x.quote")


@query("p20_safe_math", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('CASE WHEN l_discount = 0 THEN -1 ELSE l_tax / l_discount END')} AS safe, {R('greatest(0.02, least(0.07, l_tax))')} AS clamped,
    {R('CASE WHEN l_discount = 0 THEN sign(l_tax) ELSE (l_tax - l_discount) / abs(l_discount) END')} AS change FROM lineitem""")
def p20(spark, sf):
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(C.safe_divide("l_tax", "l_discount", -1.0)).alias("safe"), r(C.clamp("l_tax", 0.02, 0.07)).alias("clamped"),
        r(C.pct_change_signed("l_discount", "l_tax")).alias("change"))


@query("p21_round_to_step", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('round_even(l_quantity / 2.0::DOUBLE, 0) * 2.0::DOUBLE')} AS stepped FROM lineitem")
def p21(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(C.round_to_step("l_quantity", 2.0)).alias("stepped"))


@query("p22_position_size", with_views("bars", f"SELECT symbol, ts, {R('10000 * 0.01 / (close * 0.02)')} AS size, {R('close * volume * 0.001', 6)} AS fee, volume BETWEEN 10 AND 100 AS ok FROM bars"))
def p22(spark, sf):
    return bars(spark, sf).select(*KEYS, r(C.risk_position_size(F.lit(10_000.0), 0.01, 0.02, "close")).alias("size"),
                                  r(C.fee(F.col("close") * F.col("volume"), 0.001), 6).alias("fee"), C.valid_quantity("volume", 10.0, 100.0).alias("ok"))


@query("p23_normalise_order_type", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'market' WHEN 1 THEN 'limit' WHEN 2 THEN 'stop' WHEN 3 THEN 'stop_limit' ELSE 'market' END AS kind FROM orders""")
def p23(spark, sf):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, " MKT").when(k == 1, "lmt ").when(k == 2, "Stp").when(k == 3, "STOP_LIMIT").otherwise("iceberg")
    return read(spark, sf, "orders").select("o_orderkey", C.normalise_order_type(raw).alias("kind"))


@query("p24_formats", "SELECT p_partkey, printf('%.2f', p_retailprice) AS price, printf('%.1f%%', p_size * 1.0) AS pct, 'USD ' || format('{:,.2f}', p_retailprice) AS money FROM part")
def p24(spark, sf):
    return read(spark, sf, "part").select("p_partkey", C.format_price("p_retailprice").alias("price"), C.format_percentage(F.col("p_size") / 100, 1).alias("pct"), C.format_currency("p_retailprice").alias("money"))
