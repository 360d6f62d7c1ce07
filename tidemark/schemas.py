"""Row types of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

BAR_COLUMNS = ("open", "high", "low", "close", "volume")

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS]
)

BARS_CSV = T.StructType(
    [T.StructField("timestamp", T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS]
)

# Fixed column names of the flat line layout.
KLINE_FLAT = (
    "event_time long, symbol string, interval string, open_time long, close_time long, "
    "first_trade_id long, last_trade_id long, open double, high double, low double, close double, "
    "volume double, quote_volume double, trade_count long, taker_buy_volume double, "
    "taker_buy_quote_volume double, is_closed boolean, received_at string"
)

TRADES = "trade_id long, symbol string, side string, quantity double, price double, ts timestamp"
SIGNALS = "symbol string, signal string, confidence double, probability double, position_size double, ts timestamp, metadata string"
