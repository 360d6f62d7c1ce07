"""Scalar column functions: prices, symbols, durations, cleaning, display."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote currencies in matching order, order type aliases, kline intervals.
QUOTES = ("USDT", "USD", "BUSD", "BTC", "ETH", "BNB")
SYMBOL_PATTERN = r"^[A-Z]{2,10}(USDT|USD|BUSD|BTC|ETH|BNB)$"
ORDER_TYPES = ("market", "limit", "stop", "stop_limit")
ORDER_ALIASES = {"mkt": "market", "lmt": "limit", "stp": "stop"}
INTERVALS = ("1m", "5m", "15m", "30m", "1h", "4h", "1d")
FEED_SYMBOLS = {"BTCUSD": "BTCUSDT", "BTCUS": "BTCUSDT", "ETHUSD": "ETHUSDT", "ETHUS": "ETHUSDT"}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(_c(a), _c(b))


def price_range(denom="close") -> Column:
    d = _c(denom)
    return ratio(F.col("high") - F.col("low"), d)


def body_size(denom="close") -> Column:
    return ratio(F.abs(F.col("close") - F.col("open")), denom)


def price_range_live() -> Column:
    return F.when(F.col("low") > 0, price_range("low")).otherwise(F.lit(0.0))


def body_size_live() -> Column:
    return F.when(F.col("open") > 0, body_size("open")).otherwise(F.lit(0.0))


def time_parts(ts="ts") -> dict[str, Column]:
    """hour, day_of_week (Monday = 0) and is_weekend."""
    t = _c(ts)
    day = F.weekday(t)
    return {"hour": F.hour(t), "day_of_week": day, "is_weekend": (day >= 5).cast("int")}


def high_low_ratio() -> Column:
    return ratio("high", "low")


def open_close_ratio() -> Column:
    return ratio("open", "close")


def ohlc_ordered() -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (h >= l) & (h >= o) & (h >= c) & (l <= o) & (l <= c)


def ohlc_valid(strict: bool = False) -> Column:
    """High/low bracket open and close, prices positive, volume not negative (positive if strict)."""
    positive = F.lit(True)
    for x in ("open", "high", "low", "close"):
        positive = positive & (F.col(x) > 0)
    volume = F.col("volume") > 0 if strict else F.col("volume") >= 0
    return F.coalesce(ohlc_ordered() & positive & volume, F.lit(False))


def inf_to_null(col) -> Column:
    c = _c(col)
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def nan_inf_to_zero(col) -> Column:
    return F.coalesce(inf_to_null(col), F.lit(0.0))


def normalise_symbol(col) -> Column:
    """Upper case without separators; a USD quote becomes USDT."""
    s = F.upper(F.regexp_replace(_c(col), r"[-/_]", ""))
    return F.when(s.endswith("USD"), F.concat(s, F.lit("T"))).otherwise(s)


def strip_symbol(col) -> Column:
    """Upper case without separators."""
    return F.upper(F.regexp_replace(_c(col), r"[-/_]", ""))


def feed_symbol(col) -> Column:
    """Without separators; known short forms map to their USDT pair, otherwise a T is added unless there is one."""
    clean = F.regexp_replace(_c(col), r"[-/_]", "")
    out = F.when(F.lit(False), clean)
    for short, pair in FEED_SYMBOLS.items():
        out = out.when(F.upper(clean) == short, F.lit(pair))
    return out.when(~clean.endswith("T"), F.concat(F.upper(clean), F.lit("T"))).otherwise(F.upper(clean))


def normalise_interval(col) -> Column:
    s = F.lower(_c(col))
    return F.when(s.isin(*INTERVALS), s).otherwise(F.lit("1m"))


def duration_minutes(col) -> Column:
    """'15m', '4h', '1d' as minutes; null where it is not a duration."""
    s = F.lower(F.trim(_c(col)))
    n = F.regexp_extract(s, r"^(\d+)[mhd]$", 1)
    unit = F.regexp_extract(s, r"^\d+([mhd])$", 1)
    scale = F.when(unit == "m", 1).when(unit == "h", 60).when(unit == "d", 1440)
    return F.try_to_number(F.when(n != "", n), F.lit("999999999")).cast("int") * scale


def duration_to_bars(duration: str | int, bar: str = "1m") -> int:
    """Number of rows of width ``bar`` that a duration spans (at least 1)."""
    return max(1, _minutes(duration) // _minutes(bar))


def _minutes(duration: str | int) -> int:
    if isinstance(duration, int):
        return duration
    m = re.fullmatch(r"\s*(\d+)\s*([mhd])\s*", duration.lower())
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    return int(m.group(1)) * {"m": 1, "h": 60, "d": 1440}[m.group(2)]


def epoch_ms_to_ts(col) -> Column:
    return F.timestamp_millis(_c(col))


def valid_symbol(col) -> Column:
    return _c(col).rlike(SYMBOL_PATTERN)


def split_symbol(col) -> Column:
    """struct(base, quote): the first matching quote, else the last four characters."""
    s = _c(col)
    n = F.lit(4)
    for q in reversed(QUOTES):
        n = F.when(s.endswith(q), F.lit(len(q))).otherwise(n)
    cut = F.greatest(F.length(s) - n, F.lit(0))
    return F.struct(F.substring(s, F.lit(1), cut).alias("base"), F.substring(s, cut + 1, F.length(s)).alias("quote"))


def safe_divide(a, b, default: float = 0.0) -> Column:
    return F.when(_c(b) == 0, F.lit(default)).otherwise(F.try_divide(_c(a), _c(b)))


def clamp(col, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(col)))


def pct_change_signed(old, new) -> Column:
    """Relative change against \\|old\\|; 0, 1 or -1 where old is 0."""
    o, n = _c(old), _c(new)
    return F.when(o == 0, F.signum(n).cast("double")).otherwise(F.try_divide(n - o, F.abs(o)))


def round_to_step(col, step: float) -> Column:
    """Nearest multiple of ``step``; halves go to the even multiple."""
    return F.rint(_c(col) / F.lit(step)) * F.lit(step)


def risk_position_size(capital, risk_pct: float, stop_pct: float, price) -> Column:
    return F.try_divide(_c(capital) * F.lit(risk_pct), _c(price) * F.lit(stop_pct))


def fee(amount, rate: float) -> Column:
    return _c(amount) * F.lit(rate)


def valid_quantity(col, low: float = 0.000001, high: float = 1_000_000.0) -> Column:
    return _c(col).between(low, high)


def normalise_order_type(col) -> Column:
    s = F.lower(F.trim(_c(col)))
    out = F.when(s.isin(*ORDER_TYPES), s)
    for alias, name in ORDER_ALIASES.items():
        out = out.when(s == alias, F.lit(name))
    return out.otherwise(F.lit("market"))


def format_price(col, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", _c(col))


def format_percentage(col, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f%%", _c(col) * 100)


def format_currency(col, currency: str = "USD") -> Column:
    return F.concat(F.lit(f"{currency} "), F.format_number(_c(col), 2))
