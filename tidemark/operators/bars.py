"""Building, cleaning and combining bar tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.plans.chunks import Series, over_chunks, running
from tidemark.schemas import BAR_COLUMNS
from tidemark.session import stage

PRICES = ("open", "high", "low", "close")


def build_bars(
    ticks: DataFrame,
    interval: str = "1 minute",
    keys: tuple[str, ...] = ("symbol",),
    ts: str = "ts",
    price: str = "px",
    size: str = "qty",
    tie: tuple[str, ...] = (),
) -> DataFrame:
    """Tumbling OHLCV bars. Works on batch and streaming frames; partial aggregates run before the shuffle."""
    at = F.struct(ts, *tie) if tie else F.col(ts)
    return (
        ticks.groupBy(*keys, F.window(ts, interval).alias("_w"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            F.sum(size).alias("volume"),
        )
        .select(*keys, F.col("_w.start").alias(ts), *BAR_COLUMNS)
    )


def normalise_columns(df: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] = ("ts", *BAR_COLUMNS)) -> DataFrame:
    return df.withColumnsRenamed(mapping).select(*keep)


def union_chunks(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tag_and_union_symbols(parts: dict[str, DataFrame]) -> DataFrame:
    return union_chunks([df.withColumn("symbol", F.lit(s)) for s, df in parts.items()])


def dedupe_last(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row per key, the one with the greatest ``order``; reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def drop_missing(df: DataFrame, cols: tuple[str, ...] = BAR_COLUMNS) -> DataFrame:
    return df.na.drop(subset=list(cols))


def drop_nonpositive_prices(df: DataFrame) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in PRICES]))


def drop_extreme_moves(df: DataFrame, series: Series, limit: float = 0.5) -> DataFrame:
    """Keep rows that moved at most ``limit`` from the row before; the first row of a series goes."""
    out = over_chunks(df, series, lambda c: {"_r": C.ratio("close", F.lag("close").over(c.window)) - 1}, before=1)
    return out.filter(F.abs("_r") <= limit).drop("_r")


def drop_zero_volume(df: DataFrame) -> DataFrame:
    return df.filter(F.col("volume") > 0)


def forward_fill(df: DataFrame, series: Series, cols: list[str]) -> DataFrame:
    """Replace ±inf, NaN and null by the last proper value of the series."""
    filled = running(df, series, {f"_f_{c}": ("last", C.inf_to_null(c)) for c in cols})
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=cols)


def clean_bars(df: DataFrame, series: Series, limit: float = 0.5) -> DataFrame:
    """Missing and non-positive prices out, extreme moves out, other columns filled, rest dropped."""
    out = drop_extreme_moves(drop_nonpositive_prices(drop_missing(df)), series, limit)
    skip = {*series.keys, *[o.lstrip("-") for o in series.order], *BAR_COLUMNS}
    extra = [f.name for f in out.schema.fields if f.name not in skip and f.dataType.simpleString() in ("double", "float")]
    if extra:
        out = forward_fill(stage(out, "cleaned"), series, extra)
    return out.na.drop()


def clean_vendor_bars(df: DataFrame, series: Series, limit: float = 0.5) -> DataFrame:
    """Vendor cleaner: valid rows only, extreme moves out, zero volume out."""
    return drop_zero_volume(drop_extreme_moves(drop_missing(df).filter(C.ohlc_valid()), series, limit))


def check_integrity(df: DataFrame) -> DataFrame:
    """Violation counts of the six bar rules, in one pass."""
    h, l = F.col("high"), F.col("low")
    rules = {
        "high_below_low": h < l,
        "high_below_open": h < F.col("open"),
        "high_below_close": h < F.col("close"),
        "low_above_open": l > F.col("open"),
        "low_above_close": l > F.col("close"),
        "negative_volume": F.col("volume") < 0,
    }
    return df.agg(*[F.count_if(rule).alias(n) for n, rule in rules.items()])


def assert_integrity(df: DataFrame) -> None:
    bad = {k: v for k, v in check_integrity(df).first().asDict().items() if v}
    if bad:
        raise ValueError(f"bar integrity: {bad}")


def add_basic_features(df: DataFrame, series: Series) -> DataFrame:
    """Returns, log returns, ranges, short volume average and calendar parts."""

    def cols(c) -> dict[str, Column]:
        prev = F.lag("close").over(c.window)
        ma = F.avg("volume").over(c.last(5))
        return {
            "returns": C.ratio("close", prev) - 1,
            "log_returns": F.ln(C.ratio("close", prev)),
            "price_range": C.price_range(),
            "body_size": C.body_size(),
            "volume_ma_5": ma,
            "volume_ratio": C.ratio("volume", ma),
            **C.time_parts(series.order[0]),
        }

    return over_chunks(df, series, cols, before=4)


BASE_COLUMNS = ("symbol", "ts", *BAR_COLUMNS)


def select_features(df: DataFrame, names: list[str] | None, base: tuple[str, ...] = BASE_COLUMNS) -> DataFrame:
    """Base columns plus every column whose name contains one of ``names`` (all if none given)."""
    if not names:
        return df
    return df.select(*[c for c in df.columns if c in base or any(n in c for n in names)])


def date_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def lookback(df: DataFrame, now, days: float, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(days * 86_400.0)))
