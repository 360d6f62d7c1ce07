"""Data-quality checks and scores, one row per series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import ohlc_ordered, ratio
from tidemark.plans.chunks import Series, over_chunks
from tidemark.plans.quantiles import exact_percentiles
from tidemark.schemas import BAR_COLUMNS
from tidemark.session import stage

PRICES = ("open", "high", "low", "close")
# How many points a source loses.
SOURCE_PENALTY = {"yahoo": 5.0, "alpha_vantage": 2.0, "binance_ws": 10.0}


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def _bad_ohlc() -> Column:
    return ~F.coalesce(ohlc_ordered(), F.lit(False))


def structure_issues(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Null counts per required column and the number of structural issues.

    Missing columns, non-numeric columns and a non-timestamp time column count one issue each kind
    or column; any nulls at all count one.
    """
    present = [c for c in (ts, *BAR_COLUMNS) if c in df.columns]
    missing = [c for c in (ts, *BAR_COLUMNS) if c not in df.columns]
    fixed = int(bool(missing))
    types = {f.name: f.dataType for f in df.schema.fields}
    if ts in types and not isinstance(types[ts], (T.TimestampType, T.TimestampNTZType, T.DateType)):
        fixed += 1
    fixed += sum(1 for c in BAR_COLUMNS if c in types and not isinstance(types[c], T.NumericType))
    d = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    )
    any_null = reduce(lambda a, b: a + b, [F.col(f"null_{c}") for c in present]) > 0
    return d.withColumn("structure_issues", F.lit(fixed) + any_null.cast("int"))


def _gaps(df: DataFrame, series: Series) -> DataFrame:
    ts = series.order[0]
    d = over_chunks(
        df.select(*series.keys, *series.order), series,
        lambda c: {"gap_s": (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(c.window))) / F.lit(1e6)}, before=1,
    )
    d = stage(d, "gaps")
    med = exact_percentiles(d, list(series.keys), F.col("gap_s"), {"median_s": 0.5})
    return d.join(med, list(series.keys), "left")


def temporal_gaps(df: DataFrame, series: Series) -> DataFrame:
    """Gaps are steps longer than twice the median step; their share of the covered time in percent."""
    ts = series.order[0]
    long = F.col("gap_s") > 2 * F.col("median_s")
    d = _gaps(df, series).groupBy(*series.keys).agg(
        F.first("median_s").alias("median_s"),
        F.count_if(long).alias("total_gaps"),
        F.sum(F.when(long, F.col("gap_s"))).alias("_lost"),
        ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1e6)).alias("_span"),
    )
    pct = F.coalesce(F.try_divide(F.col("_lost") * 100.0, F.col("_span")), F.lit(0.0))
    return d.select(*series.keys, "median_s", "total_gaps", pct.alias("gap_pct"))


def first_gaps(df: DataFrame, series: Series, n: int = 5) -> DataFrame:
    """The first ``n`` gaps of each series."""
    ts = series.order[0]
    g = _gaps(df, series).filter(F.col("gap_s") > 2 * F.col("median_s"))
    rank = F.row_number().over(Window.partitionBy(*series.keys).orderBy(ts))
    return g.withColumn("rank", rank).filter(F.col("rank") <= n).select(*series.keys, ts, "gap_s", "rank")


def realistic_prices(df: DataFrame, series: Series, ceiling: float = 1_000_000.0, jump: float = 0.5) -> DataFrame:
    """Counts of non-positive, absurd and jumping prices, the price range and the number of issues."""
    d = over_chunks(df, series, lambda c: {"_r": ratio("close", F.lag("close").over(c.window)) - 1}, before=1)
    keys = list(series.keys)
    agg = d.groupBy(*keys).agg(
        *[F.count_if(F.col(c) <= 0).alias(f"nonpositive_{c}") for c in PRICES],
        *[F.count_if(F.col(c) > ceiling).alias(f"extreme_{c}") for c in PRICES],
        F.count_if(F.abs("_r") > jump).alias("jumps"),
        F.min("low").alias("min_price"),
        F.max("high").alias("max_price"),
    )
    kinds = [*[f"nonpositive_{c}" for c in PRICES], *[f"extreme_{c}" for c in PRICES], "jumps"]
    agg = agg.withColumn("price_issues", reduce(lambda a, b: a + b, [(F.col(k) > 0).cast("int") for k in kinds]))
    return agg.join(exact_percentiles(df, keys, F.col("close"), {"median_price": 0.5}), keys, "left")


def ohlc_consistency(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(_bad_ohlc()).alias("invalid"))
    return d.select(*keys, "invalid", _pct(F.col("invalid"), F.col("n")).alias("invalid_pct"))


def iqr_outliers(df: DataFrame, keys: tuple[str, ...] = ("symbol",), col: str = "close", k: float = 1.5) -> DataFrame:
    q = exact_percentiles(df, list(keys), F.col(col), {"q1": 0.25, "q3": 0.75})
    q = q.select(
        *keys,
        (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
        (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper_bound"),
    )
    out = (F.col(col) < F.col("lower_bound")) | (F.col(col) > F.col("upper_bound"))
    d = df.join(q, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(out).alias("outliers"),
        F.first("lower_bound").alias("lower_bound"), F.first("upper_bound").alias("upper_bound"),
    )
    return d.select(*keys, "outliers", _pct(F.col("outliers"), F.col("n")).alias("outlier_pct"), "lower_bound", "upper_bound")


def volume_quality(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    d = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.avg("volume").alias("mean_volume"),
        F.stddev_samp("volume").alias("std_volume"),
    )
    d = d.join(exact_percentiles(df, list(keys), F.col("volume"), {"median_volume": 0.5}), list(keys), "left")
    return d.select(
        *keys, "zero_volume", _pct(F.col("zero_volume"), F.col("n")).alias("zero_pct"), "negative_volume",
        "mean_volume", "median_volume", "std_volume",
    )


# Fixed texts of the recommendations.
ADVICE = {
    "critical": "critical quality: consider another source",
    "gaps": "fill time gaps or use a source with better coverage",
    "prices": "filter or correct invalid prices",
    "ohlc": "correct inconsistent OHLC rows",
    "none": "good quality: no action needed",
}


def quality_report(df: DataFrame, series: Series) -> DataFrame:
    """Overall score 0-100 per series with its parts and rule-based advice."""
    keys = list(series.keys)
    parts = [
        structure_issues(df, series.keys, series.order[0]).select(*keys, "structure_issues"),
        temporal_gaps(df, series).select(*keys, "gap_pct"),
        realistic_prices(df, series).withColumn(
            "bad_prices", reduce(lambda a, b: a + b, [F.col(f"nonpositive_{c}") for c in PRICES])
        ).select(*keys, "price_issues", "bad_prices"),
        ohlc_consistency(df, series.keys).select(*keys, "invalid_pct"),
        iqr_outliers(df, series.keys).select(*keys, "outlier_pct"),
        volume_quality(df, series.keys).select(*keys, "zero_pct"),
    ]
    d = reduce(lambda a, b: a.join(b, keys, "left"), parts)
    gap, invalid, outlier, zero = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("gap_pct", "invalid_pct", "outlier_pct", "zero_pct"))
    score = (
        F.lit(100.0)
        - 10 * F.col("structure_issues")
        - F.when(gap > 5, F.least(gap, F.lit(20.0))).otherwise(0.0)
        - 5 * F.col("price_issues")
        - F.when(invalid > 1, invalid).otherwise(0.0)
        - F.when(outlier > 2, outlier * 0.5).otherwise(0.0)
        - F.when(zero > 10, zero * 0.5).otherwise(0.0)
    )
    d = d.withColumn("quality", F.greatest(score, F.lit(0.0)))
    advice = F.array_compact(
        F.array(
            F.when(F.col("quality") < 50, ADVICE["critical"]),
            F.when(gap > 5, ADVICE["gaps"]),
            F.when(F.col("bad_prices") > 0, ADVICE["prices"]),
            F.when(invalid > 1, ADVICE["ohlc"]),
        )
    )
    d = d.withColumn("advice", F.when(F.size(advice) == 0, F.array(F.lit(ADVICE["none"]))).otherwise(advice))
    return d.drop("bad_prices")


def duplicate_timestamps(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Rows beyond the first per (key, ts)."""
    once = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_c"))
    return once.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") - 1).alias("duplicates"))


def _null_cells(cols) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])


def source_score(df: DataFrame, source: str = "source", keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """Score per source (and key); the source name also sets a fixed penalty."""
    group = [source, *keys]
    need = [ts, *BAR_COLUMNS]
    missing = any(c not in df.columns for c in need)
    have = [c for c in need if c in df.columns]
    bad = ~F.coalesce(ohlc_ordered() & (F.col("open") > 0) & (F.col("close") > 0), F.lit(False))
    d = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("record_count"), F.sum(_null_cells(have)).alias("_null"), F.count_if(bad).alias("_bad")
    ).join(duplicate_timestamps(df, tuple(group), ts).select(*group, "duplicates"), group)
    n = F.col("record_count")
    penalty = F.lit(0.0)
    for name, points in SOURCE_PENALTY.items():
        penalty = F.when(F.col(source) == name, F.lit(points)).otherwise(penalty)
    score = (
        F.lit(50.0 if missing else 100.0)
        - F.col("_null") / (n * len(need)) * 100 * 2
        - F.col("_bad") / n * 100
        - F.col("duplicates") / n * 100 * 2
        - penalty
    )
    return d.select(*group, "record_count", F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)).alias("score"))


def cache_quality_score(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    cols = [c for c in (ts, *BAR_COLUMNS) if c in df.columns]
    nonpositive = reduce(lambda a, b: a + b, [F.coalesce((F.col(c) <= 0).cast("int"), F.lit(0)) for c in PRICES])
    d = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_null_cells(cols)).alias("_null"), F.sum(nonpositive).alias("_np"),
        F.count_if(_bad_ohlc()).alias("_bad"),
    ).join(duplicate_timestamps(df, keys, ts).select(*keys, "duplicates"), list(keys))
    n = F.col("n")
    missing = F.col("_null") / (n * len(cols)) * 100
    score = F.lit(100.0) - missing * 2 - F.col("duplicates") / n * 50 - F.col("_np") / n * 100 - F.col("_bad") / n * 100
    return d.select(*keys, "n", missing.alias("missing_pct"), "duplicates", F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)).alias("score"))


def select_best_source(scores: DataFrame, priority: list[str], source: str = "source", good: float = 80.0) -> DataFrame:
    """The first source in priority order with a good score, else the best (score, rows)."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(source))
    ok = F.col("score") >= good
    return (
        scores.withColumn("_rank", F.when(ok, F.when(rank > 0, rank).otherwise(F.lit(len(priority) + 1))))
        .orderBy(F.col("_rank").asc_nulls_last(), F.col("score").desc(), F.col("record_count").desc(), source)
        .limit(1)
        .drop("_rank")
    )


def rows_of_best_source(df: DataFrame, winner: DataFrame, source: str = "source") -> DataFrame:
    return df.join(winner.select(source), source, "left_semi")
