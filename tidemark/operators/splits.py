"""Time splits, folds, scaling and hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.chunks import Level, Series, number_rows

SPLITS = ("train", "validation", "test")


def _cut(df: DataFrame, series: Series, first: Column, second: Column, out: str) -> DataFrame:
    d = number_rows(df, series, "_pos", "_n")
    bucket = F.when(F.col("_pos") < first, "train").when(F.col("_pos") < second, "validation").otherwise("test")
    return d.withColumn(out, bucket).drop("_pos", "_n")


def time_split(df: DataFrame, series: Series, train: float = 0.6, test: float = 0.2, out: str = "split") -> DataFrame:
    """floor(n*train) rows, the rest, then floor(n*test) rows at the end of each series."""
    n = F.col("_n")
    first = F.floor(n * F.lit(train))
    return _cut(df, series, first, n - F.floor(n * F.lit(test)), out)


def sequence_split(df: DataFrame, series: Series, val: float = 0.2, test: float = 0.1, out: str = "split") -> DataFrame:
    """As :func:`time_split`, with the sizes of validation and test given."""
    n = F.col("_n")
    held, last = F.floor(n * F.lit(val)), F.floor(n * F.lit(test))
    return _cut(df, series, n - held - last, n - last, out)


def split_at(df: DataFrame, train_end, validation_end, ts: str = "ts", out: str = "split") -> DataFrame:
    """One cut over all series: at timestamps, so that no split shares a time with another."""
    t = F.col(ts)
    bucket = F.when(t < F.lit(train_end).cast("timestamp"), "train").when(
        t < F.lit(validation_end).cast("timestamp"), "validation"
    )
    return df.withColumn(out, bucket.otherwise("test"))


def split_ranges(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", split: str = "split") -> DataFrame:
    return df.groupBy(*keys, split).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def leakage(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", split: str = "split") -> DataFrame:
    """Per series: does every split end before the next one starts?"""
    at = {s: F.col(split) == s for s in SPLITS}
    d = df.groupBy(*keys).agg(
        F.max(F.when(at["train"], F.col(ts))).alias("train_end"),
        F.min(F.when(at["validation"], F.col(ts))).alias("validation_start"),
        F.max(F.when(at["validation"], F.col(ts))).alias("validation_end"),
        F.min(F.when(at["test"], F.col(ts))).alias("test_start"),
    )
    before = lambda a, b: F.coalesce(F.col(a) < F.col(b), F.lit(True))
    ok = before("train_end", "validation_start") & before("validation_end", "test_start") & before("train_end", "test_start")
    return d.withColumn("ok", ok)


def assert_no_leakage(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", split: str = "split") -> None:
    bad = leakage(df, keys, ts, split).filter(~F.col("ok")).limit(1).count()
    if bad:
        raise ValueError("splits overlap in time")


def slice_by_split_ranges(
    features: DataFrame, splits: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", split: str = "split"
) -> DataFrame:
    """Give each feature row the split whose time range holds it; rows outside all ranges go.

    A key has at most three ranges, which travel as one small array per key.
    """
    ranges = split_ranges(splits, keys, ts, split).groupBy(*keys).agg(
        F.collect_list(F.struct("first_ts", "last_ts", F.col(split).alias("name"))).alias("_ranges")
    )
    hit = F.filter("_ranges", lambda x: (F.col(ts) >= x["first_ts"]) & (F.col(ts) <= x["last_ts"]))
    d = features.join(ranges, list(keys)).withColumn("_hit", hit).filter(F.size("_hit") > 0)
    return d.withColumn(split, F.col("_hit")[0]["name"]).drop("_ranges", "_hit")


def minmax_scale(
    df: DataFrame, cols: list[str], low: float = -1.0, high: float = 1.0, split: str | None = "split", keys: tuple[str, ...] = ()
) -> DataFrame:
    """Scale to [low, high] with the range of the training rows; a constant column becomes ``low``."""
    fit = df.filter(F.col(split) == "train") if split else df
    stats = fit.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    d = _attach(df, stats, keys)
    scaled = {}
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        span = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
        scaled[c] = (F.col(c) - lo) / span * F.lit(high - low) + F.lit(low)
    return d.withColumns(scaled).select(*df.columns)


def standard_scale(df: DataFrame, cols: list[str], split: str | None = "split", keys: tuple[str, ...] = ()) -> DataFrame:
    """Subtract the training mean and divide by the training (population) deviation."""
    fit = df.filter(F.col(split) == "train") if split else df
    stats = fit.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    d = _attach(df, stats, keys)
    scaled = {}
    for c in cols:
        dev = F.col(f"_s_{c}")
        scaled[c] = (F.col(c) - F.col(f"_m_{c}")) / F.when(dev == 0, F.lit(1.0)).otherwise(dev)
    return d.withColumns(scaled).select(*df.columns)


def _attach(df: DataFrame, stats: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    if keys:
        return df.join(stats, list(keys))
    # Without keys the fit is a single row.
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")


def time_series_folds(df: DataFrame, series: Series, k: int) -> DataFrame:
    """Expanding folds: blocks of floor(n/(k+1)) rows at the end; fold j tests block j and trains on all rows before."""
    d = number_rows(df, series, "_pos", "_n")
    size = F.floor(F.col("_n") / (k + 1))
    start = F.col("_n") - (F.lit(k) - F.col("fold")) * size
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    role = F.when(F.col("_pos") < start, "train").when(F.col("_pos") < start + size, "test")
    return d.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_pos", "_n")


def hash_rank(*cols: str) -> Column:
    """A stable pseudo-random number in [0, 2^48) from the row key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols])), 1, 12), 16, 10).cast("long")


def holdout_split(df: DataFrame, fraction: float, stratify: str, key: tuple[str, ...], out: str = "holdout") -> DataFrame:
    """Mark floor(n_class * fraction) rows of each class, chosen by the hash of the row key."""
    step = float(2**48) / 1024
    s = Series(
        keys=(stratify,), order=("_hash", *key), levels=(Level("_hash", step), Level("_hash", step / 65_536))
    )
    d = number_rows(df.withColumn("_hash", hash_rank(*key)), s, "_pos", "_n")
    return d.withColumn(out, F.col("_pos") < F.floor(F.col("_n") * F.lit(fraction))).drop("_hash", "_pos", "_n")


def row_guard(df: DataFrame, n_features: int, split: str = "split", total: int = 500, per_split: int = 100, features: int = 5, test_rows: int | None = None) -> DataFrame:
    """One row: sizes and whether every minimum holds."""
    counts = {s: F.count_if(F.col(split) == s) for s in SPLITS}
    d = df.agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"n_{s}") for s, c in counts.items()])
    d = d.withColumn("n_features", F.lit(n_features))
    ok = (F.col("n") >= total) & (F.col("n_features") >= features)
    for s in SPLITS:
        ok = ok & (F.col(f"n_{s}") >= per_split)
    if test_rows is not None:
        ok = ok & (F.col("n_test") >= test_rows)
    return d.withColumn("ok", ok)


def require_rows(df: DataFrame, n_features: int, **limits) -> None:
    row = row_guard(df, n_features, **limits).first()
    if not row["ok"]:
        raise ValueError(f"too few rows or features: {row.asDict()}")
