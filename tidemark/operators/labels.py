"""Forward-looking labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import duration_to_bars
from tidemark.plans.blocks import first_hit, first_touches
from tidemark.plans.chunks import Series, over_chunks


#: Horizons up to this many rows are looked through as an array of the next rows; longer ones block by block.
SHORT = 64


def triple_barrier(
    df: DataFrame, series: Series, horizon: int = 15, profit: float = 0.02, stop: float = 0.02, out: str = "label"
) -> DataFrame:
    """1 / -1 for the barrier that one of the next ``horizon`` rows touches first, the upper one on the
    same row; 0 without a touch and for the last ``horizon`` rows."""
    upper, lower = F.col("close") * F.lit(1 + profit), F.col("close") * F.lit(1 - stop)
    if horizon > SHORT:
        d = first_touches(df, series, horizon, {"_up": ("high", ">=", upper), "_down": ("low", "<=", lower)})
        whole = F.col("_n") - 1 - F.col("_pos") >= horizon
    else:
        d = over_chunks(df, series, lambda c: {"_path": F.collect_list(F.struct("high", "low")).over(c.next(horizon))}, after=horizon)
        up = first_hit(F.col("_path"), lambda p: p["high"] >= upper)
        d = d.withColumns({"_up": up, "_down": first_hit(F.col("_path"), lambda p: p["low"] <= lower)})
        whole = F.size("_path") >= horizon
    label = (
        F.when(~whole, 0)
        .when(F.col("_up").isNotNull() & (F.col("_down").isNull() | (F.col("_up") <= F.col("_down"))), 1)
        .when(F.col("_down").isNotNull(), -1)
        .otherwise(0)
    )
    return d.withColumn(out, label).drop("_path", "_up", "_down", "_pos", "_n")


def binary_label(label: Column | str = "label") -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == 1, 1).otherwise(0)


def sign_return_label(df: DataFrame, series: Series, horizon: int = 15, out: str = "y") -> DataFrame:
    """1 if the close ``horizon`` rows ahead is higher, else 0; null for the last ``horizon`` rows."""
    d = over_chunks(df, series, lambda c: {"_ahead": F.lead("close", horizon).over(c.window)}, after=horizon)
    up = F.try_divide(F.col("_ahead"), F.col("close")) - 1 > 0
    return d.withColumn(out, F.when(F.col("_ahead").isNotNull(), F.coalesce(up.cast("int"), F.lit(0)))).drop("_ahead")


@dataclass(frozen=True)
class LabelConfig:
    method: str = "triple_barrier"
    horizon: str | int = "15m"
    bar: str = "1m"
    profit: float = 0.02
    stop: float = 0.02


def make_labels(df: DataFrame, series: Series, config: LabelConfig = LabelConfig(), out: str = "y") -> DataFrame:
    h = duration_to_bars(config.horizon, config.bar)
    if config.method == "triple_barrier":
        d = triple_barrier(df, series, h, config.profit, config.stop, "_label")
        return d.withColumn(out, binary_label("_label")).drop("_label")
    if config.method == "sign_return_h":
        return sign_return_label(df, series, h, out)
    raise ValueError(f"unknown label method: {config.method}")


def label_distribution(df: DataFrame, label: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """Count and share per class; nulls are a class of their own. Shares are within ``keys``."""
    per_class = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        total = per_class.agg(F.sum("n").alias("_t")).withColumn("_one", F.lit(1))
        d = per_class.withColumn("_one", F.lit(1)).join(total, "_one")
    else:
        d = per_class.join(per_class.groupBy(*keys).agg(F.sum("n").alias("_t")), list(keys))
    return d.select(*keys, label, "n", (F.col("n") / F.col("_t")).alias("share"))


def require_classes(df: DataFrame, label: str = "y", at_least: int = 2) -> None:
    n = df.select(label).filter(F.col(label).isNotNull()).distinct().limit(at_least).count()
    if n < at_least:
        raise ValueError(f"labels hold {n} class(es), {at_least} needed")


def align_labels(features: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("symbol", "ts"), label: str = "y", split: str | None = None) -> DataFrame:
    """Join features and labels on the row key. Rows without a label go, except that rows of the test
    split stay with a null label (no row of it is used for fitting)."""
    d = features.join(labels.select(*keys, label), list(keys))
    if split is None:
        return d.filter(F.col(label).isNotNull())
    is_test = F.col(split) == "test"
    return d.filter(is_test | F.col(label).isNotNull()).withColumn(label, F.when(~is_test, F.col(label)))
