"""Sinks: splits, features, sequences, run results, metrics and ledger exports."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Parquet per split, and row counts, time range and columns as JSON."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/splits")
    back = df.sparkSession.read.parquet(f"{path}/splits")
    meta = back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    meta = meta.withColumn("columns", F.array(*[F.lit(c) for c in df.columns if c != "split"]))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_features(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_sequences(df: DataFrame, path: str, split: str = "split", seq: str = "seq") -> None:
    """Sequence arrays per split and their shapes."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/sequences")
    back = df.sparkSession.read.parquet(f"{path}/sequences")
    shape = back.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(seq)).alias("length"), F.max(F.size(F.col(seq)[0])).alias("width")
    )
    shape.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_run(trades: DataFrame, equity: DataFrame, results: DataFrame, path: str, keys: tuple[str, ...] = ("model",), run: str | None = None) -> str:
    """Trades and equity as CSV and results as JSON, in one folder per run and key; earlier runs stay. Gives the run's name.

    The name defaults to the present time, so that names sort by age. A run that is written twice fails.
    """
    run = run or datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f")
    for name, table in (("trades", trades), ("equity", equity), ("results", results)):
        out = table.write.mode("errorifexists").partitionBy(*keys).option("header", True)
        (out.json if name == "results" else out.csv)(f"{path}/{name}/run={run}")
    return run


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_ledger(trades: DataFrame, signals: DataFrame, portfolio: DataFrame, stats: DataFrame, path: str) -> None:
    for name, table in (("trades", trades), ("signals", signals), ("portfolio", portfolio), ("performance", stats)):
        table.write.mode("overwrite").json(f"{path}/{name}")
