"""Helpers shared by the operators: reading tables, Arrow batches of whole texts, folds and samples."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

#: Bytes of text that one step inside a Python worker handles; a longer text is a step of its own.
STEP_BYTES = 16 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(df: DataFrame) -> DataFrame:
    """The rows, whose workers find this package where the driver has found it (elsewhere it comes with --py-files)."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return df


def map_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    return shipped(df).mapInArrow(fn, schema)


def group_arrow(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each group's rows; for groups of bounded size only."""
    return shipped(df).groupBy(key).applyInArrow(fn, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def steps(texts: list[bytes] | list[str], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts stay near ``limit`` bytes (or characters) together."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def first_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of the key: the same ones whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(rows)


def ranges(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices ``starts[k] ... starts[k] + lengths[k] - 1`` of all k, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)
