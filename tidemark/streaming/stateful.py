"""Per-key history of a stream in Spark's state store (``transformWithStateInPandas`` over RocksDB).

Spark keeps the state with the query's checkpoint: it is versioned by epoch, moved to other executors and replayed with the
epoch after a failure. Time-to-live drops the state of keys that have gone silent. A trigger's rows of one key pass through one
task; sources bound how much a trigger reads. With a time-to-live a query asks for batches without data for as long as it runs: one
that should end when its input is worked off (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled=false``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State variables need the RocksDB store; streams that start afterwards use it."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _mode(ttl_s: float | None) -> tuple[str, int | None]:
    return ("None", None) if ttl_s is None else ("ProcessingTime", int(ttl_s * 1000))


class _Newest(StatefulProcessor):
    """Rows newer than the newest one that earlier triggers had of their key; one row for each time."""

    def __init__(self, ts: str, names: list[str], ttl: int | None):
        self.ts, self.names, self.ttl = ts, names, ttl

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", "us long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get()
        before = held[0] if held else None
        top, seen = before, set()
        for pdf in rows:
            us = _micros(pdf[self.ts])
            fresh = us.notna() & (True if before is None else us > before) & ~us.duplicated() & ~us.isin(seen)
            seen |= set(us[fresh])
            if fresh.any():
                top = max(x for x in (top, int(us[fresh].max())) if x is not None)
                yield pdf.loc[fresh, self.names]
        if top is not None and top != before:
            self.newest.update((top,))

    def close(self) -> None:
        pass


class _Ring(StatefulProcessor):
    """The newest ``size`` rows of a key, sent again whenever they change, with their rank."""

    def __init__(self, ts: str, schema: T.StructType, size: int, ttl: int | None):
        self.ts, self.schema, self.size, self.ttl = ts, schema, size, ttl

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.schema, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=self.schema.names)
        newest = None if old.empty else _micros(old[self.ts]).max()
        kept = old
        for pdf in rows:  # never more than a batch beside the ring
            us = _micros(pdf[self.ts])
            fresh = pdf.loc[us.notna() & (True if newest is None else us > newest), self.schema.names]
            if len(fresh):
                both = fresh if kept.empty else pd.concat([kept, fresh])
                kept = both.drop_duplicates(self.ts).sort_values(self.ts).tail(self.size)
        if kept is not old and len(kept):
            self.rows.put([tuple(None if pd.isna(x) else x for x in r) for r in kept.itertuples(index=False)])
            yield kept.assign(rank=range(len(kept), 0, -1))

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> pd.Series:
    """Microseconds since the epoch, missing where the time is."""
    at = pd.to_datetime(ts, utc=True)
    return ((at - pd.Timestamp(0, tz="UTC")) // pd.Timedelta(microseconds=1)).astype("Int64")


def drop_late(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", ttl_s: float | None = None) -> DataFrame:
    """A stream without the rows that are not newer than what earlier triggers had of their key, and without repeated times.

    State is one number for each key. Rows without a time are dropped.
    """
    use_rocksdb(df.sparkSession)
    mode, ttl = _mode(ttl_s)
    return df.groupBy(*keys).transformWithStateInPandas(_Newest(ts, df.columns, ttl), df.schema, "Append", mode)


def latest_rows(df: DataFrame, size: int, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", ttl_s: float | None = None) -> DataFrame:
    """For every key that a trigger has news of its newest ``size`` rows, with ``rank`` (1 is the newest); for update mode.

    State is ``size`` rows for each key.
    """
    use_rocksdb(df.sparkSession)
    mode, ttl = _mode(ttl_s)
    out = T.StructType([*df.schema.fields, T.StructField("rank", T.IntegerType())])
    return df.groupBy(*keys).transformWithStateInPandas(_Ring(ts, df.schema, size, ttl), out, "Update", mode)


class _Context(StatefulProcessor):
    """New rows of a key, behind them the rows and averages that their features read."""

    def __init__(self, ts: str, schema: T.StructType, size: int, spans: tuple[int, ...], value: str, ttl: int | None):
        self.ts, self.schema, self.size, self.spans, self.value, self.ttl = ts, schema, size, spans, value, ttl

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.schema, self.ttl)
        averages = T.StructType([T.StructField(f"_h{n}", T.DoubleType()) for n in self.spans])
        self.past = handle.getValueState("past", T.StructType([T.StructField("seen", T.LongType()), T.StructField("since", T.LongType()), *averages.fields]), self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        old = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=self.schema.names)
        held = self.past.get()
        seen, since, averages = (held[0], held[1], list(held[2:])) if held else (0, None, [None] * len(self.spans))
        new = pd.concat(list(rows))[self.schema.names]
        us = _micros(new[self.ts])
        fresh = us.notna() & (True if old.empty else us > _micros(old[self.ts]).max())
        new = new[fresh].drop_duplicates(self.ts).sort_values(self.ts)
        if new.empty:
            return
        start = dict(zip((f"_h{n}" for n in self.spans), averages))
        both = new if old.empty else pd.concat([old, new])
        count = np.arange(len(both)) - len(old) + seen + 1
        yield both.assign(seen=count, _new=[False] * len(old) + [True] * len(new), _since=pd.array([since] * len(both), "Int64"), **{k: pd.array([v] * len(both), "Float64") for k, v in start.items()})
        x = pd.to_numeric(new[self.value], errors="coerce").to_numpy(float, na_value=np.nan)
        at = np.flatnonzero(np.isfinite(x))
        if len(at):
            gaps = np.diff(at, prepend=at[0] if since is None else -since)
            for k, n in enumerate(self.spans):
                a = 2.0 / (n + 1)
                share = a / ((1.0 - a) ** gaps + a)
                if since is None:
                    share[0] = 1.0
                # Weight of each value at the end: its share, times what the later ones leave of it.
                left = np.concatenate([np.cumprod((1.0 - share)[::-1])[::-1][1:], [1.0]])
                before = 0.0 if since is None else averages[k] * float(left[0] * (1.0 - share[0]))
                averages[k] = before + float(np.sum(left * share * x[at]))
            since = len(new) - int(at[-1])
        elif since is not None:
            since += len(new)
        self.past.update((int(seen + len(new)), since, *averages))
        self.rows.put([tuple(None if pd.isna(v) else v for v in r) for r in both.tail(self.size).itertuples(index=False)])

    def close(self) -> None:
        pass


def with_context(df: DataFrame, size: int, spans: tuple[int, ...], value: str = "close", keys: tuple[str, ...] = ("symbol",), ts: str = "ts", ttl_s: float | None = None) -> DataFrame:
    """New rows of a stream (``_new``) with the ``size`` rows of their key before them, for update mode.

    ``seen`` numbers the rows of a key; ``_since`` and ``_h<span>`` are its exponential averages before the new rows and how many
    rows before them its last value stands. State is ``size`` rows and these numbers for each key; ``ttl_s`` drops silent keys.
    """
    use_rocksdb(df.sparkSession)
    mode, ttl = _mode(ttl_s)
    more = [T.StructField("seen", T.LongType()), T.StructField("_new", T.BooleanType()), T.StructField("_since", T.LongType()), *(T.StructField(f"_h{n}", T.DoubleType()) for n in spans)]
    return df.groupBy(*keys).transformWithStateInPandas(_Context(ts, df.schema, size, spans, value, ttl), T.StructType([*df.schema.fields, *more]), "Update", mode)
