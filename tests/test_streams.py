"""Streams: slices of any time, late rows, repeated epochs."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.registry.sources import scratch
from tidemark.registry.streams import Feed
from tests.test_operators import make_bars, rows
from tidemark.operators.windows import LOOKBACK, feature_matrix
from tidemark.plans.chunks import Series
from tidemark.schemas import BARS
from tidemark.streaming import feeds
from tidemark.streaming.features import FeatureStream
from tidemark.streaming.state import EpochTable
from tidemark.streaming.stateful import _Context, drop_late, latest_rows

SCHEMA = "symbol string, ts timestamp, x int"


def at(day):
    return dt.datetime(1999, 5, 1) + dt.timedelta(days=day)


def test_feed_keeps_rows_of_any_time(spark):
    rows = [("a", at(d), d) for d in range(0, 4000, 50)] + [("b", None, -1)]
    out = EpochTable(spark, scratch(spark, "all"), spark.createDataFrame([], SCHEMA).schema)
    Feed(spark, spark.createDataFrame(rows, SCHEMA), "any", order=(2, 0, 3, 1)).batches(out.write)
    assert sorted(r.x for r in out.all(spark).collect()) == sorted(x for _, _, x in rows)


def fed(spark, df, through, name, slices, mode="update", restart=()):
    """Rows of a query that gets the slices one after the other; a new query goes on from the checkpoint each time. Slices in ``restart`` fail once in the sink first."""
    path, checkpoint, got, failed = scratch(spark, name), scratch(spark, "stream"), {}, set()
    df.limit(0).write.parquet(path)

    def each(batch, epoch):
        got[epoch] = batch.collect()
        if epoch in restart and epoch not in failed:
            failed.add(epoch)
            raise RuntimeError("lost")

    for rows in slices:
        rows.write.mode("append").parquet(path)
        for _ in range(2):
            query = feeds.run_batches(through(spark.readStream.schema(df.schema).parquet(path)), checkpoint, each, mode)
            try:
                query.awaitTermination()
                break
            except Exception:
                assert failed
    return got


LATE = [[("a", 5, 1), ("b", 1, 2)], [("a", 4, 3), ("a", 6, 4), ("b", 2, 5), ("b", 2, 5), ("c", 0, 6), ("c", None, 7)], [("a", 6, 7), ("c", 1, 8), ("a", 8, 9), ("a", 7, 10)]]


def slices_of(spark):
    return [spark.createDataFrame([(s, None if d is None else at(d), x) for s, d, x in rows], SCHEMA) for rows in LATE]


def test_late_rows_are_told_by_state_that_survives_restarts(spark):
    parts = slices_of(spark)
    got = fed(spark, parts[0], drop_late, "late", parts, "append", restart=(1,))
    assert sorted(r.x for rows in got.values() for r in rows) == [1, 2, 4, 5, 6, 8, 9, 10]


def test_ring_of_latest_rows(spark):
    parts = slices_of(spark)
    got = fed(spark, parts[0], lambda d: latest_rows(d, 2), "ring", parts, restart=(2,))
    last = {}
    for epoch in sorted(got):
        for r in got[epoch]:
            last[r.symbol, r["rank"]] = r.x
    assert last == {("a", 1): 9, ("a", 2): 10, ("b", 1): 5, ("b", 2): 2, ("c", 1): 8, ("c", 2): 6}


def test_silent_keys_expire(spark):
    """With a time to live of nothing, a late row of the next trigger counts as new again."""
    parts = slices_of(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        got = fed(spark, parts[0], lambda d: drop_late(d, ttl_s=0.001), "ttl", parts, "append")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(r.x for rows in got.values() for r in rows) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


class Held:
    """A state variable of one key."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update


class Handle:
    def getListState(self, name, schema, ttl=None):
        return Held()

    getValueState = getListState


def test_context_of_new_rows():
    """The averages that go with each slice are those of all rows before it, whatever is missing and however rows are cut into batches."""
    spans, n = (1, 5, 50), 400
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"), **{c: rng.normal(100, 5, n) for c in ("open", "high", "low", "close", "volume")}})
    p.loc[:4, "close"] = np.nan
    p.loc[60:250, "close"] = np.nan
    p.loc[300, "close"] = np.inf
    finite_close = p["close"].replace([np.inf], np.nan)
    want = {k: finite_close.ewm(span=k, adjust=False).mean() for k in spans}
    each = _Context("ts", BARS, LOOKBACK, spans, "close", None)
    each.init(Handle())
    for low, high in zip([0, 3, 40, 100, 101, 230, 299, 301], [3, 40, 100, 101, 230, 299, 301, n]):
        part = p.iloc[low:high].sample(frac=1, random_state=low)
        late = p.iloc[max(0, low - 5) : low]  # rows that were there before
        out = pd.concat(list(each.handleInputRows(("a",), iter([part.iloc[:2], part.iloc[2:], late]), None)))
        new = out[out["_new"]]
        assert list(new["ts"]) == list(p["ts"].iloc[low:high]) and list(new["seen"]) == list(range(low + 1, high + 1))
        assert len(out) - len(new) == min(low, LOOKBACK)
        held = finite_close.iloc[:low].last_valid_index()
        assert (pd.isna(out["_since"]).all() and held is None) or set(out["_since"]) == {low - held}
        for k in spans:
            if held is not None:
                np.testing.assert_allclose(float(out[f"_h{k}"].iloc[0]), want[k].iloc[low - 1], rtol=1e-10)
    assert not list(each.handleInputRows(("a",), iter([p.iloc[:9]]), None))


def test_features_after_a_long_outage_equal_the_batch(spark):
    """An outage of several epochs and of more rows than the stream keeps; one epoch is repeated, one symbol comes late."""
    p = make_bars({"a": 420, "b": 120})
    a = p.index[p.symbol == "a"]
    p.loc[a[110:330], "close"] = np.nan
    p.loc[p.symbol == "b", "ts"] = p.loc[p.symbol == "b", "ts"] + pd.Timedelta(hours=250)
    df = spark.createDataFrame(p).withColumn("close", F.when(~F.isnan("close"), F.col("close"))).select(*BARS.names)
    each = FeatureStream(spark, scratch(spark, "outage"), Series())
    start, cuts = p["ts"].min(), [0, 150, 310, 500]
    at_hour = lambda h: F.lit(start + pd.Timedelta(hours=h))
    parts = [df.filter((F.col("ts") >= at_hour(low)) & (F.col("ts") < at_hour(high))) for low, high in zip(cuts, cuts[1:])]
    path, checkpoint, failed = scratch(spark, "bars"), scratch(spark, "stream"), []
    df.limit(0).write.parquet(path)

    def handler(batch, epoch):
        each(batch, epoch)
        if epoch == 1 and not failed:
            failed.append(epoch)
            raise RuntimeError("lost")

    for rows_of in parts:
        rows_of.write.mode("append").parquet(path)
        for _ in range(2):
            try:
                feeds.run_batches(each.through(spark.readStream.schema(df.schema).parquet(path)), checkpoint, handler, "update").awaitTermination()
                break
            except Exception:
                assert failed
    got, want = rows(each.read(spark)), rows(feature_matrix(df, Series()))
    assert len(got) == len(want) and LOOKBACK < 220 and got["ema_50"].notna().all()
    for col in [c for c in want.columns if c not in ("symbol", "ts")]:
        np.testing.assert_allclose(got[col].astype(float), want[col].astype(float), rtol=1e-9, atol=1e-12, err_msg=col)
