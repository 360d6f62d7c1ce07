"""Rolling, exponential and sequence features over bar series."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import high_low_ratio, open_close_ratio, ratio
from tidemark.plans.chunks import Chunks, Series, over_chunks
from tidemark.plans.scans import scan
from tidemark.session import stage

Columns = dict[str, Column]


def finite(col: Column | str) -> Column:
    """The value, null where it is infinite or not a number; windows treat such values as missing."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def full(expr: Column, value: Column | str, frame, n: int) -> Column:
    """``expr`` once the frame holds ``n`` non-null values, null before."""
    return F.when(F.count(value).over(frame) == n, expr)


def change(col: str, n: int, c: Chunks) -> Column:
    return ratio(col, F.lag(col, n).over(c.window)) - 1


def returns(c: Chunks, periods=(1, 5, 15, 60)) -> Columns:
    return {f"ret_{n}m": change("close", n, c) for n in periods}


def bar_terms(c: Chunks) -> Columns:
    """Per-row inputs of the rolling features."""
    prev = F.lag("close").over(c.window)
    return {
        "returns": ratio("close", prev) - 1,
        "_delta": F.coalesce(F.nanvl(F.col("close") - prev, F.lit(0.0)), F.lit(0.0)),
        "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3,
        "_place": F.try_divide(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))),
    }


class Rolling:
    """Rolling sums and counts of several sizes over several terms.

    Every size is one sliding frame that all terms share, so a row costs the sum of the sizes in
    updates. Nothing outside a frame enters its sum: a spike, an infinity or the place of a chunk's
    seam leaves no trace in later windows. Infinite and undefined terms count as missing.
    """

    def __init__(self, c: Chunks, terms: Columns, sizes: dict[str, tuple[int, ...]]):
        self.c, self.terms, self.sizes = c, terms, sizes

    def add(self, df: DataFrame) -> DataFrame:
        df = df.withColumns({f"_t_{k}": finite(v.cast("double")) for k, v in self.terms.items()})
        cols: Columns = {}
        for k in self.terms:
            for n in self.sizes[k]:
                w = self.c.last(n)
                cols[f"_s{n}_{k}"] = F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0.0))
                cols[f"_n{n}_{k}"] = F.count(f"_t_{k}").over(w)
        return df.withColumns(cols)  # columns that nothing reads are pruned with their windows

    def sum(self, term: str, n: int) -> Column:
        return F.col(f"_s{n}_{term}")

    def count(self, term: str, n: int) -> Column:
        return F.col(f"_n{n}_{term}")

    def mean(self, term: str, n: int) -> Column:
        """Mean of the values there are, null without any."""
        return F.try_divide(self.sum(term, n), self.count(term, n))

    def full_sum(self, term: str, n: int) -> Column:
        """The sum once there are n values, null before."""
        return F.when(self.count(term, n) == n, self.sum(term, n))

    def full_mean(self, term: str, n: int) -> Column:
        return self.full_sum(term, n) / n

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"_t_{k}" for k in self.terms], *[f"_{x}{n}_{k}" for k in self.terms for n in self.sizes[k] for x in "sn"])


RSI_SIZES, SIZES = (7, 14, 21), (5, 10, 20)


def bar_rolling(c: Chunks, ret: str = "returns") -> Rolling:
    """The terms of the bar features; needs the columns of :func:`bar_terms`."""
    d, v = F.col("_delta"), F.col("volume")
    terms = {
        "gain": F.when(d > 0, d).otherwise(F.lit(0.0)),
        "loss": F.when(d < 0, -d).otherwise(F.lit(0.0)),
        "tpv": F.col("_tp") * v,
        "v": v,
        "ret": F.col(ret),
        "retv": F.col(ret) * v,
        "place": F.col("_place"),
    }
    return Rolling(c, terms, {k: RSI_SIZES if k in ("gain", "loss") else SIZES for k in terms})


def rsi(roll: Rolling, n: int) -> Column:
    """Relative strength from plain means; 100 without losses, null without any move."""
    gain, loss = roll.mean("gain", n), roll.mean("loss", n)
    return F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss))


def vwap(roll: Rolling, n: int) -> Column:
    return F.try_divide(roll.full_sum("tpv", n), roll.sum("v", n))


def volume_momentum(roll: Rolling, n: int) -> Column:
    return roll.full_sum("retv", n)


def intraday_strength(roll: Rolling, n: int) -> Column:
    return roll.full_mean("place", n)


def volume_mean(roll: Rolling, n: int = 20) -> Column:
    return roll.full_mean("v", n)


def volume_adjusted_return(roll: Rolling, n: int, ret: str = "returns") -> Column:
    return F.col(ret) * F.log1p(ratio("volume", roll.full_mean("v", n)))


def spread(c: Chunks, col: str, n: int, prefix: str) -> Columns:
    """Count, mean and sample deviation over the last n rows. Deviations keep the sliding frame: differences of
    running squares would lose a small deviation beside a large price."""
    w, x = c.last(n), finite(col)
    return {f"{prefix}n": F.count(x).over(w), f"{prefix}m": F.avg(x).over(w), f"{prefix}d": F.stddev_samp(x).over(w)}


def bollinger_of(prefix: str, n: int = 20, k: float = 2.0) -> Columns:
    """Bands from the columns of :func:`spread`."""
    whole = F.col(f"{prefix}n") == n
    mean, width = F.col(f"{prefix}m"), F.col(f"{prefix}d") * F.lit(k)
    lower = mean - width
    return {
        "bb_upper": F.when(whole, mean + width),
        "bb_lower": F.when(whole, lower),
        "bb_position": F.when(whole, F.try_divide(F.col("close") - lower, 2 * width)),
    }


def volatility(c: Chunks, n: int, ret: str = "returns") -> Column:
    w, x = c.last(n), finite(ret)
    return full(F.stddev_samp(x).over(w), x, w, n)


def volume_change(c: Chunks, periods=(5, 20)) -> Columns:
    return {f"volume_change_{n}": change("volume", n, c) for n in periods}


def momentum_1h(c: Chunks) -> Column:
    return ratio("close", F.lag("close", 59).over(c.window)) - 1


def rolling_slope(c: Chunks, col: str, n: int) -> Column:
    """Least-squares slope of ``col`` on the row position over the last ``n`` rows."""
    w = c.last(n)
    return full(F.regr_slope(F.col(col), F.col("_at")).over(w), col, w, n)


# --- exponential averages ----------------------------------------------------------------------


def _ema_terms(df: DataFrame, c: Chunks, col: str, spans: tuple[int, ...], new: str | None) -> DataFrame:
    """``_first``, the first finite value of the chunk's own rows so far, and the recurrence of each span from it on, as ``_A_<n>`` and ``_B_<n>``."""
    x, gap = F.col("_x"), F.col("_gap")
    earlier = c.window.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_x", F.when(F.col("_own") & (F.col(new) if new else F.lit(True)), finite(F.col(col).cast("double"))))
    df = df.withColumns(
        {"_gap": F.col("_pos") - F.last(F.when(x.isNotNull(), F.col("_pos")), ignorenulls=True).over(earlier), "_first": F.first("_x", ignorenulls=True).over(c.so_far)}
    )
    idle, maps = x.isNull() | gap.isNull(), {}
    for n in spans:
        a = 2.0 / (max(n, 1) + 1)
        share = F.lit(a) / (F.pow(F.lit(1.0 - a), gap) + a)
        maps[str(n)] = (F.when(idle, 1.0).otherwise(1.0 - share), F.when(idle, 0.0).otherwise(share * x))
    df = df.sortWithinPartitions(*c.series.keys, "_chunk", *c.series.order_by())  # as the windows have left them
    return scan(df, F.col("_pos") == F.col("_base"), maps).drop("_gap")


def _ema_starts(c: Chunks, col: str, spans: tuple[int, ...], new: str | None, history: DataFrame | None) -> DataFrame:
    """One row per (keys, chunk): for each span the average before the chunk, ``_y<n>``, and after its first finite value, ``_f<n>``.

    A narrow pass over the chunks; of each chunk only its first and last finite place, its first value and its recurrence meet here.
    """
    keys, order = list(c.series.keys), [o.lstrip("-") for o in c.series.order]
    narrow = c.df.select(*dict.fromkeys([*keys, *order, col, *([new] if new else [])]), "_chunk", "_own", "_base").withColumn("_pos", c.position)
    d = _ema_terms(narrow, c, col, spans, new).filter("_own")
    at = F.when(F.col("_x").isNotNull(), F.col("_pos"))
    ends = d.groupBy(*keys, "_chunk").agg(
        F.min(at).alias("_from"), F.max(at).alias("_to"), F.min_by("_x", at).alias("_v"), F.min(F.when(F.col(new), F.col("_pos")) if new else "_pos").alias("_begin"), *[F.max_by(f"_{p}_{n}", "_pos").alias(f"_{p}_{n}") for n in spans for p in "AB"]
    )
    fields = [T.StructField(f"_k{i}", d.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField("_kc", T.IntegerType())]
    schema = T.StructType([*fields, *(T.StructField(f"_{p}{n}", T.DoubleType()) for n in spans for p in "yf")])

    goes_on = history is not None
    if goes_on:
        ends = ends.join(history, keys, "left")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        y, seen, out = {n: None for n in spans}, None, []
        if goes_on and not pd.isna(pdf["_since"].iloc[0]):
            y, seen = {n: pdf[f"_h{n}"].iloc[0] for n in spans}, pdf["_begin"].min() - pdf["_since"].iloc[0]
        for row in pdf.to_dict("records"):
            start = {n: (y[n], None) for n in spans}
            if not pd.isna(row["_from"]):
                for n in spans:
                    a = 2.0 / (max(n, 1) + 1)
                    share = 1.0 if seen is None else a / ((1.0 - a) ** (row["_from"] - seen) + a)
                    first = row["_v"] if seen is None else (1.0 - share) * y[n] + share * row["_v"]
                    start[n] = (y[n], first)
                    y[n] = row[f"_A_{n}"] * first + row[f"_B_{n}"]
                seen = row["_to"]
            out.append([*(row[k] for k in keys), row["_chunk"], *(v for n in spans for v in start[n])])
        return pd.DataFrame(out, columns=schema.names)

    return stage(ends.groupBy(*keys).applyInPandas(compose, schema), "averages")


def add_ema(df: DataFrame, c: Chunks, col: str, spans: tuple[int, ...], name: Callable[[int], str], new: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """Exponential averages seeded with the first value; ``df`` must hold ``_pos``.

    Missing and infinite values carry the average on. The value after a gap of g rows weighs a, the
    average before it (1-a)^g, and the two are scaled to one: y = (1-k) y' + k x with k = a / (a + (1-a)^g).
    Each chunk is solved for an unknown average before it. Where a series has several chunks, a narrow pass composes
    the chunks of each series first, so that an outage of any length carries on across seams.

    A series may go on from ``history`` (keys, ``_h<span>``: its averages so far, ``_since``: how many rows before the first new row its
    last value stands): then only rows marked by the column ``new`` count.
    """
    d = _ema_terms(df, c, col, spans, new)
    after, before = {n: F.col("_first") for n in spans}, {n: F.lit(None).cast("double") for n in spans}
    if history is not None or not c.single():
        starts, keys = _ema_starts(c, col, spans, new, history), list(c.series.keys)
        on = F.col("_chunk") == F.col("_kc")
        for i, k in enumerate(keys):
            on = on & d[k].eqNullSafe(starts[f"_k{i}"])
        d = d.join(starts, on, "left").drop("_kc", *[f"_k{i}" for i in range(len(keys))])
        after, before = {n: F.coalesce(f"_f{n}", "_first") for n in spans}, {n: F.col(f"_y{n}") for n in spans}
    out = {name(n): F.when(F.col("_first").isNull(), before[n]).otherwise(F.col(f"_A_{n}") * after[n] + F.col(f"_B_{n}")) for n in spans}
    return d.withColumns(out).drop("_x", "_first", *[f"_{p}_{n}" for n in spans for p in "AB"], *[f"_{p}{n}" for n in spans for p in "yf"])


def ema(df: DataFrame, series: Series, col: str = "close", spans: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    """Add ``ema_<span>``: y[0] = x[0], y[t] = (1-a) y[t-1] + a x[t], a = 2 / (span + 1); for gaps see :func:`add_ema`."""
    c = Chunks(df, series)
    d = add_ema(c.df.withColumn("_pos", c.position), c, col, tuple(spans), lambda n: f"ema_{n}")
    return c.close(d).drop("_pos")


# --- the feature matrix ------------------------------------------------------------------------

FAMILIES = ("ret", "ema", "rsi", "imb")
DEFAULT_USE = ("ret_1m", "ema_5", "ema_20", "rsi_14", "imb_10")
EMA_SPANS = (5, 20, 50)
#: Rows before its own that a row's features read; averages carry their own past.
LOOKBACK = 60


def feature_matrix(df: DataFrame, series: Series, use: tuple[str, ...] = DEFAULT_USE, new: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """All features of the families named in ``use``, in one chunk layout; for ``new`` and ``history`` see :func:`add_ema`."""
    on = {f for f in FAMILIES if any(f in u for u in use)}
    c = Chunks(df, series, before=LOOKBACK)
    d = c.df.withColumns({"_pos": c.position, **bar_terms(c)})
    roll = bar_rolling(c)
    d = roll.add(d)
    d = d.withColumns(
        {
            **{f"_back{n}": F.lag("close", n).over(c.window) for n in (5, 15, 60)},
            **spread(c, "close", 20, "_c20"),
            **{f"_v{n}": F.stddev_samp(finite("returns")).over(c.last(n)) for n in (5, 20)},
        }
    )
    cols: Columns = {}
    if "ret" in on:
        cols["ret_1m"] = F.col("returns")
        cols |= {f"ret_{n}m": ratio("close", f"_back{n}") - 1 for n in (5, 15, 60)}
    if "rsi" in on:
        cols |= {f"rsi_{n}": rsi(roll, n) for n in (14, 7, 21)}
    if "imb" in on:
        for n in (5, 10, 20):
            cols |= {
                f"vwap_{n}": vwap(roll, n),
                f"price_vwap_ratio_{n}": ratio("close", vwap(roll, n)),
                f"volume_momentum_{n}": volume_momentum(roll, n),
                f"intraday_strength_{n}": intraday_strength(roll, n),
                f"vol_adj_returns_{n}": volume_adjusted_return(roll, n),
            }
    # Volume can be missing on its own, the count of returns tells whether a window is full.
    vol = {n: F.when(roll.count("ret", n) == n, F.col(f"_v{n}")) for n in (5, 20)}
    cols |= {
        **bollinger_of("_c20"),
        "volatility_5m": vol[5],
        "volatility_20m": vol[20],
        "volatility_ratio": F.try_divide(vol[5], vol[20]),
        "volume_sma_20": volume_mean(roll),
        "volume_ratio_20": ratio("volume", volume_mean(roll)),
        "high_low_ratio": high_low_ratio(),
        "open_close_ratio": open_close_ratio(),
    }
    d = roll.drop(d.withColumns(cols)).drop("_back5", "_back15", "_back60", "_c20n", "_c20m", "_c20d", "_v5", "_v20")
    if "ema" in on:
        d = add_ema(d, c, "close", EMA_SPANS, lambda n: f"ema_{n}", new, history)
        d = d.withColumns(
            {
                "price_ema5_ratio": ratio("close", "ema_5"),
                "price_ema20_ratio": ratio("close", "ema_20"),
                "ema5_ema20_ratio": ratio("ema_5", "ema_20"),
            }
        )
    return c.close(d).drop("_pos", "_delta", "_tp", "_place")


# --- sequences ---------------------------------------------------------------------------------


def sliding_sequences(
    df: DataFrame, series: Series, cols: list[str], length: int, stride: int = 1, target: str | None = None
) -> DataFrame:
    """Every window of ``length`` feature rows whose start is a multiple of ``stride``.

    One output row per window: keys, order columns and target of its last row, and the window as
    an array of rows.
    """
    c = Chunks(df, series, before=length - 1)
    d = c.df.withColumns({"_pos": c.position, "seq": F.collect_list(F.array(*cols)).over(c.last(length))})
    start = F.col("_pos") - (length - 1)
    d = c.close(d.filter((start >= 0) & (start % stride == 0)))
    order = [o.lstrip("-") for o in series.order]
    return d.select(*series.keys, *order, "seq", *([F.col(target).alias("target")] if target else []))


def padded_sequences(df: DataFrame, series: Series, cols: list[str], length: int, target: str) -> DataFrame:
    """As above with stride 1, but a series shorter than ``length`` gives one window padded with zero rows
    on the left. Windows without a target are dropped."""
    c = Chunks(df, series, before=length - 1)
    d = c.df.withColumns({"_pos": c.position, "seq": F.collect_list(F.array(*cols)).over(c.last(length))})
    whole = F.col("_pos") >= length - 1
    short = (F.col("_total") < length) & (F.col("_pos") == F.col("_total") - 1)
    zero = F.array(*[F.lit(0.0) for _ in cols])
    padded = F.concat(F.array_repeat(zero, F.lit(length) - F.size("seq")), F.col("seq"))
    d = c.close(d.filter((whole | short) & F.col(target).isNotNull()).withColumn("seq", padded))
    order = [o.lstrip("-") for o in series.order]
    return d.select(*series.keys, *order, "seq", F.col(target).alias("target"))
