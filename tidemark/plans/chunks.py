"""Ordered work on keyed series without ever holding one whole series in one task.

A plain ``Window.partitionBy("symbol")`` sends every row of a symbol to one task. When one symbol
holds a third of the table that task never ends, so ordered operators here partition by
``(keys, chunk)`` instead, where a chunk is a run of consecutive rows of bounded length:

1. rows are counted per ``(keys, bucket)`` with a bucket of fixed width on the order column. The
   count is an ordinary partial aggregate and reads two or three columns only;
2. prefix sums over that small table give each bucket its first row position, and buckets are
   packed into chunks of about ``rows_per_chunk`` rows;
3. rows look up their chunk with an equi join. A bucket that lies within ``before`` rows of a later
   chunk (or ``after`` rows of an earlier one) is sent to that chunk too, as a halo, so frames and
   lags are exact at the seams. Halo rows are dropped at the end.

A bucket with more than a sixteenth of a chunk is cut again by the next level of ``Series.levels``,
which also keeps halos small. Series with many small keys start from one very wide bucket, so that
the bucket table has one row per ordinary key.
Running values (sums, maxima, forward fill) need no halo: the bucket table carries the aggregate of
all earlier buckets and each chunk adds it to its own local window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.scans import scan
from tidemark.session import stage

DAY = 86_400.0
_INTERNAL = ("_chunk", "_own", "_base", "_total")
_CLAMP = 9.0e15


@dataclass(frozen=True)
class Level:
    """One bucketing step: ``column`` (timestamp or numeric) cut into steps of ``width``.

    Width is in seconds for timestamps and in units of the column otherwise.
    """

    column: str
    width: float


@dataclass(frozen=True)
class Series:
    """How rows form series: group keys, total order, and how to cut the order into buckets.

    ``order`` lists the ordering columns; together with the keys they should be unique. A leading
    ``-`` sorts a numeric column downwards. ``levels`` defaults to buckets of the first order column of a day
    each; a bucket with too many rows is cut into hours, minutes and seconds. Tables that
    hold more rows than a chunk in one second of one key name a level of a tie-breaking column.
    """

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    levels: tuple[Level, ...] = field(default=())
    rows_per_chunk: int = 500_000

    def cuts(self) -> tuple[Level, ...]:
        return self.levels or tuple(Level(self.order[0], w) for w in (DAY, 3_600.0, 60.0, 1.0))

    def order_by(self) -> list[Column]:
        return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in self.order]


def _bucket(df: DataFrame, level: Level) -> Column:
    name = level.column.lstrip("-")
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = F.unix_micros(F.col(name).cast("timestamp")) / F.lit(level.width * 1e6)
    else:
        value = F.col(name).cast("double") / F.lit(level.width)
    if level.column.startswith("-"):
        value = -value
    return F.floor(F.greatest(F.least(value, F.lit(_CLAMP)), F.lit(-_CLAMP)))


def same_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    cond = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond


def _bucket_table(df: DataFrame, s: Series, aggs: list[Column]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows with their bucket columns, one row per (keys, bucket) with ``_n`` and ``aggs``, and the bucket names.

    The counts are staged. Their size is then known when the rows look up their chunk, so a small
    table is broadcast and the rows are shuffled once, by (keys, chunk). Finer levels read the rows
    of over-full buckets only, and usually there are none.
    """
    cuts, keys = s.cuts(), list(s.keys)
    aggs = [F.count(F.lit(1)).alias("_n"), *aggs]
    names = ["_b0"]
    rows = df.withColumn("_b0", _bucket(df, cuts[0]))
    table = stage(rows.groupBy(*keys, *names).agg(*aggs), "buckets")
    if len(cuts) == 1:
        return rows, table, names
    limit, done = max(1, s.rows_per_chunk // 16), []
    for i, level in enumerate(cuts[1:], start=1):
        hot = table.filter(F.col("_n") > limit)
        if hot.isEmpty():
            break
        group = [*keys, *names]
        hot = hot.select(*[F.col(c).alias(f"_h{j}") for j, c in enumerate(group)], F.lit(True).alias("_hot"))
        joined = rows.join(hot, same_keys(rows, hot, [(c, f"_h{j}") for j, c in enumerate(group)]), "left")
        rows = joined.select(*[rows[c] for c in rows.columns], F.when(F.col("_hot"), _bucket(df, level)).alias(f"_b{i}"), "_hot")
        done.append(table.filter(F.col("_n") <= limit))
        names.append(f"_b{i}")
        table = stage(rows.filter("_hot").groupBy(*keys, *names).agg(*aggs), "buckets")
        rows = rows.drop("_hot")
    for part in done:
        table = table.unionByName(part, allowMissingColumns=True)
    return rows, table, names


# How a bucket aggregate continues over the earlier buckets of the key.
_PREFIX: dict[str, Callable[[str, "Window"], Column]] = {
    "sum": lambda c, w: F.sum(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "last": lambda c, w: F.last(c, ignorenulls=True).over(w),
}


def _bucket_aggregate(how: str, value: Column, s: Series) -> Column:
    if how == "last":
        at = F.struct(*[-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in s.order])
        return F.max_by(value, F.when(value.isNotNull(), at))
    return {"sum": F.sum, "max": F.max, "min": F.min}[how](value)


def chunk_map(
    m: DataFrame, buckets: list[str], s: Series, before: int, after: int, carry: dict[str, tuple[str, Column]]
) -> DataFrame:
    """One row per (keys, bucket, chunk that needs the bucket), from the bucket table ``m``."""
    keys = list(s.keys)
    per_key = Window.partitionBy(*keys)
    in_order = per_key.orderBy(*buckets)
    prior = in_order.rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumns(
        {
            "_start": F.coalesce(F.sum("_n").over(prior), F.lit(0)),
            "_total": F.sum("_n").over(per_key),
            **{f"_p_{n}": _PREFIX[how](f"_a_{n}", prior) for n, (how, _) in carry.items()},
        }
    )
    m = m.withColumn("_raw", F.floor(F.col("_start") / F.lit(s.rows_per_chunk)))
    m = m.withColumn("_home", F.dense_rank().over(per_key.orderBy("_raw")) - 1)
    low, high = F.col("_home"), F.col("_home")
    if after:
        reach = per_key.orderBy("_start").rangeBetween(Window.unboundedPreceding, -after)
        low = F.coalesce(F.last("_home").over(reach), F.lit(0))
    if before:
        m = m.withColumn("_back", -(F.col("_start") + F.col("_n")))
        reach = per_key.orderBy("_back").rangeBetween(Window.unboundedPreceding, -before)
        high = F.coalesce(F.last("_home").over(reach), F.max("_home").over(per_key))
    if before or after:
        m = m.withColumns({"_low": low, "_high": high})
        m = m.withColumn("_chunk", F.explode(F.sequence("_low", "_high")))
    else:
        m = m.withColumn("_chunk", F.col("_home"))
    in_chunk = Window.partitionBy(*keys, "_chunk")
    first = in_chunk.orderBy(*buckets)
    return m.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, *buckets])],
        F.col("_chunk").cast("int").alias("_chunk"),
        (F.col("_chunk") == F.col("_home")).alias("_own"),
        F.min("_start").over(in_chunk).alias("_base"),
        F.col("_total"),
        *[F.first(f"_p_{n}").over(first).alias(f"_c_{n}") for n in carry],
    )


_LOCAL = {
    "sum": lambda v, w: F.sum(v).over(w),
    "max": lambda v, w: F.max(v).over(w),
    "min": lambda v, w: F.min(v).over(w),
    "last": lambda v, w: F.last(v, ignorenulls=True).over(w),
}


class Chunks:
    """Rows of ``df`` laid out in chunks; see the module text.

    ``window`` partitions by keys and chunk, so any window function applied through it is a
    per-series window function. Call :meth:`close` on the final frame.
    """

    def __init__(
        self,
        df: DataFrame,
        series: Series,
        before: int = 0,
        after: int = 0,
        carry: dict[str, tuple[str, Column]] | None = None,
    ):
        self.series = series
        self.carry = carry or {}
        self.carried = [f"_c_{n}" for n in self.carry]
        sums = [_bucket_aggregate(how, value, series).alias(f"_a_{n}") for n, (how, value) in self.carry.items()]
        rows, table, buckets = _bucket_table(df, series, sums)
        m = self.map = chunk_map(table, buckets, series, before, after, self.carry)
        on = same_keys(rows, m, [(c, f"_k{i}") for i, c in enumerate([*series.keys, *buckets])])
        self.df = rows.join(m, on).select(
            *[rows[c] for c in df.columns], *[m[c] for c in (*_INTERNAL, *self.carried)]
        )

    @property
    def window(self):
        return Window.partitionBy(*self.series.keys, "_chunk").orderBy(*self.series.order_by())

    def last(self, n: int):
        """The current row and the n-1 rows before it."""
        return self.window.rowsBetween(-(n - 1), 0)

    def next(self, n: int):
        """The n rows after the current one."""
        return self.window.rowsBetween(1, n)

    @property
    def so_far(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def position(self) -> Column:
        """Zero-based row position within the whole series."""
        return F.col("_base") + F.row_number().over(self.window) - 1

    def single(self) -> bool:
        """Whether every series fits one chunk; asks the small bucket table."""
        return not self.map.agg(F.max("_chunk")).first()[0]

    @property
    def total(self) -> Column:
        """Row count of the whole series."""
        return F.col("_total")

    def running(self, exclusive: bool = False) -> dict[str, Column]:
        """The carried values continued through the rows of the chunk."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        out = {}
        for n, (how, value) in self.carry.items():
            local, earlier = _LOCAL[how](value, frame), F.col(f"_c_{n}")
            if how == "sum":
                out[n] = F.coalesce(local + earlier, local, earlier)
            elif how == "last":
                out[n] = F.coalesce(local, earlier)
            else:
                wins = (local > earlier) if how == "max" else (local < earlier)
                out[n] = F.when(local.isNull(), earlier).when(earlier.isNull() | wins, local).otherwise(earlier)
        return out

    def close(self, df: DataFrame) -> DataFrame:
        return df.filter("_own").drop(*_INTERNAL, *self.carried)


def over_chunks(
    df: DataFrame, series: Series, columns: Callable[[Chunks], dict[str, Column]], before: int = 0, after: int = 0
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead."""
    c = Chunks(df, series, before, after)
    return c.close(c.df.withColumns(columns(c)))


def number_rows(df: DataFrame, series: Series, pos: str = "pos", total: str | None = "n") -> DataFrame:
    """Zero-based position of each row in its series and, optionally, the series length."""
    c = Chunks(df, series)
    cols = {pos: c.position}
    if total:
        cols[total] = c.total
    return c.close(c.df.withColumns(cols))


def running(
    df: DataFrame, series: Series, values: dict[str, tuple[str, Column]], exclusive: bool = False
) -> DataFrame:
    """Running sum, max, min or last non-null value from the start of each series.

    ``values`` maps an output column to ``(how, expression over the row)``. With ``exclusive`` the
    current row is left out.
    """
    c = Chunks(df, series, carry=values)
    return c.close(c.df.withColumns(c.running(exclusive)))


def affine_scan(
    df: DataFrame,
    series: Series,
    factor: Column,
    addend: Column,
    out: str,
    carry: dict[str, tuple[str, Column]] | None = None,
    derive: dict[str, Column] | None = None,
) -> DataFrame:
    """Solve ``y[t] = factor[t] * y[t-1] + addend[t]`` with ``y[-1] = 0`` along each series.

    ``carry`` adds running values (as in :func:`running`) and ``derive`` columns computed from them;
    both may be used by ``factor`` and ``addend`` and are part of the result.

    Each chunk is solved for an unknown start value (its result is ``A*y0 + B``), the few chunk
    ends of a series are composed, and the start value is put into the rows.
    """
    keys = list(series.keys)
    c = Chunks(df, series, carry=carry)
    local = c.df.withColumns(c.running()).drop(*c.carried, "_own") if carry else c.df.drop("_own")
    local = local.withColumns(derive) if derive else local
    keep = [x for x in local.columns if x not in _INTERNAL]
    local = local.withColumn("_pos", F.col("_base") + F.row_number().over(c.window) - 1).drop("_total")
    # The window has sorted the rows by (keys, chunk, order); the sort is there in name only.
    local = local.sortWithinPartitions(*keys, "_chunk", *series.order_by())
    solved = scan(local, F.col("_pos") == F.col("_base"), {"y": (factor, addend)}).withColumnsRenamed({"_A_y": "_A", "_B_y": "_B"})
    if c.single():
        return solved.select(*keep, F.col("_B").alias(out))
    solved = stage(solved, "scan")
    ends = solved.groupBy(*keys, "_chunk").agg(F.max_by(F.struct("_A", "_B"), "_pos").alias("_e"))
    # Only the chunk ends of one series meet here: rows / rows_per_chunk small rows.
    start_schema = T.StructType(
        [solved.schema[k] for k in keys] + [T.StructField("_kc", T.IntegerType()), T.StructField("_y0", T.DoubleType())]
    )

    def start_values(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        y, starts = 0.0, []
        for a, b in zip(pdf["_A"].tolist(), pdf["_B"].tolist()):
            starts.append(y)
            y = a * y + b
        return pdf[keys].assign(_kc=pdf["_chunk"], _y0=starts)

    # Series of one chunk start from zero and need no composition.
    long = ends.select(*keys, "_chunk", "_e._A", "_e._B", F.max("_chunk").over(Window.partitionBy(*keys)).alias("_last"))
    starts = long.filter(F.col("_last") > 0).drop("_last").groupBy(*keys).applyInPandas(start_values, start_schema)
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_kc", "_y0")
    on = same_keys(solved, starts, [(k, f"_k{i}") for i, k in enumerate(keys)] + [("_chunk", "_kc")])
    return solved.join(starts, on, "left").select(
        *[solved[x] for x in keep], (F.col("_A") * F.coalesce("_y0", F.lit(0.0)) + F.col("_B")).alias(out)
    )


def fold(
    df: DataFrame,
    series: Series,
    step: Callable[[pd.DataFrame, list[float]], tuple[pd.DataFrame, list[float]]],
    added: str,
) -> DataFrame:
    """Run an ordered state machine along each series, chunk by chunk.

    ``step(rows of one chunk in order, state at its start)`` returns the rows to keep with the
    ``added`` columns and the state at the end; the state is a short list of doubles and starts
    empty. All chunks run in parallel from a guessed start state. A chunk whose true start state
    differs from the guess runs again, until nothing changes: the first chunk is always right, so
    the result is exact, and machines that forget their past (time-outs, rate limits) need one or
    two extra rounds only.
    """
    keys = list(series.keys)
    c = Chunks(df, series)
    laid = c.df.drop("_own", "_base", "_total")
    laid = stage(laid, "fold")
    order = [x.lstrip("-") for x in series.order]
    rising = [not x.startswith("-") for x in series.order]
    key_fields = [laid.schema[k] for k in keys] + [laid.schema["_chunk"]]
    state_schema = T.StructType([*key_fields, T.StructField("_state", T.ArrayType(T.DoubleType()))])
    row_schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])
    group = [*keys, "_chunk"]

    def start_of(states: pd.DataFrame) -> list[float]:
        return list(states["_state"].iloc[0]) if len(states) and states["_state"].iloc[0] is not None else []

    def end_state(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=[*group, "_state"])
        _, end = step(rows.sort_values(order, ascending=rising), start_of(states))
        one = rows[group].head(1).copy()
        one["_state"] = [[float(x) for x in end]]
        return one

    def final_rows(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=row_schema.names)
        out, _ = step(rows.sort_values(order, ascending=rising), start_of(states))
        return out[row_schema.names]

    def run(rows: DataFrame, starts: DataFrame, fn, schema) -> DataFrame:
        return rows.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(fn, schema)

    spark = df.sparkSession
    none = spark.createDataFrame([], state_schema)
    if laid.agg(F.max("_chunk")).first()[0] in (None, 0):
        return run(laid, none, final_rows, row_schema)

    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    ends = stage(run(laid, none, end_state, state_schema), "fold-state")
    used = ends.select(*group, F.array().cast("array<double>").alias("_used"))
    while True:
        starts = ends.withColumn("_state", F.coalesce(F.lag("_state").over(by_chunk), F.array().cast("array<double>")))
        starts = stage(starts, "fold-state")
        changed = starts.join(used, group).filter(F.col("_state") != F.col("_used")).select(*group, "_state")
        changed = stage(changed, "fold-state")
        if changed.isEmpty():
            return run(laid, starts, final_rows, row_schema)
        again = run(laid.join(changed.select(*group), group, "left_semi"), changed, end_state, state_schema)
        ends = stage(ends.join(changed.select(*group), group, "left_anti").unionByName(again), "fold-state")
        used = starts.withColumnRenamed("_state", "_used")
