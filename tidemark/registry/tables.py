"""Market views over the given tables, as DataFrames and as the same SQL.

Views that many queries read are staged once per session and folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bars import build_bars
from tidemark.plans.chunks import DAY, Level, Series, number_rows, over_chunks
from tidemark.session import stage

BAR_SERIES = Series()
TICK_SERIES = Series(order=("ts", "event_id"), levels=(Level("ts", DAY), Level("ts", 60.0)))
MODELS = ("m1", "m2", "m3")

_staged: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        _staged[key] = stage(make(), name)
    return _staged[key]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A given table with its zone-less timestamps read as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    path = f"{sf}/{table}.parquet"
    fields = [
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
        for f in spark.read.parquet(path).schema.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def events_as_ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        "ts",
        "event_id",
        "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("qty"),
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Price = 100 + mean of the last 50 values of the symbol, in whole cents before dividing."""
    raw = events_as_ticks(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    out = over_chunks(
        raw,
        TICK_SERIES,
        lambda c: {
            "px": F.lit(100.0)
            + F.sum("cents").over(c.last(50)).cast("double") / F.count("cents").over(c.last(50)) / F.lit(100.0)
        },
        before=49,
    )
    return out.select("symbol", "ts", "event_id", "px", "qty")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "bars", lambda: build_bars(ticks(spark, sf), "1 hour", tie=("event_id",)))


def bars_dirty(spark: SparkSession, sf: str) -> DataFrame:
    def make():
        k = F.col("k")
        d = number_rows(bars(spark, sf), BAR_SERIES, "k", total=None).withColumn("k", F.col("k") + 1)
        swap = k % 83 == 0
        d = d.withColumns(
            {
                "close": F.when(k % 97 != 0, F.col("close")),
                "volume": F.when(k % 89 == 0, F.lit(0.0)).otherwise(F.col("volume")),
                "high": F.when(swap, F.col("low")).otherwise(F.col("high")),
                "low": F.when(swap, F.col("high")).otherwise(F.col("low")),
                "copy": F.explode(F.when(k % 79 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
            }
        )
        return d.drop("k")

    return once(spark, sf, "bars_dirty", make)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    def make():
        b = over_chunks(
            bars(spark, sf), BAR_SERIES, lambda c: {"ahead": F.lead("close", 5).over(c.window)}, after=5
        )
        k = F.col("volume").cast("long")
        m = F.col("mi")
        return (
            b.withColumn("mi", F.explode(F.array(*[F.lit(i) for i in range(1, len(MODELS) + 1)])))
            .select(
                "symbol",
                "ts",
                F.concat(F.lit("m"), m).alias("model"),
                (((k * (m + 7) + m * 13) % 101) / F.lit(100.0)).alias("prob"),
                F.when(F.col("ahead").isNotNull(), (F.col("ahead") > F.col("close")).cast("int")).alias("y"),
            )
        )

    return once(spark, sf, "predictions", make)


def equity(spark: SparkSession, sf: str) -> DataFrame:
    """10,000 times close over the first close of the symbol."""

    def make():
        b = bars(spark, sf)
        first = b.groupBy("symbol").agg(F.min_by("close", "ts").alias("c0"))
        return b.join(first, "symbol").select(
            F.col("symbol").alias("strategy"), "ts", (F.lit(10_000.0) * F.col("close") / F.col("c0")).alias("equity")
        )

    return once(spark, sf, "equity", make)


TRADE_SERIES = Series(
    order=("ts", "order_id", "line", "part", "quantity", "price", "side"),
    levels=(Level("ts", 10_000 * DAY), Level("ts", DAY), Level("order_id", 10_000.0)),
)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trades, totally ordered by ``TRADE_SERIES.order`` within the symbol."""
    return read(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
    )


def order_requests(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(
        F.col("o_custkey").alias("account"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("notional"),
    )


def pnl_events(spark: SparkSession, sf: str) -> DataFrame:
    return order_requests(spark, sf).select(
        "account", "ts", "order_id", (F.col("notional") - F.lit(250_000.0)).alias("pnl")
    )


ORDER_SERIES = Series(
    keys=("account",),
    order=("ts", "order_id"),
    levels=(Level("ts", 10_000 * DAY), Level("ts", DAY), Level("order_id", 1000.0)),
)


def trials(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(
        F.col("p_brand").alias("study"),
        F.col("p_partkey").alias("trial"),
        F.col("p_retailprice").alias("value"),
        (F.col("p_size") / F.lit(50.0)).alias("drawdown"),
        F.col("p_size").cast("double").alias("size"),
        (F.col("p_partkey") % 17).cast("double").alias("depth"),
        F.when(F.col("p_type") == "SMALL", "pruned").otherwise("complete").alias("state"),
        (F.col("p_size") * F.lit(1.5)).alias("seconds"),
    )


def doc_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    l = read(spark, sf, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id").select(
        "doc_id", F.col("source").alias("model"), ((F.col("n_chars") % 100) / F.lit(100.0)).alias("prob"), F.col("quality").alias("y")
    )


# --- the same views as SQL ---------------------------------------------------------------------

_CTE = {
    "ticks": (
        (),
        """SELECT symbol, ts, event_id, qty,
             100.0::DOUBLE + CAST(sum(cents) OVER w AS DOUBLE) / count(cents) OVER w / 100.0::DOUBLE AS px
           FROM (SELECT event_type AS symbol, ts, event_id, CAST(round(value * 100) AS BIGINT) AS cents,
                        CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS qty FROM events)
           WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    ),
    "bars": (
        ("ticks",),
        """SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(px, ts) AS open, max(px) AS high, min(px) AS low,
             arg_max(px, ts) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2""",
    ),
    "ret": (
        ("bars",),
        """SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret,
             row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
             count(*) OVER (PARTITION BY symbol) AS cnt FROM bars""",
    ),
    "dirty": (
        ("ret",),
        """SELECT symbol, ts, open, CASE WHEN rn % 83 = 0 THEN low ELSE high END AS high,
             CASE WHEN rn % 83 = 0 THEN high ELSE low END AS low,
             CASE WHEN rn % 97 <> 0 THEN close END AS close,
             CASE WHEN rn % 89 = 0 THEN 0.0 ELSE volume END AS volume, copy
           FROM ret JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR rn % 79 = 0""",
    ),
    "predictions": (
        ("bars",),
        """SELECT symbol, ts, 'm' || mi AS model,
             ((CAST(volume AS BIGINT) * (mi + 7) + mi * 13) % 101) / 100.0::DOUBLE AS prob,
             CASE WHEN ahead IS NOT NULL THEN CAST(ahead > close AS INTEGER) END AS y
           FROM (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS ahead FROM bars),
                (VALUES (1), (2), (3)) m(mi)""",
    ),
    "equity": (
        ("bars",),
        """SELECT symbol AS strategy, ts,
             10000.0::DOUBLE * close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS equity FROM bars""",
    ),
    "er": (
        ("equity",),
        """SELECT *, equity / lag(equity) OVER w - 1 AS ret, row_number() OVER w AS rn,
             max(equity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
           FROM equity WINDOW w AS (PARTITION BY strategy ORDER BY ts)""",
    ),
    "trades": (
        (),
        """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
             l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_shipdate AS ts,
             l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part FROM lineitem""",
    ),
    "requests": ((), "SELECT o_custkey AS account, o_orderdate AS ts, o_orderkey AS order_id, o_totalprice AS notional FROM orders"),
    "pnl": (("requests",), "SELECT account, ts, order_id, notional - 250000.0::DOUBLE AS pnl FROM requests"),
    "trials": (
        (),
        """SELECT p_brand AS study, p_partkey AS trial, p_retailprice AS value, p_size / 50.0::DOUBLE AS drawdown,
             CAST(p_size AS DOUBLE) AS size, CAST(p_partkey % 17 AS DOUBLE) AS depth,
             CASE WHEN p_type = 'SMALL' THEN 'pruned' ELSE 'complete' END AS state, p_size * 1.5::DOUBLE AS seconds FROM part""",
    ),
    "scores": (
        (),
        """SELECT doc_id, source AS model, (n_chars % 100) / 100.0::DOUBLE AS prob, quality AS y
           FROM documents JOIN labels USING (doc_id)""",
    ),
}


def with_views(names: str, query: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``WITH`` the named views (and what they need), then ``extra`` steps, then the query."""
    order: list[str] = []

    def need(n: str) -> None:
        for d in _CTE[n][0]:
            need(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS MATERIALIZED ({_CTE[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + query
