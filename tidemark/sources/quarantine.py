"""Input lines that cannot be used: told apart from good ones, with their file and the reason, and kept in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import BAR_COLUMNS, BARS_CSV, KLINE_FLAT

REJECTED = "file string, line string, problem string"
PRICES = ("o", "h", "l", "c", "v")


def read_bars_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rejected lines) of CSV bars, with or without header lines.

    A line is rejected if a field has the wrong type or fields are missing or too many; empty fields are missing values, which the
    cleaners see to. Rejected lines have the columns of ``REJECTED``. One scan serves either table; nothing is cached.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in BARS_CSV) + ", _line string"
    parsed = F.from_csv("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})
    lines = read_lines(spark, path).filter(~F.startswith(F.lower("value"), F.lit(BARS_CSV.names[0] + ",")))
    d = lines.select("file", "value", parsed.alias("_r"))
    good = d.filter("_r._line is null").select(F.col("_r.timestamp").alias("ts"), *[F.col(f"_r.{c}").alias(c) for c in BAR_COLUMNS])
    fields = F.size(F.split("value", ","))
    problem = F.when(fields < len(BARS_CSV), "fields missing").when(fields > len(BARS_CSV), "too many fields").otherwise("wrong type")
    return good, d.filter("_r._line is not null").select("file", F.col("value").alias("line"), problem.alias("problem"))


def kline_problem(line: Column, message: Column, k: Column, flat: Column) -> Column:
    """Why a line is no usable kline message (nested, enveloped or flat), null if it is one; takes the line and its parsed parts."""
    number = lambda name: k[name].try_cast("double")
    possible = (number("h") >= number("l")) & (number("o") > 0) & (number("c") > 0) & (number("v") >= 0)
    missing = k[PRICES[0]].isNull()
    unread = number(PRICES[0]).isNull()
    for name in PRICES[1:]:
        missing, unread = missing | k[name].isNull(), unread | number(name).isNull()
    return (
        F.when(F.coalesce(F.trim(line) == "", F.lit(True)), "empty")
        .when(message.isNull(), "broken json")
        .when(flat.isNotNull(), F.lit(None))
        .when(F.coalesce(message["e"] != "kline", F.lit(False)), "other event")
        .when(k.isNull(), "no kline")
        .when(k["t"].try_cast("long").isNull(), "no start time")
        .when(missing, "fields missing")
        .when(unread, "wrong type")
        .when(~possible, "impossible values")
    )


def rejected_klines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that :func:`kline_problem` finds fault with; ``file`` where the frame has it. Works on batch and streaming frames.

    Each part of a line is parsed once: parts are columns of their own, and the problem is exploded, as a filter on it would
    be pushed down and parse the line again.
    """
    as_map = lambda c: F.from_json(c, "map<string,string>")
    outer, message, k, flat = (F.col(c) for c in ("_outer", "_message", "_k", "_flat"))
    file = F.col("file") if "file" in lines.columns else F.lit(None).cast("string")
    d = lines.select(file.alias("file"), F.col(value).alias("line"), as_map(F.col(value)).alias("_outer"))
    d = d.withColumn("_message", F.when(F.map_contains_key(outer, "data"), as_map(outer["data"])).otherwise(outer))
    d = d.withColumn("_flat", F.when(F.map_contains_key(outer, "open_time"), F.from_json("line", KLINE_FLAT)["open_time"]))
    d = d.withColumn("_k", as_map(message["k"]))
    return d.select("file", "line", F.explode(F.array_compact(F.array(kline_problem(F.col("line"), message, k, flat)))).alias("problem"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def keep_rejected(rejected: DataFrame, path: str) -> None:
    """Appends to the quarantine table, a folder for each problem."""
    rejected.select("file", "line", "problem").write.mode("append").partitionBy("problem").parquet(path)


def rejected_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each problem in the quarantine table."""
    return spark.read.schema(REJECTED).parquet(path).groupBy("problem").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
