"""Data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.registry.core import R, query, r
from tidemark.registry.tables import BAR_SERIES as S
from tidemark.registry.tables import bars, bars_dirty, with_views

VALID = "coalesce(high >= low AND high >= open AND high >= close AND low <= open AND low <= close, false)"
SOURCES = ("yahoo", "alpha_vantage", "binance_ws")


def sourced(df):
    """Spread the symbols over three named sources."""
    return df.withColumn("source", F.when(F.col("symbol").isin("click", "error"), SOURCES[0]).when(F.col("symbol").isin("purchase", "signup"), SOURCES[1]).otherwise(SOURCES[2]))


SQL_SOURCE = "CASE WHEN symbol IN ('click', 'error') THEN 'yahoo' WHEN symbol IN ('purchase', 'signup') THEN 'alpha_vantage' ELSE 'binance_ws' END"

Q1 = f"""SELECT symbol, count(*) AS n, count(*) FILTER (ts IS NULL) AS null_ts,
    {', '.join(f'count(*) FILTER ({c} IS NULL) AS null_{c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM dirty GROUP BY 1"""


@query("q1_structure_issues", with_views("dirty", "SELECT *, CAST(null_ts + null_open + null_high + null_low + null_close + null_volume > 0 AS INTEGER) AS structure_issues FROM q", {"q": Q1}))
def q1(spark, sf):
    return Q.structure_issues(bars_dirty(spark, sf))


GAPS = {
    "g": "SELECT symbol, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 1e6 AS gap_s FROM bars",
    "gm": "SELECT *, quantile_cont(gap_s, 0.5) OVER (PARTITION BY symbol) AS median_s FROM g",
    "gg": """SELECT symbol, any_value(median_s) AS median_s, count(*) FILTER (gap_s > 2 * median_s) AS total_gaps,
      coalesce(sum(gap_s) FILTER (gap_s > 2 * median_s), 0) * 100 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS gap_pct FROM gm GROUP BY 1""",
}


@query("q2_temporal_gaps", with_views("bars", f"SELECT symbol, {R('median_s')} AS median_s, total_gaps, {R('gap_pct')} AS gap_pct FROM gg", GAPS))
def q2(spark, sf):
    return Q.temporal_gaps(bars(spark, sf), S).select("symbol", r("median_s").alias("median_s"), "total_gaps", r("gap_pct").alias("gap_pct"))


@query("q2_first_gaps", with_views("bars", """SELECT * FROM (SELECT symbol, ts, gap_s, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS INTEGER) AS rank
    FROM gm WHERE gap_s > 2 * median_s) WHERE rank <= 5""", GAPS))
def q2b(spark, sf):
    return Q.first_gaps(bars(spark, sf), S)


P = ("open", "high", "low", "close")
PRICES = {"pr": f"""SELECT symbol, {', '.join(f'count(*) FILTER ({c} <= 0) AS nonpositive_{c}' for c in P)},
    {', '.join(f'count(*) FILTER ({c} > 500) AS extreme_{c}' for c in P)}, count(*) FILTER (abs(m) > 0.05) AS jumps,
    min(low) AS min_price, max(high) AS max_price, quantile_cont(close, 0.5) AS median_price
    FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS m FROM bars) GROUP BY 1"""}
KINDS = [*[f"nonpositive_{c}" for c in P], *[f"extreme_{c}" for c in P], "jumps"]
ISSUES = "CAST(" + " + ".join(f"({k} > 0)::INTEGER" for k in KINDS) + " AS INTEGER)"


@query("q3_realistic_prices", with_views("bars", f"""SELECT symbol, {', '.join(KINDS)}, {R('min_price')} AS min_price, {R('max_price')} AS max_price,
    {R('median_price')} AS median_price, {ISSUES} AS price_issues FROM pr""", PRICES))
def q3(spark, sf):
    d = Q.realistic_prices(bars(spark, sf), S, ceiling=500.0, jump=0.05)
    return d.select("symbol", *KINDS, *[r(c).alias(c) for c in ("min_price", "max_price", "median_price")], "price_issues")


OHLC = {"oc": f"SELECT symbol, count(*) FILTER (NOT {VALID}) AS invalid, count(*) FILTER (NOT {VALID}) * 100.0 / count(*) AS invalid_pct FROM dirty GROUP BY 1"}


@query("q4_ohlc_consistency", with_views("dirty", f"SELECT symbol, invalid, {R('invalid_pct')} AS invalid_pct FROM oc", OHLC))
def q4(spark, sf):
    return Q.ohlc_consistency(bars_dirty(spark, sf)).select("symbol", "invalid", r("invalid_pct").alias("invalid_pct"))


IQR = {
    "qq": """SELECT symbol, quantile_cont(close, 0.25) - 1.5 * (quantile_cont(close, 0.75) - quantile_cont(close, 0.25)) AS lower_bound,
      quantile_cont(close, 0.75) + 1.5 * (quantile_cont(close, 0.75) - quantile_cont(close, 0.25)) AS upper_bound FROM dirty GROUP BY 1""",
    "io": """SELECT symbol, count(*) FILTER (close < lower_bound OR close > upper_bound) AS outliers,
      count(*) FILTER (close < lower_bound OR close > upper_bound) * 100.0 / count(*) AS outlier_pct,
      any_value(lower_bound) AS lower_bound, any_value(upper_bound) AS upper_bound FROM dirty JOIN qq USING (symbol) GROUP BY 1""",
}


@query("q5_iqr_outliers", with_views("dirty", f"SELECT symbol, outliers, {R('outlier_pct')} AS outlier_pct, {R('lower_bound')} AS lower_bound, {R('upper_bound')} AS upper_bound FROM io", IQR))
def q5(spark, sf):
    return Q.iqr_outliers(bars_dirty(spark, sf)).select("symbol", "outliers", *[r(c).alias(c) for c in ("outlier_pct", "lower_bound", "upper_bound")])


VOL = {"vq": """SELECT symbol, count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (volume = 0) * 100.0 / count(*) AS zero_pct,
    count(*) FILTER (volume < 0) AS negative_volume, avg(volume) AS mean_volume, quantile_cont(volume, 0.5) AS median_volume,
    stddev_samp(volume) AS std_volume FROM dirty GROUP BY 1"""}


@query("q6_volume_quality", with_views("dirty", f"""SELECT symbol, zero_volume, {R('zero_pct')} AS zero_pct, negative_volume, {R('mean_volume')} AS mean_volume,
    {R('median_volume')} AS median_volume, {R('std_volume')} AS std_volume FROM vq""", VOL))
def q6(spark, sf):
    d = Q.volume_quality(bars_dirty(spark, sf))
    return d.select("symbol", "zero_volume", r("zero_pct").alias("zero_pct"), "negative_volume", *[r(c).alias(c) for c in ("mean_volume", "median_volume", "std_volume")])


def _dirty(sql: str) -> str:
    return sql.replace("FROM bars", "FROM dirty").replace("ORDER BY ts)", "ORDER BY ts, copy)")


A = Q.ADVICE
REPORT = {
    "q": Q1,
    **{k: _dirty(v) for k, v in GAPS.items()},
    **{k: _dirty(v).replace("> 500", "> 1000000").replace("> 0.05", "> 0.5") for k, v in PRICES.items()},
    **OHLC, **IQR, **VOL,
    "parts": f"""SELECT symbol, CAST(null_ts + null_open + null_high + null_low + null_close + null_volume > 0 AS INTEGER) AS structure_issues,
      gap_pct, {ISSUES} AS price_issues, {' + '.join(f'nonpositive_{c}' for c in P)} AS bad_prices, invalid_pct, outlier_pct, zero_pct
      FROM q JOIN gg USING (symbol) JOIN pr USING (symbol) JOIN oc USING (symbol) JOIN io USING (symbol) JOIN vq USING (symbol)""",
    "scored": """SELECT *, greatest(0.0, 100.0 - 10 * structure_issues - CASE WHEN gap_pct > 5 THEN least(gap_pct, 20) ELSE 0 END - 5 * price_issues
      - CASE WHEN invalid_pct > 1 THEN invalid_pct ELSE 0 END - CASE WHEN outlier_pct > 2 THEN outlier_pct * 0.5 ELSE 0 END
      - CASE WHEN zero_pct > 10 THEN zero_pct * 0.5 ELSE 0 END) AS quality FROM parts""",
}


@query("q7_quality_report", with_views("dirty", f"""SELECT symbol, structure_issues, {R('gap_pct')} AS gap_pct, price_issues, {R('invalid_pct')} AS invalid_pct,
    {R('outlier_pct')} AS outlier_pct, {R('zero_pct')} AS zero_pct, {R('quality')} AS quality,
    coalesce(nullif(concat_ws('; ', CASE WHEN quality < 50 THEN '{A['critical']}' END, CASE WHEN gap_pct > 5 THEN '{A['gaps']}' END,
      CASE WHEN bad_prices > 0 THEN '{A['prices']}' END, CASE WHEN invalid_pct > 1 THEN '{A['ohlc']}' END), ''), '{A['none']}') AS advice FROM scored""", REPORT))
def q7(spark, sf):
    from dataclasses import replace

    d = Q.quality_report(bars_dirty(spark, sf), replace(S, order=("ts", "copy")))
    return d.select("symbol", "structure_issues", r("gap_pct").alias("gap_pct"), "price_issues",
                    *[r(c).alias(c) for c in ("invalid_pct", "outlier_pct", "zero_pct", "quality")], F.array_join("advice", "; ").alias("advice"))


SCORES = {
    "src": f"SELECT *, {SQL_SOURCE} AS source FROM dirty",
    "dup": "SELECT source, symbol, count(*) - count(DISTINCT ts) AS d FROM src GROUP BY 1, 2",
    "ss": f"""SELECT source, symbol, count(*) AS record_count, greatest(0.0, least(100.0, 100.0
      - count(*) FILTER (close IS NULL) * 100.0 / (count(*) * 6) * 2
      - count(*) FILTER (NOT coalesce({VALID[9:-8]} AND open > 0 AND close > 0, false)) * 100.0 / count(*)
      - (count(*) - count(DISTINCT ts)) * 100.0 / count(*) * 2
      - CASE source WHEN 'yahoo' THEN 5 WHEN 'alpha_vantage' THEN 2 ELSE 10 END)) AS score FROM src GROUP BY 1, 2""",
}


@query("q8_source_score", with_views("dirty", f"SELECT source, symbol, record_count, {R('score')} AS score FROM ss", SCORES))
def q8(spark, sf):
    d = Q.source_score(sourced(bars_dirty(spark, sf)), keys=("symbol",))
    return d.select("source", "symbol", "record_count", r("score").alias("score"))


@query("q9_cache_quality_score", with_views("dirty", f"""SELECT symbol, count(*) AS n, {R('count(*) FILTER (close IS NULL) * 100.0 / (count(*) * 6)')} AS missing_pct,
    count(*) - count(DISTINCT ts) AS duplicates, {R(f"greatest(0.0, least(100.0, 100.0 - count(*) FILTER (close IS NULL) * 100.0 / (count(*) * 6) * 2 - (count(*) - count(DISTINCT ts)) * 50.0 / count(*) - count(*) FILTER (NOT {VALID}) * 100.0 / count(*)))")} AS score
    FROM dirty GROUP BY 1"""))
def q9(spark, sf):
    d = Q.cache_quality_score(bars_dirty(spark, sf))
    return d.select("symbol", "n", r("missing_pct").alias("missing_pct"), "duplicates", r("score").alias("score"))


BEST = {
    "src": SCORES["src"],
    "one": "SELECT source, symbol, ts, count(*) AS c FROM src GROUP BY 1, 2, 3",
    "ds": "SELECT source, sum(c - 1) AS d FROM (SELECT source, ts, sum(c) AS c FROM one GROUP BY 1, 2) GROUP BY 1",
    "ss": f"""SELECT source, count(*) AS record_count, greatest(0.0, least(100.0, 100.0
      - count(*) FILTER (close IS NULL) * 100.0 / (count(*) * 6) * 2
      - count(*) FILTER (NOT coalesce({VALID[9:-8]} AND open > 0 AND close > 0, false)) * 100.0 / count(*)
      - any_value(d) * 100.0 / count(*) * 2 - CASE source WHEN 'yahoo' THEN 5 WHEN 'alpha_vantage' THEN 2 ELSE 10 END)) AS score
      FROM src JOIN ds USING (source) GROUP BY 1""",
    "win": """SELECT source FROM ss ORDER BY CASE WHEN score >= 80 THEN list_position(['yahoo', 'alpha_vantage', 'binance_ws'], source) END NULLS LAST,
      score DESC, record_count DESC, source LIMIT 1""",
}


@query("q10_select_best_source", with_views("dirty", "SELECT source, symbol, count(*) AS n FROM src WHERE source IN (SELECT source FROM win) GROUP BY 1, 2", BEST))
def q10(spark, sf):
    d = sourced(bars_dirty(spark, sf))
    win = Q.select_best_source(Q.source_score(d), list(SOURCES))
    return Q.rows_of_best_source(d, win).groupBy("source", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("q11_duplicate_timestamps", with_views("dirty", "SELECT symbol, count(*) AS n, count(*) - count(DISTINCT ts) AS duplicates FROM dirty GROUP BY 1"))
def q11(spark, sf):
    return Q.duplicate_timestamps(bars_dirty(spark, sf))
