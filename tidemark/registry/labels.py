"""Labels, splits and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import splits as T
from tidemark.operators import windows as W
from tidemark.plans.chunks import Chunks
from tidemark.registry.core import R, query, r, rounded
from tidemark.registry.tables import BAR_SERIES as S
from tidemark.registry.tables import bars, doc_scores, predictions, with_views
from tidemark.registry.windows import BB_MEAN, BB_STD, PREP, sql_vol, sql_vwap

H, UP, DOWN = 15, 0.01, 0.01


def label_out():
    """Nullable labels leave as doubles, which both engines hand over alike."""
    return F.col("y").cast("double").alias("y")


def barrier_sql(horizon: int, up: float, down: float) -> dict[str, str]:
    return {
        "hits": f"""SELECT t.symbol, t.ts, t.rn, t.cnt,
        min(CASE WHEN f.high >= t.close * (1 + {up}::DOUBLE) THEN f.rn END) AS up,
        min(CASE WHEN f.low <= t.close * (1 - {down}::DOUBLE) THEN f.rn END) AS down
      FROM ret t LEFT JOIN ret f ON f.symbol = t.symbol AND f.rn BETWEEN t.rn + 1 AND t.rn + {horizon} GROUP BY ALL""",
        "lab": f"""SELECT symbol, ts, CAST(CASE WHEN rn > cnt - {horizon} THEN 0 WHEN up IS NOT NULL AND (down IS NULL OR up <= down) THEN 1
        WHEN down IS NOT NULL THEN -1 ELSE 0 END AS INTEGER) AS label FROM hits""",
    }


BARRIER = barrier_sql(H, UP, DOWN)
SIGN = {"sgn": f"""SELECT *, CASE WHEN lead(close, {H}) OVER (PARTITION BY symbol ORDER BY ts) IS NOT NULL
    THEN CAST(lead(close, {H}) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 > 0 AS INTEGER) END AS y FROM ret"""}
SPLIT_CASE = """CASE WHEN rn <= floor(cnt * 0.6::DOUBLE) THEN 'train'
    WHEN rn <= cnt - floor(cnt * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END"""
SPLIT = {"sp": f"SELECT *, {SPLIT_CASE} AS split FROM ret"}


@query("l1_triple_barrier", with_views("ret", "SELECT symbol, ts, label FROM lab", BARRIER))
def l1(spark, sf):
    return L.triple_barrier(bars(spark, sf), S, H, UP, DOWN).select("symbol", "ts", "label")


@query("l1_long_horizon", with_views("ret", "SELECT symbol, ts, label FROM lab", barrier_sql(120, 0.5, 0.3)))
def l1_long(spark, sf):
    """Barriers far away, over more rows than an array for each row would hold in reason: block by block."""
    return L.triple_barrier(bars(spark, sf), S, 120, 0.5, 0.3).select("symbol", "ts", "label")


@query("l2_binary_label", with_views("ret", "SELECT symbol, ts, CAST(label = 1 AS INTEGER) AS y FROM lab", BARRIER))
def l2(spark, sf):
    d = L.triple_barrier(bars(spark, sf), S, H, UP, DOWN)
    return d.select("symbol", "ts", L.binary_label("label").alias("y"))


@query("l3_sign_return_label", with_views("ret", "SELECT symbol, ts, CAST(y AS DOUBLE) AS y FROM sgn", SIGN))
def l3(spark, sf):
    return L.sign_return_label(bars(spark, sf), S, H).select("symbol", "ts", label_out())


@query("l4_make_labels", with_views("ret", "SELECT symbol, ts, CAST(y AS DOUBLE) AS y FROM sgn", SIGN))
def l4(spark, sf):
    return L.make_labels(bars(spark, sf), S, L.LabelConfig("sign_return_h", "15h", "1h")).select("symbol", "ts", label_out())


@query("l5_label_distribution", with_views(
    "ret", f"SELECT CAST(y AS DOUBLE) AS y, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()')} AS share FROM sgn GROUP BY y", SIGN))
def l5(spark, sf):
    d = L.label_distribution(L.sign_return_label(bars(spark, sf), S, H))
    return d.select(label_out(), "n", r("share").alias("share"))


@query("l6_align_labels", with_views("ret", f"""SELECT symbol, ts, {R('close')} AS close, split, CASE WHEN split <> 'test' THEN CAST(y AS DOUBLE) END AS y
    FROM (SELECT *, {SPLIT_CASE} AS split FROM sgn) WHERE split = 'test' OR y IS NOT NULL""", SIGN))
def l6(spark, sf):
    b = bars(spark, sf)
    d = L.align_labels(T.time_split(b, S), L.sign_return_label(b, S, H), split="split")
    return d.select("symbol", "ts", r("close").alias("close"), "split", label_out())


@query("t1_time_split", with_views("ret", "SELECT symbol, ts, split FROM sp", SPLIT))
def t1(spark, sf):
    return T.time_split(bars(spark, sf), S).select("symbol", "ts", "split")


@query("t2_assert_no_leakage", with_views("ret", """SELECT *, train_end < validation_start AND validation_end < test_start AS ok FROM (
    SELECT symbol, max(CASE WHEN split = 'train' THEN ts END) AS train_end, min(CASE WHEN split = 'validation' THEN ts END) AS validation_start,
      max(CASE WHEN split = 'validation' THEN ts END) AS validation_end, min(CASE WHEN split = 'test' THEN ts END) AS test_start
    FROM sp GROUP BY symbol)""", SPLIT))
def t2(spark, sf):
    d = T.time_split(bars(spark, sf), S)
    return T.leakage(d)


@query("t3_slice_by_split_ranges", with_views("ret", f"""SELECT f.symbol, f.ts, g.split, {R('f.ret')} AS returns FROM ret f
    JOIN (SELECT symbol, split, min(ts) AS a, max(ts) AS b FROM sp GROUP BY 1, 2) g ON g.symbol = f.symbol AND f.ts BETWEEN g.a AND g.b""", SPLIT))
def t3(spark, sf):
    b = bars(spark, sf)
    c = Chunks(b, S, before=1)
    f = c.close(c.df.withColumns(W.bar_terms(c)))
    d = T.slice_by_split_ranges(f, T.time_split(b, S).select("symbol", "ts", "split"))
    return d.select("symbol", "ts", "split", r("returns").alias("returns"))


@query("t4_sequence_split", with_views("ret", """SELECT symbol, ts, CASE WHEN k <= m - floor(m * 0.2::DOUBLE) - floor(m * 0.1::DOUBLE) THEN 'train'
    WHEN k <= m - floor(m * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, rn - 29 AS k, cnt - 29 AS m FROM ret WHERE rn >= 30)"""))
def t4(spark, sf):
    d = W.sliding_sequences(bars(spark, sf), S, ["close"], 30).select("symbol", "ts")
    return T.sequence_split(d, S).select("symbol", "ts", "split")


@query("t5_minmax_scale", with_views("ret", f"""SELECT symbol, ts, {R('(close - lo) / (hi - lo) * 2 - 1')} AS close, {R('(volume - vlo) / (vhi - vlo) * 2 - 1')} AS volume
    FROM sp, (SELECT min(close) AS lo, max(close) AS hi, min(volume) AS vlo, max(volume) AS vhi FROM sp WHERE split = 'train')""", SPLIT))
def t5(spark, sf):
    return rounded(T.minmax_scale(T.time_split(bars(spark, sf), S), ["close", "volume"]), ["symbol", "ts"], ["close", "volume"])


@query("t5_standard_scale", with_views("ret", f"""SELECT symbol, ts, {R('(close - m) / s')} AS close FROM sp
    JOIN (SELECT symbol, avg(close) AS m, stddev_pop(close) AS s FROM sp WHERE split = 'train' GROUP BY 1) USING (symbol)""", SPLIT))
def t5b(spark, sf):
    d = T.standard_scale(T.time_split(bars(spark, sf), S), ["close"], keys=("symbol",))
    return rounded(d, ["symbol", "ts"], ["close"])


@query("t6_time_series_folds", with_views("ret", """SELECT symbol, fold, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
    SELECT symbol, ts, f AS fold, CASE WHEN rn <= cnt - (5 - f) * (cnt // 6) THEN 'train' WHEN rn <= cnt - (4 - f) * (cnt // 6) THEN 'test' END AS role
    FROM ret, (SELECT CAST(unnest(range(5)) AS INTEGER) AS f)) WHERE role IS NOT NULL GROUP BY 1, 2, 3"""))
def t6(spark, sf):
    d = T.time_series_folds(bars(spark, sf).select("symbol", "ts"), S, 5)
    return d.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("t7_holdout_split", with_views("scores", """SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT), doc_id)
    <= floor(count(*) OVER (PARTITION BY y) * 0.3::DOUBLE) AS holdout FROM scores"""))
def t7(spark, sf):
    return T.holdout_split(doc_scores(spark, sf), 0.3, "y", ("doc_id",)).select("doc_id", "y", "holdout")


@query("t8_min_rows_guard", with_views("ret", """SELECT *, n >= 500 AND n_features >= 5 AND n_train >= 100 AND n_validation >= 100 AND n_test >= 100 AS ok FROM (
    SELECT count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation,
      count(*) FILTER (split = 'test') AS n_test, 6 AS n_features FROM sp)""", SPLIT))
def t8(spark, sf):
    return T.row_guard(T.time_split(bars(spark, sf), S), 6)


@query("flagship_split_summary", with_views("ret", f"""SELECT symbol, split, count(*) AS n, {R('avg(y)')} AS up_share, {R('avg(vwap_10)', 4)} AS avg_vwap,
    {R('avg(vol_20)')} AS avg_vol, {R('avg(bb)', 4)} AS avg_bb
    FROM (SELECT symbol, {SPLIT_CASE} AS split, y, vwap_10, vol_20, bb FROM f) GROUP BY 1, 2""",
    {**PREP, "f": f"""SELECT symbol, rn, cnt, CASE WHEN lead(close, {H}) OVER o IS NOT NULL THEN CAST(lead(close, {H}) OVER o > close AS INTEGER) END AS y,
      {sql_vwap(10)} AS vwap_10, {sql_vol(20)} AS vol_20, (close - ({BB_MEAN} - 2 * {BB_STD})) / nullif(4 * {BB_STD}, 0) AS bb
      FROM prep WINDOW o AS (PARTITION BY symbol ORDER BY ts)"""}))
def flagship(spark, sf):
    """Bars to features, label, split and a summary, in one chunk layout."""
    c = Chunks(bars(spark, sf), S, before=21, after=H)
    roll = W.bar_rolling(c)
    d = roll.add(c.df.withColumns({**W.bar_terms(c), "_pos": c.position, "_ahead": F.lead("close", H).over(c.window)}))
    n = F.col("_total")
    split = F.when(F.col("_pos") < F.floor(n * F.lit(0.6)), "train").when(F.col("_pos") < n - F.floor(n * F.lit(0.2)), "validation")
    d = d.withColumns({**W.spread(c, "close", 20, "_c20"), "vol_20": W.volatility(c, 20)})
    d = d.withColumns(
        {
            "y": F.when(F.col("_ahead").isNotNull(), (F.col("_ahead") > F.col("close")).cast("int")),
            "vwap_10": W.vwap(roll, 10),
            "bb": W.bollinger_of("_c20")["bb_position"],
            "split": split.otherwise("test"),
        }
    )
    return c.close(d).groupBy("symbol", "split").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("up_share"), r(F.avg("vwap_10"), 4).alias("avg_vwap"),
        r(F.avg("vol_20")).alias("avg_vol"), r(F.avg("bb"), 4).alias("avg_bb"),
    )
