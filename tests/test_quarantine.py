"""Lines that cannot be used are kept with their file and the reason; good ones are read as before."""

from tidemark.registry.sources import scratch
from tidemark.sources import quarantine as Q
from tidemark.sources import readers

KLINE = '{"e":"kline","E":60001,"s":"X","k":{"t":60000,"T":119999,"s":"X","i":"1m","o":"1.5","h":"2","l":"1","c":"1.2","v":"3","x":true}}'
LINES = {
    KLINE: None, '{"stream":"x","data":' + KLINE + "}": None, '{"open_time":60000,"symbol":"X","open":1.0}': None, KLINE[:40]: "broken json", "": "empty", "  ": "empty", "[1, 2]": "broken json",
    '{"result":null,"id":1}': "no kline", KLINE.replace('"t":60000', '"t":"soon"'): "no start time", KLINE.replace('"o":"1.5",', ""): "fields missing", KLINE.replace('"1.5"', '"n/a"'): "wrong type",
    KLINE.replace('"h":"2"', '"h":"0.5"'): "impossible values", KLINE.replace('"e":"kline"', '"e":"trade"'): "other event",
}


def test_kline_lines(spark):
    path, kept = scratch(spark, "lines"), scratch(spark, "kept")
    spark.createDataFrame([(x,) for x in LINES], "value string").repartition(3).write.text(path)
    bad = Q.rejected_klines(Q.read_lines(spark, path))
    got = bad.collect()
    assert {r.line: r.problem for r in got} == {k: v for k, v in LINES.items() if v} and all(path.split("/")[-1] in r.file for r in got)
    Q.keep_rejected(bad, kept)
    Q.keep_rejected(bad.filter("problem = 'empty'"), kept)
    assert {r.problem: r.n for r in Q.rejected_counts(spark, kept).collect()}["empty"] == 4
    assert readers.parse_klines(spark.read.text(path)).count() >= 2
    assert Q.rejected_klines(spark.createDataFrame([(None,)], "value string")).first().problem == "empty"


def test_lines_are_parsed_once(spark):
    """A part of a line is read by one call of from_json, in no filter and for no rule again."""
    path = scratch(spark, "lines")
    spark.createDataFrame([(KLINE,)], "value string").write.text(path)
    plan = Q.rejected_klines(Q.read_lines(spark, path)).filter("problem <> 'empty'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 4  # the line, the data of an envelope, the kline, the start of a flat line


def test_klines_are_parsed_once(spark):
    path = scratch(spark, "lines")
    spark.createDataFrame([(KLINE,), (KLINE.replace('"e":"kline"', '"e":"trade"').replace("60000", "9223372036854775807"),)], "value string").write.text(path)
    d = readers.parse_klines(spark.read.text(path)).filter("is_closed and volume >= 0")
    assert d._jdf.queryExecution().executedPlan().toString().count("from_json(") == 3  # the line, the data of an envelope, the kline
    assert [(r.symbol, r.volume) for r in d.collect()] == [("X", 3.0)]


def test_mixed_klines_at_one_time(spark):
    """Of two events at one time the one with more trades is the last, in either layout, whatever its price."""
    path = scratch(spark, "mixed")
    nested = [KLINE.replace('"x":true', f'"n":{n},"x":true').replace('"c":"1.2"', f'"c":"{c}"') for n, c in ((9, 1.1), (5, 1.9))]
    flat = ['{"symbol":"Y","open_time":60000,"event_time":7,"close":%s,"trade_count":%d,"is_closed":true}' % x for x in ((1.9, 5), (1.1, 9))]
    spark.createDataFrame([(x,) for x in nested + flat], "value string").repartition(2).write.text(path)
    assert {r.symbol: r.close for r in readers.read_klines(spark, path).collect()} == {"X": 1.1, "Y": 1.1}


def test_bar_lines(spark):
    path = scratch(spark, "csv")
    lines = ["timestamp,open,high,low,close,volume", "2024-01-01 00:00:00,1,2,0.5,1.5,10", "2024-01-01 00:01:00,1,2,,1.5,10", "2024-01-01 00:02:00,1,2,0.5,n/a,10", "yesterday,1,2,0.5,1.5,10", "2024-01-01 00:03:00,1,2", "2024-01-01 00:04:00,1,2,0.5,1.5,10,7"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = Q.read_bars_checked(spark, path)
    assert [(r.open, r.low) for r in good.orderBy("ts").collect()] == [(1.0, 0.5), (1.0, None)]
    assert {r.line: r.problem for r in bad.collect()} == {lines[3]: "wrong type", lines[4]: "wrong type", lines[5]: "fields missing", lines[6]: "too many fields"}
