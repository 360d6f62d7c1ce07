"""Ensembles, search tables and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ensembles as E
from tidemark.operators import gates as G
from tidemark.operators import metrics as M
from tidemark.operators import search as X
from tidemark.operators import windows as W
from tidemark.registry.core import R, R_list, query, r, rounded
from tidemark.registry.metrics import CORE, K, RM, S as EQUITY, returns, sql_trade_metrics
from tidemark.registry.tables import BAR_SERIES, MODELS, TRADE_SERIES, bars, doc_scores, equity, predictions, read, trades, trials, with_views

KEYS = ["symbol", "ts"]
M3 = list(MODELS)
SIG = {"sig": """SELECT *, CASE WHEN kind = 'HOLD' THEN 0.0 ELSE least(0.1, 0.1 * (confidence - 0.6::DOUBLE) / (1 - 0.6::DOUBLE)) END AS position_size FROM (
    SELECT *, CASE WHEN confidence < 0.6::DOUBLE THEN 'HOLD' WHEN prob > 0.6::DOUBLE THEN 'BUY' WHEN 1 - prob > 1 - 0.4::DOUBLE THEN 'SELL' ELSE 'HOLD' END AS kind
    FROM (SELECT *, greatest(prob, 1 - prob) AS confidence FROM predictions))"""}


@query("e1_signal_from_prob", with_views("predictions", f"SELECT symbol, ts, model, kind AS signal, {R_list(['confidence', 'position_size'])} FROM sig", SIG))
def e1(spark, sf):
    return rounded(E.signal_from_prob(predictions(spark, sf)), ["symbol", "ts", "model", "signal"], ["confidence", "position_size"])


@query("e2_threshold_signal", with_views("predictions", f"""SELECT symbol, ts, model, CASE WHEN symbol = 'view' THEN 'HOLD' WHEN v > 0.5 THEN 'BUY' WHEN v < -0.5 THEN 'SELL' ELSE 'HOLD' END AS signal,
    {R("CASE WHEN symbol = 'view' THEN 0 ELSE abs(v) END")} AS confidence, CASE WHEN symbol <> 'view' AND abs(v) > 0.5 THEN 0.1 ELSE 0.0 END AS position_size
    FROM (SELECT *, prob * 2 - 1 AS v FROM predictions)"""))
def e2(spark, sf):
    p = predictions(spark, sf).withColumn("prediction", F.col("prob") * 2 - 1)
    known = p.select("symbol").distinct().filter(F.col("symbol") != "view")
    return E.threshold_signal(p, known).select("symbol", "ts", "model", "signal", r("confidence").alias("confidence"), "position_size")


@query("e3_signal_stats", with_views("predictions", f"""SELECT symbol, count(*) AS total_signals, count(*) FILTER (kind = 'BUY') AS buy_signals, count(*) FILTER (kind = 'SELL') AS sell_signals,
    count(*) FILTER (kind = 'HOLD') AS hold_signals, {R('avg(confidence)')} AS avg_confidence, max(ts) AS last_signal FROM sig GROUP BY 1""", SIG))
def e3(spark, sf):
    d = E.signal_stats(E.signal_from_prob(predictions(spark, sf)))
    return d.withColumn("avg_confidence", r("avg_confidence"))


def vote(name: str, prob_sql: str, make, views: str = "predictions", extra=None, source: str = "predictions"):
    @query(name, with_views(views, f"SELECT symbol, ts, {R('prob')} AS prob, CAST(prob > 0.5 AS INTEGER) AS label FROM (SELECT symbol, ts, {prob_sql} AS prob FROM {source} GROUP BY 1, 2)", extra))
    def run(spark, sf):
        return rounded(make(spark, sf), [*KEYS, "label"], ["prob"])


vote("e4_soft_vote", "avg(prob)", lambda s, d: E.soft_vote(predictions(s, d)))
vote("e5_hard_vote", "avg(CAST(prob > 0.5 AS INTEGER))", lambda s, d: E.hard_vote(predictions(s, d)))

PERF = {
    "pr": "SELECT *, prob / nullif(lag(prob) OVER (PARTITION BY model ORDER BY ts, symbol), 0) - 1 AS ret FROM predictions",
    "pf": "SELECT model, CASE WHEN stddev_pop(ret) = 0 THEN 0 ELSE avg(ret) / stddev_pop(ret) * sqrt(362880) END AS performance FROM pr GROUP BY 1",
    "pw": "SELECT model, performance, greatest(performance, 0.1) / sum(greatest(performance, 0.1)) OVER () AS weight FROM pf",
}
vote("e6_weighted_vote", "sum(weight * prob) / sum(weight)", lambda s, d: E.weighted_vote(predictions(s, d), E.performance_weights(predictions(s, d))), extra=PERF, source="predictions JOIN pw USING (model)")


@query("e7_performance_weights", with_views("predictions", f"SELECT model, {R_list(['performance', 'weight'])} FROM pw", PERF))
def e7(spark, sf):
    return rounded(E.performance_weights(predictions(spark, sf)), ["model"], ["performance", "weight"])


WIDE = {"wd": "SELECT symbol, ts, max(prob) FILTER (model = 'm1') AS m1, max(prob) FILTER (model = 'm2') AS m2, max(prob) FILTER (model = 'm3') AS m3 FROM predictions GROUP BY 1, 2"}


def diversity(name: str, metric: str, f):
    a, b, c = f("m1", "m2"), f("m1", "m3"), f("m2", "m3")
    step = {**WIDE, "pv": f"SELECT {a} AS ab, {b} AS ac, {c} AS bc FROM wd",
            "dv": "SELECT unnest(['m1', 'm2', 'm3']) AS model, unnest([ab + ac, ab + bc, ac + bc]) / 3 AS diversity FROM pv"}

    @query(name, with_views("predictions", f"SELECT model, {R('diversity')} AS diversity, {R('diversity / sum(diversity) OVER ()')} AS weight FROM dv", step))
    def run(spark, sf):
        return rounded(E.diversity_weights(predictions(spark, sf), M3, metric), ["model"], ["diversity", "weight"])


diversity("e8_diversity_weights", "correlation", lambda a, b: f"1 - abs(corr({a}, {b}))")
diversity("e8_disagreement_weights", "disagreement", lambda a, b: f"avg(CAST({a} <> {b} AS INTEGER))")


@query("e9_equal_weights", with_views("predictions", f"SELECT model, {R('1.0 / count(*) OVER ()')} AS weight FROM (SELECT DISTINCT model FROM predictions)"))
def e9(spark, sf):
    return rounded(E.equal_weights(predictions(spark, sf)), ["model"], ["weight"])


@query("e10_regime_weights", with_views("predictions", f"SELECT model, {R('w / sum(w) OVER ()')} AS weight FROM rw",
    {**PERF, "rw": "SELECT CASE model WHEN 'm1' THEN 'lgb' WHEN 'm2' THEN 'xgb' ELSE 'lstm' END AS model, weight * CASE model WHEN 'm1' THEN 1.2 WHEN 'm2' THEN 1.1 ELSE 0.8 END AS w FROM pw"}))
def e10(spark, sf):
    base = E.performance_weights(predictions(spark, sf))
    named = base.withColumn("model", F.when(F.col("model") == "m1", "lgb").when(F.col("model") == "m2", "xgb").otherwise("lstm"))
    return rounded(E.regime_weights(named, "high_volatility"), ["model"], ["weight"])


@query("e11_stack_features", with_views("predictions ret", f"SELECT symbol, ts, {R_list(['m1', 'm2', 'm3', 'volume', 'close'])} FROM wd JOIN ret USING (symbol, ts)", WIDE))
def e11(spark, sf):
    feats = W.over_chunks(bars(spark, sf), BAR_SERIES, lambda c: {"returns": W.change("close", 1, c)}, before=1)
    d = E.stack_features(predictions(spark, sf), feats, M3, ["close", "volume", "returns"], 2)
    return rounded(d, KEYS, ["m1", "m2", "m3", "volume", "close"])


@query("e12_prediction_correlation", with_views("predictions", f"SELECT model_a, model_b, {R('c')} AS correlation, {R('avg(c) OVER ()')} AS mean_correlation FROM cc",
    {**WIDE, "cc": "SELECT unnest(['m1', 'm1', 'm2']) AS model_a, unnest(['m2', 'm3', 'm3']) AS model_b, unnest([corr(m1, m2), corr(m1, m3), corr(m2, m3)]) AS c FROM wd"}))
def e12(spark, sf):
    return rounded(E.prediction_correlation(predictions(spark, sf), M3), ["model_a", "model_b"], ["correlation", "mean_correlation"])


def sql_scores(source: str) -> dict[str, str]:
    return {
        "ok": f"SELECT * FROM {source} WHERE y IS NOT NULL",
        "rk": "SELECT *, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0 AS rk FROM ok",
        "cm": """SELECT model, count(*) AS n, count(*) FILTER (prob > 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (prob > 0.5 AND y <> 1)::DOUBLE AS fp,
          count(*) FILTER (NOT prob > 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (y = 1)::DOUBLE AS p, sum(rk) FILTER (y = 1) AS s FROM rk GROUP BY 1""",
        "cs": """SELECT model, n, (tp + n - p - fp) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(p, 0), 0) AS recall,
          coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce((s - p * (p + 1) / 2) / nullif(p * (n - p), 0), 0.5) AS auc FROM cm""",
    }


CLS = ["accuracy", "precision", "recall", "f1", "auc"]


def classified(name: str, view: str, table):
    @query(name, with_views(view, f"SELECT model, n, {R_list(CLS)} FROM cs", sql_scores(view)))
    def run(spark, sf):
        return rounded(E.classification_metrics(table(spark, sf)), ["model", "n"], CLS)


classified("e13_classification_metrics", "predictions", predictions)
classified("e13_document_scores", "scores", doc_scores)

PSD = {**PERF, "pe": "SELECT *, sum(prob) OVER (PARTITION BY model ORDER BY ts, symbol) AS equity FROM predictions",
       "pd": "SELECT *, max(equity) OVER (PARTITION BY model ORDER BY ts, symbol) AS peak, row_number() OVER (PARTITION BY model ORDER BY ts, symbol) AS rn FROM pe",
       "px": "SELECT model, arg_min((equity - peak) / nullif(peak, 0), struct_pack(d := equity - peak, n := rn)) AS max_drawdown FROM pd GROUP BY 1"}


@query("e14_prediction_sharpe_drawdown", with_views("predictions", f"SELECT model, {R('performance')} AS sharpe_ratio, {R('max_drawdown')} AS max_drawdown FROM pf JOIN px USING (model)", PSD))
def e14(spark, sf):
    return rounded(E.prediction_sharpe_drawdown(predictions(spark, sf)), ["model"], ["sharpe_ratio", "max_drawdown"])


OBJ = [{"metric": "sharpe_ratio", "weight": 0.7, "direction": "maximize", "target": 1.5}, {"metric": "max_drawdown", "weight": 0.3, "direction": "minimize", "target": 0.1}]


@query("e15_composite_objective", with_views("er", f"""SELECT strategy, {R('0.7 * CASE WHEN sharpe_ratio < 1.5 THEN -abs(1.5 - sharpe_ratio) ELSE sharpe_ratio END - 0.3 * CASE WHEN max_drawdown_pct > 0.1 THEN abs(0.1 - max_drawdown_pct) ELSE max_drawdown_pct END')} AS score FROM pm""", CORE))
def e15(spark, sf):
    d = M.portfolio_metrics(equity(spark, sf), EQUITY).withColumn("max_drawdown", F.col("max_drawdown_pct"))
    return d.select("strategy", r(E.composite_objective(OBJ)).alias("score"))


# --- search tables -----------------------------------------------------------------------------

FOLDS = {"fo": """SELECT model, symbol, avg(prob) / stddev_pop(prob) AS sharpe_ratio, min(prob) - max(prob) AS max_drawdown, avg(CAST((prob > 0.5) = (y = 1) AS INTEGER)) AS accuracy
    FROM predictions GROUP BY 1, 2""",
    "fs": """SELECT model, avg(sharpe_ratio) AS sharpe_mean, stddev_pop(sharpe_ratio) AS sharpe_std, min(sharpe_ratio) AS sharpe_min, max(sharpe_ratio) AS sharpe_max,
      avg(max_drawdown) AS drawdown_mean, stddev_pop(max_drawdown) AS drawdown_std, avg(accuracy) AS accuracy_mean, stddev_pop(accuracy) AS accuracy_std, count(*) AS n_successful_folds, count(*) AS total_folds FROM fo GROUP BY 1""",
    "ft": "SELECT *, sharpe_std / sharpe_mean AS sharpe_cv, drawdown_std / drawdown_mean AS drawdown_cv FROM fs"}
FCOLS = ["sharpe_mean", "sharpe_std", "sharpe_min", "sharpe_max", "drawdown_mean", "drawdown_std", "accuracy_mean", "accuracy_std", "sharpe_cv", "drawdown_cv"]


@query("ml10_fold_stability", with_views("predictions", f"""SELECT model, n_successful_folds, total_folds, {R_list(FCOLS)},
    CASE WHEN sharpe_cv < 0.2 AND drawdown_cv < 0.3 THEN 'High' WHEN sharpe_cv < 0.5 AND drawdown_cv < 0.7 THEN 'Medium' ELSE 'Low' END AS rating FROM ft""", FOLDS))
def ml10(spark, sf):
    p = predictions(spark, sf)
    right = (F.col("prob") > 0.5) == (F.col("y") == 1)
    folds = p.groupBy("model", "symbol").agg(
        (F.avg("prob") / F.stddev_pop("prob")).alias("sharpe_ratio"), (F.min("prob") - F.max("prob")).alias("max_drawdown"), F.avg(right.cast("double")).alias("accuracy"))
    return rounded(X.fold_stability(folds), ["model", "n_successful_folds", "total_folds", "rating"], FCOLS)


@query("ml11_trial_statistics", with_views("trials", f"""SELECT study, count(*) AS total_trials, count(*) FILTER (state = 'complete') AS completed_trials, count(*) FILTER (state = 'pruned') AS pruned_trials,
    count(*) FILTER (state = 'fail') AS failed_trials, arg_max(trial, value) FILTER (state = 'complete') AS best_trial, {R("max(value) FILTER (state = 'complete')")} AS best_value,
    {R('sum(seconds)')} AS optimization_time, {R('avg(seconds)')} AS average_trial_time FROM trials GROUP BY 1"""))
def ml11(spark, sf):
    return rounded(X.trial_statistics(trials(spark, sf)), ["study", "total_trials", "completed_trials", "pruned_trials", "failed_trials", "best_trial"],
                   ["best_value", "optimization_time", "average_trial_time"])


@query("ml12_trial_stability", with_views("trials", f"""SELECT study, count(*) AS n, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std, {R('stddev_samp(value) / avg(value)')} AS cv,
    {R('max(value)')} AS best, {R('min(value)')} AS worst, {R('max(value) - min(value)')} AS range FROM trials GROUP BY 1 HAVING count(*) > 1"""))
def ml12(spark, sf):
    return rounded(X.trial_stability(trials(spark, sf)), ["study", "n"], ["mean", "std", "cv", "best", "worst", "range"])


@query("ml13_param_importance", with_views("trials", f"SELECT study, 'size' AS param, {R('abs(corr(size, value))')} AS importance FROM trials GROUP BY 1 UNION ALL SELECT study, 'depth', {R('abs(corr(depth, value))')} FROM trials GROUP BY 1"))
def ml13(spark, sf):
    return rounded(X.param_importance(trials(spark, sf), ["size", "depth"]), ["study", "param"], ["importance"])


FRONT = {"fr": """SELECT * FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b WHERE b.study = a.study AND b.value >= a.value AND b.drawdown <= a.drawdown
    AND (b.value > a.value OR b.drawdown < a.drawdown))""",
    "di": "SELECT *, sqrt(pow(value - 1, 2) + pow(drawdown, 2)) AS distance FROM fr"}


@query("ml14_pareto_front", with_views("trials", "SELECT study, trial, value, drawdown FROM fr", FRONT))
def ml14(spark, sf):
    return X.pareto_front(trials(spark, sf)).select("study", "trial", "value", "drawdown")


@query("ml15_best_compromise", with_views("trials", f"""SELECT study, trial, value, drawdown, {R('distance')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY distance, trial) AS k FROM di) WHERE k = 1""", FRONT))
def ml15(spark, sf):
    d = X.best_compromise(X.pareto_front(trials(spark, sf)))
    return d.withColumn("distance", r("distance"))


@query("ml16_hypervolume", with_views("trials", f"""SELECT study, count(*) AS n_solutions, {R('sum(value * (prev - drawdown))', 4)} AS hypervolume FROM (
    SELECT *, coalesce(lag(drawdown) OVER (PARTITION BY study ORDER BY value DESC), 1) AS prev FROM (SELECT DISTINCT study, value, drawdown FROM fr WHERE drawdown < 1)) GROUP BY 1""", FRONT))
def ml16(spark, sf):
    return rounded(X.hypervolume(X.pareto_front(trials(spark, sf))), ["study", "n_solutions"], ["hypervolume"], 4)


@query("ml17_model_comparison_matrix", with_views("trials", f"SELECT study, {R("max(value) FILTER (state = 'complete')")} AS best_value, 'search' AS method, count(*) AS trials, {R('sum(seconds)')} AS opt_time_s FROM trials GROUP BY 1"))
def ml17(spark, sf):
    return rounded(X.model_comparison_matrix(trials(spark, sf)), ["study", "method", "trials"], ["best_value", "opt_time_s"])


# --- gates and reports -------------------------------------------------------------------------

GATE = {**CORE, "tm": sql_trade_metrics("strategy", "ret", "er"), "gt": "SELECT strategy, total_return, sharpe_ratio, hit_rate AS win_rate, max_drawdown_pct AS max_drawdown FROM pm JOIN tm USING (strategy)"}


@query("g1_promotion_gate", with_views("er", f"""SELECT strategy AS candidate, {R_list(['total_return', 'sharpe_ratio', 'win_rate', 'max_drawdown'])}, sharpe_ratio >= 1 AS sharpe_ok, win_rate >= 0.45 AS win_rate_ok,
    abs(max_drawdown) <= 0.2 AS max_drawdown_ok, sharpe_ratio >= 1 AND win_rate >= 0.45 AND abs(max_drawdown) <= 0.2 AS passed FROM (SELECT * FROM gt ORDER BY total_return DESC, sharpe_ratio DESC, strategy LIMIT 1)""", GATE))
def g1(spark, sf):
    m = M.portfolio_metrics(equity(spark, sf), EQUITY).join(M.trade_metrics(returns(spark, sf), K, "ret"), K)
    m = m.withColumns({"win_rate": F.col("hit_rate"), "max_drawdown": F.col("max_drawdown_pct")})
    d = G.promotion_gate(m, min_win=0.45, name="strategy")
    return d.withColumns({c: r(c) for c in ("total_return", "sharpe_ratio", "win_rate", "max_drawdown")})


ORDER_DESC = ", ".join(f"{c} DESC" for c in TRADE_SERIES.order)


@query("g2_latest_per_model", with_views("trades", f"SELECT symbol AS model, ts, order_id, line, part FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {ORDER_DESC}) AS k FROM trades) WHERE k = 1"))
def g2(spark, sf):
    runs = trades(spark, sf).withColumnRenamed("symbol", "model")
    return G.latest_per_model(runs, order=TRADE_SERIES.order).select("model", "ts", "order_id", "line", "part")


@query("g3_best_model", with_views("scores", f"SELECT model AS best, {R('auc')} AS auc FROM cs ORDER BY cs.auc DESC, model LIMIT 1", sql_scores("scores")))
def g3(spark, sf):
    return rounded(G.best_model(E.classification_metrics(doc_scores(spark, sf))), ["best"], ["auc"])


@query("g4_model_compatibility", """SELECT p_partkey AS model, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS feature_count, list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'widget') AS compatible,
    p_size / 50.0 < 0.5 AS low_auc, CAST((NOT list_contains(string_split(p_name, ' '), 'red'))::INTEGER + (NOT list_contains(string_split(p_name, ' '), 'widget'))::INTEGER AS INTEGER) AS n_missing FROM part""")
def g4(spark, sf):
    m = read(spark, sf, "part").select(F.col("p_partkey").alias("model"), F.split("p_name", " ").alias("feature_names"), (F.col("p_size") / 50.0).alias("auc"))
    d = G.model_compatibility(m, required=("red", "widget"))
    return d.select("model", "feature_count", "compatible", "low_auc", F.size("missing_features").alias("n_missing"))


def table5(spark, sf):
    return G.performance_table(M.report_metrics(equity(spark, sf), EQUITY), M.trade_metrics(returns(spark, sf), K, "ret"))


@query("g5_performance_table", with_views("er", f"SELECT strategy, total_trades, {R_list(['hit_rate', 'profit_factor'])}, {', '.join(f'{R(e, 5)} AS {n}' for n, e in RM.items())} FROM pm JOIN tm USING (strategy)", GATE))
def g5(spark, sf):
    return table5(spark, sf).select("strategy", "total_trades", r("hit_rate").alias("hit_rate"), r("profit_factor").alias("profit_factor"), *[r(c, 5).alias(c) for c in RM])


@query("g6_drawdown_summary", with_views("er", f"SELECT {R('min(d)')} AS lowest, arg_min(strategy, d) AS lowest_name, {R('max(d)')} AS highest, {R('avg(d)')} AS average FROM (SELECT strategy, abs(max_drawdown_pct) * 100 AS d FROM pm)", CORE))
def g6(spark, sf):
    return rounded(G.drawdown_summary(M.report_metrics(equity(spark, sf), EQUITY)), ["lowest_name"], ["lowest", "highest", "average"])


@query("g7_run_baseline_check", with_views("trades", f"""SELECT symbol AS benchmark, quantity AS seconds, {R_list(['mean', 'std', 'min', 'max'])}, n_runs, {R('change')} AS change, {R('lim')} AS limit,
    CASE WHEN change > lim THEN 'regression' WHEN change < -lim THEN 'improvement' ELSE 'stable' END AS verdict FROM ch""",
    {"rk": f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {ORDER_DESC}) AS k FROM trades",
     "bl": "SELECT symbol, avg(quantity) AS mean, coalesce(stddev_samp(quantity), 0) AS std, min(quantity) AS min, max(quantity) AS max, count(*) AS n_runs FROM rk WHERE k BETWEEN 2 AND 11 GROUP BY 1",
     "ch": "SELECT *, (quantity - mean) / mean AS change, greatest(0.1, 2 * std / mean) AS lim FROM rk JOIN bl USING (symbol) WHERE k = 1"}).replace("AS limit,", 'AS "limit",'))
def g7(spark, sf):
    runs = trades(spark, sf).withColumnsRenamed({"symbol": "benchmark", "quantity": "seconds"})
    order = tuple("seconds" if c == "quantity" else c for c in TRADE_SERIES.order)
    d = G.run_baseline_check(runs, ("benchmark",), order)
    return d.select("benchmark", "seconds", *[r(c).alias(c) for c in ("mean", "std", "min", "max")], "n_runs", r("change").alias("change"), r("limit").alias("limit"), "verdict")
