"""Model training and search on the bars' features; rows-only, tree models differ by engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import splits as T
from tidemark.operators import training as M
from tidemark.operators import windows as W
from tidemark.registry.core import R, query, r
from tidemark.registry.tables import BAR_SERIES as S
from tidemark.registry.tables import MODELS, bars, once, predictions, with_views

FEATURES = ["ret_1m", "ret_5m", "rsi_14", "vwap_10", "price_vwap_ratio_10", "volatility_20m", "bb_position", "volume_ratio_20"]
#: Forests are trained at their full size. Boosting is cut to few rounds, since each is a chain of Spark jobs.
SMALL = M.BoostParams(rounds=4, depth=3)


def data(spark, sf):
    """Features, sign label and time split of all bars."""

    def make():
        f = W.feature_matrix(bars(spark, sf), S, ("ret_1m", "rsi_14", "imb_10"))
        d = f.select("symbol", "ts", *FEATURES).join(L.sign_return_label(bars(spark, sf), S, 5).select("symbol", "ts", "y"), ["symbol", "ts"])
        return M.complete(T.time_split(d, S), FEATURES)

    return once(spark, sf, "training", make)


def part(d, name):
    return d.filter(F.col("split") == name)


@query("ml1_train_boosted_trees")
def ml1(spark, sf):
    d = data(spark, sf).filter(F.col("split") != "test").withColumn("held", F.col("split") == "validation")
    model = M.train_boosted_trees(d, FEATURES, params=SMALL, validation="held")
    return M.validate(model, part(data(spark, sf), "test"), FEATURES, name="boost")


@query("ml2_train_random_forest")
def ml2(spark, sf):
    d = data(spark, sf)
    model = M.train_random_forest(part(d, "train"), FEATURES)
    return M.validate(model, part(d, "validation"), FEATURES, name="forest")


@query("ml2_class_weights", with_views("", f"SELECT quality, {R('any_value(n) / (2.0 * count(*))')} AS weight, count(*) AS n_rows FROM labels, (SELECT count(*) AS n FROM labels) GROUP BY 1").replace("WITH \n", ""))
def ml2b(spark, sf):
    from tidemark.registry.tables import read

    d = M.class_weights(read(spark, sf, "labels"), "quality")
    return d.groupBy("quality").agg(r(F.max("weight")).alias("weight"), F.count(F.lit(1)).alias("n_rows"))


@query("ml3_train_stacker")
def ml3(spark, sf):
    d = data(spark, sf)
    held = T.holdout_split(predictions(spark, sf).join(d.select("symbol", "ts"), ["symbol", "ts"]).filter("y IS NOT NULL"), 0.3, "y", ("symbol", "ts")).filter("holdout")
    model, inputs = M.train_stacker(held, d, list(MODELS), ["volatility_20m", "rsi_14"])
    return M.feature_importance(spark, model, inputs)


@query("ml4_validate")
def ml4(spark, sf):
    d = data(spark, sf)
    return M.validate(M.train_boosted_trees(part(d, "train"), FEATURES, params=SMALL), part(d, "validation"), FEATURES, name="boost")


@query("ml5_cross_validate")
def ml5(spark, sf):
    return M.cross_validate(data(spark, sf), FEATURES, lambda t: M.train_random_forest(t, FEATURES))


@query("ml6_feature_importance")
def ml6(spark, sf):
    return M.feature_importance(spark, M.train_boosted_trees(part(data(spark, sf), "train"), FEATURES, params=SMALL), FEATURES)


@query("ml7_grid_search")
def ml7(spark, sf):
    _, trials = M.grid_search(part(data(spark, sf), "train"), FEATURES, {"numTrees": [10, 20], "maxDepth": [5, 10], "featureSubsetStrategy": ["sqrt", "log2"]}, folds=2)
    return trials.select("trial", "params", "value")


TINY_BOOST = M.Space(ints={"rounds": (2, 4), "depth": (2, 3)}, floats={"rate": (0.01, 0.3, True), "subsample": (0.6, 1.0, False)})
TINY_FOREST = M.Space(ints={"trees": (3, 6), "depth": (2, 4)}, choices={"columns": ["sqrt", "log2"]})


@query("ml8_random_search")
def ml8(spark, sf):
    d = data(spark, sf)
    return M.random_search(part(d, "train"), part(d, "validation"), FEATURES, "boost", TINY_BOOST, 3).drop("seconds")


@query("ml9_multi_model_search")
def ml9(spark, sf):
    d = data(spark, sf)
    return M.multi_model_search(part(d, "train"), part(d, "validation"), FEATURES, {"boost": TINY_BOOST, "forest": TINY_FOREST}, 2).drop("seconds")


@query("e16_batch_score")
def e16(spark, sf):
    d = data(spark, sf)
    model = M.train_boosted_trees(part(d, "train"), FEATURES, params=SMALL)
    return M.batch_score(model, part(d, "test"), FEATURES).select("symbol", "ts", "prob")


def momentum_rule(x):
    """A stand-in for a foreign model: logistic of two features."""
    import numpy as np

    return 1 / (1 + np.exp(-(40 * x["ret_5m"] + (x["rsi_14"] - 50) / 25)))


@query("e16_foreign_score")
def e16b(spark, sf):
    return M.foreign_score(data(spark, sf), FEATURES, momentum_rule).select("symbol", "ts", r("prob").alias("prob"))
