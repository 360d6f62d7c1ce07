"""Folds of a cross-validation are fitted side by side, with the scores of one after the other."""

import threading

from pyspark.sql import functions as F

from tidemark.operators import training as M


def test_folds_are_fitted_side_by_side(spark):
    d = spark.range(60).select(F.lit("a").alias("symbol"), F.col("id").alias("ts"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("double").alias("y"))
    fit = lambda t: M.train_random_forest(t, ["x"], params=M.ForestParams(trees=2, depth=2))
    both = threading.Barrier(2)

    def trainer(t):
        both.wait(timeout=60)  # until another fit has begun
        return fit(t)

    assert M.cross_validate(d, ["x"], trainer, k=2).first() == M.cross_validate(d, ["x"], fit, k=2, parallelism=1).first()
