"""Model training, validation and parameter search on Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ensembles import classification_metrics, wide
from tidemark.session import stage

Trainer = Callable[[DataFrame], PipelineModel]


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    subsample: float = 0.8
    columns: str = "all"
    min_rows: int = 1
    seed: int = 42


@dataclass(frozen=True)
class ForestParams:
    trees: int = 100
    depth: int = 10
    min_rows: int = 1
    columns: str = "sqrt"
    seed: int = 42


def complete(df: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """Rows with all features and a label; the label as double."""
    return df.na.drop(subset=[*features, label]).withColumn(label, F.col(label).cast("double"))


def class_weights(df: DataFrame, label: str = "y", out: str = "weight") -> DataFrame:
    """Balanced weights n / (2 * n_class); the classes are a two-row table."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t")).withColumn("_one", F.lit(1))
    w = n.withColumn("_one", F.lit(1)).join(total, "_one").select(label, (F.col("_t") / (2 * F.col("_n"))).alias(out))
    return df.join(F.broadcast(w), label)


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def boosted_trees(label: str, p: BoostParams, validation: str | None = None) -> GBTClassifier:
    g = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=p.rounds, maxDepth=p.depth, stepSize=p.rate, subsamplingRate=p.subsample,
        featureSubsetStrategy=p.columns, minInstancesPerNode=p.min_rows, seed=p.seed,
    )
    return g.setValidationIndicatorCol(validation) if validation else g


def train_boosted_trees(df: DataFrame, features: list[str], label: str = "y", params: BoostParams = BoostParams(), validation: str | None = None) -> PipelineModel:
    """Gradient boosting; rows with a true ``validation`` column stop it early."""
    return Pipeline(stages=[_assembler(features), boosted_trees(label, params, validation)]).fit(complete(df, features, label))


def random_forest(label: str, p: ForestParams) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=p.trees, maxDepth=p.depth,
        minInstancesPerNode=p.min_rows, featureSubsetStrategy=p.columns, seed=p.seed,
    )


def train_random_forest(df: DataFrame, features: list[str], label: str = "y", params: ForestParams = ForestParams()) -> PipelineModel:
    """Random forest with balanced class weights."""
    data = class_weights(complete(df, features, label), label)
    return Pipeline(stages=[_assembler(features), random_forest(label, params)]).fit(data)


def check_features(df: DataFrame, features: list[str]) -> list[str]:
    """Features the model needs and the table lacks."""
    return [f for f in features if f not in df.columns]


def batch_score(model: Model, df: DataFrame, features: list[str], out: str = "prob", fill: bool = False) -> DataFrame:
    """Add the probability of class 1 to every row; null where a feature value is null or not a number.

    Missing feature columns fail. With ``fill`` (the live rule) missing columns and values count 0.
    """
    missing = check_features(df, features)
    if missing and not fill:
        raise ValueError(f"features missing: {missing}")
    ready = df
    if fill:
        ready = df.withColumns({f: F.coalesce(F.col(f), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in features})
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    scored = model.transform(ready).withColumn(out, F.when(whole, vector_to_array("probability")[1]))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def foreign_score(df: DataFrame, features: list[str], predict: Callable, out: str = "prob") -> DataFrame:
    """Score with any Python model: ``predict`` takes a pandas frame of the features, in Arrow batches on the executors."""
    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(predict(x), index=x.index, dtype="float64")

    return df.withColumn(out, run(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))


def validate(model: Model, df: DataFrame, features: list[str], label: str = "y", name: str = "model") -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC on a validation table."""
    d = batch_score(model, complete(df, features, label), features).select(F.lit(name).alias("model"), "prob", F.col(label).alias("y"))
    return classification_metrics(d)


def cross_validate(df: DataFrame, features: list[str], trainer: Trainer, k: int = 5, label: str = "y", key: tuple[str, ...] = ("symbol", "ts"), name: str = "model", parallelism: int = 4) -> DataFrame:
    """Mean and population deviation of four scores over k folds drawn by the hash of the row key; the fits run as parallel jobs of one session."""
    fold = F.pmod(F.xxhash64(*key), F.lit(k))
    data = stage(complete(df, features, label).select(*key, *features, label, fold.alias("_fold")), "folds")

    def work(i: int) -> DataFrame:
        model = trainer(data.filter(F.col("_fold") != i))
        return validate(model, data.filter(F.col("_fold") == i), features, label, f"{name}-{i}")

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(work, range(k)))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    cols = ("accuracy", "precision", "recall", "f1")
    return scores.agg(*[f(c).alias(f"cv_{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).select(F.lit(name).alias("model"), "*")


def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """One row per feature, most important first (the list is as long as the feature list)."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(((f, float(w)) for f, w in zip(features, weights)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


# Fixed grid of the forest search. No limit on depth is written as the deepest tree that Spark grows; a least
# number of rows to split a node has no counterpart beside the least number in a leaf.
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2"]}


def grid_search(
    df: DataFrame, features: list[str], grid: dict[str, list] = FOREST_GRID, label: str = "y", folds: int = 5, parallelism: int = 4,
    base: BoostParams | ForestParams = ForestParams(),
) -> tuple[Model, DataFrame]:
    """All combinations of parameters by cross-validated AUC: the best model and the trial table.

    ``base`` says which kind of model is searched and holds the parameters that the grid leaves out.
    """
    data = _assembler(features).transform(complete(df, features, label)).select("features", label)
    if isinstance(base, ForestParams):
        data = class_weights(data, label)
        est = random_forest(label, base)
    else:
        est = boosted_trees(label, base)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    maps = builder.build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, parallelism=parallelism, seed=base.seed)
    fitted = cv.fit(stage(data, "assembled"))
    rows = [(i, {p.name: str(v) for p, v in m.items()}, float(a)) for i, (m, a) in enumerate(zip(maps, fitted.avgMetrics))]
    return fitted.bestModel, df.sparkSession.createDataFrame(rows, "trial long, params map<string,string>, value double")


@dataclass(frozen=True)
class Space:
    """A search space: integer, float (log-uniform if asked) and choice parameters."""

    ints: dict[str, tuple[int, int]] = field(default_factory=dict)
    floats: dict[str, tuple[float, float, bool]] = field(default_factory=dict)
    choices: dict[str, list] = field(default_factory=dict)

    def draw(self, n: int, seed: int = 42) -> list[dict]:
        rng = random.Random(seed)
        out = []
        for _ in range(n):
            p: dict = {k: rng.randint(a, b) for k, (a, b) in self.ints.items()}
            for k, (a, b, log) in self.floats.items():
                p[k] = math.exp(rng.uniform(math.log(a), math.log(b))) if log else rng.uniform(a, b)
            p.update({k: rng.choice(v) for k, v in self.choices.items()})
            out.append(p)
        return out


# Fixed ranges of the searches.
BOOST_SPACE = Space(ints={"rounds": (50, 500), "depth": (3, 15)}, floats={"rate": (0.01, 0.3, True), "subsample": (0.6, 1.0, False)})
FOREST_SPACE = Space(ints={"trees": (50, 300), "depth": (5, 30), "min_rows": (1, 10)}, choices={"columns": ["sqrt", "log2", "all"]})


def _trial(kind: str, params: dict, train: DataFrame, valid: DataFrame, features: list[str], label: str) -> float:
    if kind == "boost":
        model = train_boosted_trees(train, features, label, BoostParams(**params))
    elif kind == "forest":
        model = train_random_forest(train, features, label, ForestParams(**params))
    else:
        raise ValueError(f"unknown model kind: {kind}")
    return float(validate(model, valid, features, label).first()["auc"])


def random_search(train: DataFrame, valid: DataFrame, features: list[str], kind: str = "boost", space: Space = BOOST_SPACE, n: int = 20, label: str = "y", parallelism: int = 4, seed: int = 42) -> DataFrame:
    """Trial table of ``n`` drawn parameter sets; the fits run as parallel jobs of one session."""
    return multi_model_search(train, valid, features, {kind: space}, n, label, parallelism, seed).drop("study")


def multi_model_search(train: DataFrame, valid: DataFrame, features: list[str], spaces: dict[str, Space], n: int = 20, label: str = "y", parallelism: int = 4, seed: int = 42) -> DataFrame:
    """Random search over several model kinds: (study, trial, params, value, seconds, state, error)."""
    import time

    spark = train.sparkSession
    keep = [*features, label]
    train, valid = stage(train.select(*keep), "train"), stage(valid.select(*keep), "valid")
    jobs = [(kind, i, p) for kind, space in spaces.items() for i, p in enumerate(space.draw(n, seed))]

    def work(job):
        kind, i, p = job
        t0 = time.time()
        try:
            value, state, error = _trial(kind, p, train, valid, features, label), "complete", None
        except (CapturedException, Py4JJavaError) as e:  # what a fit with these parameters may raise
            value, state, error = None, "fail", str(e)[:500]
        return kind, i, {k: str(v) for k, v in p.items()}, value, time.time() - t0, state, error

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(work, jobs))
    if rows and all(r[5] == "fail" for r in rows):
        raise RuntimeError(f"every trial failed, the first with: {rows[0][6]}")
    return spark.createDataFrame(rows, "study string, trial long, params map<string,string>, value double, seconds double, state string, error string")


def train_stacker(predictions: DataFrame, features: DataFrame, models: list[str], cols: list[str], label: str = "y", keys: tuple[str, ...] = ("symbol", "ts"), params: BoostParams = BoostParams(rounds=20, depth=3)) -> tuple[PipelineModel, list[str]]:
    """A boosted model over base-model probabilities and original features (held-out rows only)."""
    y = predictions.groupBy(*keys).agg(F.max(label).alias(label))
    data = wide(predictions, models, keys).join(features.select(*keys, *cols), list(keys)).join(y, list(keys))
    inputs = [*models, *cols]
    return train_boosted_trees(data, inputs, label, params), inputs
