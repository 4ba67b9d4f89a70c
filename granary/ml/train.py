"""Random forest and boosted trees on the feature rows, tuned by walk-forward folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.timing import on
from granary.ml.features import FEATURES, scaling
from granary.schemas import KEY
from granary.session import materialized

SEED = 42

# Weights of the two models in the ensemble.
FOREST_WEIGHT = 0.6
BOOSTED_WEIGHT = 0.4

FOREST_GRID = {
    "numTrees": [100],
    "maxDepth": [5, 10],
    "minInstancesPerNode": [1, 5],
    "featureSubsetStrategy": ["sqrt", "log2"],
}
# The grid of the boosted trees.
BOOSTED_GRID = {
    "maxIter": [100, 200],
    "maxDepth": [3, 5],
    "stepSize": [0.1, 0.3],
    "subsamplingRate": [0.8, 1.0],
}


def forest(**params) -> Pipeline:
    tree = RandomForestRegressor(featuresCol="features", labelCol="target", seed=SEED, **params)
    return Pipeline(stages=[*scaling(), tree])


def boosted(**params) -> Pipeline:
    tree = GBTRegressor(featuresCol="features", labelCol="target", seed=SEED, **params)
    return Pipeline(stages=[*scaling(), tree])


def walk_forward(rows: DataFrame, *, folds: int = 3) -> list[tuple[Column, Column]]:
    """(training rows, validation rows) as date conditions: each fold trains on everything
    before its validation span, and the spans follow one another."""
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return []
    span = (last - first).days / (folds + 1)
    cuts = [first + timedelta(days=int(span * i)) for i in range(1, folds + 1)] + [last]
    day = F.col("date")
    return [
        (day <= on(cut), (day > on(cut)) & (day <= on(end)))
        for cut, end in zip(cuts, cuts[1:], strict=False)
    ]


def grid(options: dict[str, list]) -> list[dict]:
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


#: The setting whose smaller values are prefixes of the same fit: boosting adds trees one after the other.
STAGED = "maxIter"


@dataclass
class Tuned:
    """A search: the model of the best setting fitted on all rows, its mean absolute error over the folds, and all trials as
    (setting, fold, mae)."""

    model: PipelineModel
    setting: dict
    error: float
    trials: list[tuple[dict, int, float]]

    def importances(self) -> dict[str, float]:
        """How much each input contributes to the splits of the trees; they add up to 1."""
        return dict(zip(FEATURES, self.model.stages[-1].featureImportances.toArray().tolist(), strict=True))


def fold_rows(rows: DataFrame, *, folds: int) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """The rows with their input vector, written once for all fits of a search, and its spans. Trees do not depend on the
    scale of an input, so the scaler is left to the final model."""
    assembled = scaling()[0].transform(rows).select("date", "target", F.col("raw_features").alias("features"))
    return materialized(assembled), walk_forward(rows, folds=folds)


def tune(
    rows: DataFrame, make: Callable[..., Pipeline], options: dict[str, list], *, folds: int = 3, parallel: int = 4
) -> Tuned:
    """The setting with the least mean absolute error over the folds, fitted on all rows.

    Each fit is distributed, and `parallel` of them share the cluster. Settings that differ in the number of
    boosting rounds are one fit, measured after each of these numbers. Only errors come to the driver.
    """
    table, spans = fold_rows(rows, folds=folds)
    settings = grid(options)
    staged = sorted({s[STAGED] for s in settings}) if STAGED in options else []
    shared = [s for s in settings if not staged or s[STAGED] == staged[-1]]
    measure = RegressionEvaluator(labelCol="target", metricName="mae")

    def trial(job: tuple[dict, int]) -> list[tuple[dict, int, float]]:
        setting, fold = job
        before, after = spans[fold]
        held = table.filter(after)
        if held.isEmpty() or table.filter(before).isEmpty():
            return []
        model = make(**setting).getStages()[-1].fit(table.filter(before))
        if not staged:
            return [(setting, fold, measure.evaluate(model.transform(held)))]
        errors = model.evaluateEachIteration(held, "absolute")
        return [(setting | {STAGED: n}, fold, errors[n - 1]) for n in staged]

    jobs = [(setting, fold) for setting in shared for fold in range(len(spans))]
    with ThreadPool(max(1, parallel)) as pool:
        trials = [t for found in pool.map(inheritable_thread_target(rows.sparkSession)(trial), jobs) for t in found]
    means = []
    for setting in settings:
        own = [e for s, _, e in trials if s == setting]
        means.append(sum(own) / len(own) if own else float("inf"))
    best = min(range(len(settings)), key=means.__getitem__)
    return Tuned(make(**settings[best]).fit(rows), settings[best], means[best], trials)


def predict(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """One prediction column per model, named after it."""
    kept = [*KEY, "date", "target"]
    out = rows
    for name, model in models.items():
        out = (
            model.transform(out)
            .withColumnRenamed("prediction", name)
            .drop("raw_features", "features")
        )
    return out.select(*kept, *models)


def with_ensemble(predictions: DataFrame, *, forest: str = "rf", boosted: str = "gb") -> DataFrame:
    return predictions.withColumn(
        "ensemble", F.col(forest) * FOREST_WEIGHT + F.col(boosted) * BOOSTED_WEIGHT
    )


def evaluate(predictions: DataFrame, models: list[str], *, target: str = "target") -> DataFrame:
    """Errors of each prediction column in one pass, and which model has the least MAE."""
    long = predictions.select(
        F.col(target).cast("double").alias("y"),
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models
        ])).alias("m"),
    ).select("y", "m.model", "m.p")
    miss = F.col("y") - F.col("p")
    scores = long.groupBy("model").agg(
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (1 - F.avg(miss * miss) / F.nullif(F.var_pop("y"), F.lit(0.0))).alias("r2"),
        (F.avg(F.abs(miss / (F.col("y") + 1))) * 100).alias("mape"),
    )
    # one row per model from here on, so one task for all of them is no harm
    least = F.min(F.struct("mae", "model")).over(W.partitionBy(F.lit(0)))
    return scores.withColumn("is_best", F.col("model") == least["model"])
