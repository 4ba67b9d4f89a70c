"""Models: time order, invariants on known series, storage."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.ml import features, forecast, registry, train
from granary.ml.synthetic import synthetic_demand
from granary.plans.series import frame
from granary.plans.views import Tables
from granary.schemas import KEY
from granary.session import fresh_dir
from tests.conftest import MEDIUM, as_set


@pytest.fixture(scope="module")
def rows(spark):
    before, after = features.time_split(frame(Tables(spark, MEDIUM)))
    return features.feature_rows(before).cache(), features.feature_rows(after).cache()


def test_split_is_by_time(spark, rows):
    learn, test = rows
    last = learn.agg(F.max("date")).first()[0]
    first, end = test.agg(F.min("date"), F.max("date")).first()
    assert last < first and (end - last).days <= features.TEST_DAYS


def test_scaler_knows_only_the_training_rows(spark, rows):
    learn, test = rows
    from pyspark.ml.functions import vector_to_array

    scaled = features.feature_matrix(learn, learn).select(vector_to_array("features").alias("x"))
    means = scaled.select([F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(6)]).first()
    assert all(abs(m) < 1e-6 for m in means)
    other = features.feature_matrix(learn, test).select(vector_to_array("features").alias("x"))
    assert any(abs(other.agg(F.avg(F.col("x")[i])).first()[0]) > 1e-3 for i in range(6))


def test_folds_walk_forward(rows):
    learn, _ = rows
    spans = train.walk_forward(learn, folds=3)
    assert len(spans) == 3
    seen = 0
    for before, after in spans:
        newest = learn.filter(before).agg(F.max("date")).first()[0]
        oldest = learn.filter(after).agg(F.min("date")).first()[0]
        assert newest < oldest
        assert learn.filter(before).count() > seen
        seen = learn.filter(before).count()


def test_models_beat_the_mean_or_are_near_it_and_ensemble_is_weighted(rows):
    learn, test = rows
    models = {
        "rf": train.forest(numTrees=10, maxDepth=4).fit(learn),
        "gb": train.boosted(maxIter=5, maxDepth=3).fit(learn),
    }
    got = train.with_ensemble(train.predict(models, test)).cache()
    assert got.filter("abs(ensemble - (0.6 * rf + 0.4 * gb)) > 1e-9").count() == 0
    scores = {r.model: r for r in train.evaluate(got, ["rf", "gb", "ensemble"]).collect()}
    assert sum(r.is_best for r in scores.values()) == 1
    assert all(r.rmse >= r.mae > 0 and r.r2 > -1 for r in scores.values())


def test_tune_takes_the_least_error(rows):
    learn, _ = rows
    tuned = train.tune(learn, train.forest, {"numTrees": [2], "maxDepth": [1, 4]}, folds=2)
    means = {d: sum(e for s, _, e in tuned.trials if s["maxDepth"] == d) / 2 for d in (1, 4)}
    assert len(tuned.trials) == 4 and tuned.error == min(means.values()) and means[tuned.setting["maxDepth"]] == tuned.error
    assert set(tuned.importances()) == set(features.FEATURES) and sum(tuned.importances().values()) == pytest.approx(1)


def test_boosting_rounds_share_a_fit(rows):
    """The error after some rounds of a longer fit is that of a fit of so many rounds."""
    learn, _ = rows
    options = {"maxIter": [2, 4], "maxDepth": [2]}
    shared = {s["maxIter"]: e for s, fold, e in train.tune(learn, train.boosted, options, folds=1).trials if fold == 0}
    alone = {n: train.tune(learn, train.boosted, {"maxIter": [n], "maxDepth": [2]}, folds=1).trials[0][2] for n in (2, 4)}
    assert shared == pytest.approx(alone)


def test_pipeline_storage(spark, rows):
    learn, test = rows
    model = train.forest(numTrees=2, maxDepth=2).fit(learn)
    path = fresh_dir(spark, "test-pipeline")
    version = registry.save_pipeline(
        spark, model, path, name="rf", trained_at=datetime(2024, 1, 1), metrics={"mae": 1.0},
        features=features.FEATURES,
    )
    back = registry.load_pipeline(path, name="rf", version=version)
    a, b = (m.transform(test).agg(F.sum("prediction")).first()[0] for m in (model, back))
    assert a == pytest.approx(b)
    assert spark.read.json(f"{path}/metadata").first().version == version


# -- forecasts ------------------------------------------------------------------------------


def series(spark, value, days=300, sku="A"):
    first = date(2023, 3, 1)
    out = [(sku, "W", first + timedelta(days=i), float(value(i, first + timedelta(days=i)))) for i in range(days)]
    return spark.createDataFrame(out, "sku string, warehouse_id string, date date, demand double")


def test_forecast_follows_trend_and_week(spark):
    daily = series(spark, lambda i, d: 50 + 0.2 * i + (15 if d.weekday() in (4, 5) else 0))
    ahead = forecast.forecast(forecast.fit_models(daily, multiplicative=False), horizon=28).collect()
    assert len(ahead) == 28 and ahead[0].date == date(2023, 3, 1) + timedelta(days=300)
    busy = [r.yhat for r in ahead if r.date.weekday() in (4, 5)]
    calm = [r.yhat for r in ahead if r.date.weekday() not in (4, 5)]
    assert sum(busy) / len(busy) - sum(calm) / len(calm) == pytest.approx(15, abs=6)
    assert sum(calm) / len(calm) == pytest.approx(50 + 0.2 * 314, rel=0.25)
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in ahead)


def solved(days, values, seen, multiplicative):
    """The model from its rules: least squares for the line, then one ridge regression per block, normal equations solved."""
    x = np.array([(d - days[0]).days for d in days], float)
    y = np.array(values, float)
    line = np.stack([np.ones(len(x)), x], axis=1)
    level, slope = np.linalg.lstsq(line[seen], y[seen], rcond=None)[0]
    base = level + slope * x
    floor = max(np.abs(y[seen]).mean() * 0.01, 1e-9)
    rest = y / np.maximum(base, floor) - 1 if multiplicative else y - base
    groups = [
        np.array([d.weekday() for d in days]), np.array([d.month - 1 for d in days]),
        np.floor(np.mod(x, 30.5) * 10 / 30.5).astype(int),
    ]
    effects, total = [], np.zeros(len(x))
    for group, size in zip(groups, (7, 12, 10), strict=True):
        inputs = np.eye(size)[group]
        own = np.linalg.solve(inputs[seen].T @ inputs[seen] + np.eye(size), inputs[seen].T @ rest[seen])
        effects.append(own)
        rest, total = rest - inputs @ own, total + inputs @ own
    return (level, slope), effects, base * (1 + total) if multiplicative else base + total


@pytest.mark.parametrize("multiplicative", [True, False])
def test_models_equal_the_solved_normal_equations(spark, multiplicative):
    rng = random.Random(8)
    rows = []
    for sku, count in (("A", 400), ("B", 47), ("C", 31)):
        days = sorted(date(2022, 11, 3) + timedelta(days=d) for d in rng.sample(range(2 * count), count))
        rows += [(sku, "W", d, float(rng.randint(0, 60) + 10 * (d.weekday() == 2) + d.month)) for d in days]
    daily = spark.createDataFrame(rng.sample(rows, len(rows)), "sku string, warehouse_id string, date date, demand double")
    models = forecast.fit_models(daily, multiplicative=multiplicative)
    got = {r.sku: r for r in models.collect()}
    ahead = {(r.sku, r.date): r for r in forecast.forecast(models, horizon=40).collect()}
    for sku, row in got.items():
        days, values = zip(*[(d, v) for s, _, d, v in rows if s == sku], strict=True)
        everything = np.ones(len(days), bool)
        line, effects, fit = solved(days, values, everything, multiplicative)
        assert row.trend == pytest.approx(line, abs=1e-6)
        for block, own in zip(("weekly", "yearly", "monthly"), effects, strict=True):
            assert row[block] == pytest.approx(own, abs=1e-6)
        assert row.deviation == pytest.approx(np.std(np.array(values) - fit), abs=1e-6)
        n = len(days) * 8 // 10
        seen = np.arange(len(days)) < n
        part = solved(days, values, seen, False)[2]
        y = np.array(values)[~seen]
        share = np.abs(y - part[~seen]) / np.maximum(np.abs(y), np.finfo(float).eps)
        assert row.mape == pytest.approx(share.mean(), rel=1e-6)
        for step in range(1, 41):
            day = days[-1] + timedelta(days=step)
            x = (day - days[0]).days
            base = line[0] + line[1] * x
            three = (effects[0][day.weekday()], effects[1][day.month - 1], effects[2][int((x % 30.5) * 10 / 30.5)])
            yhat = base * (1 + sum(three)) if multiplicative else base + sum(three)
            out = ahead[sku, day]
            assert (out.yhat, out.trend, out.seasonality) == pytest.approx((yhat, base, three[0] + three[1]), abs=1e-6)
            assert out.yhat_upper - out.yhat == pytest.approx(forecast.Z_95 * row.deviation, abs=1e-6)


def test_short_and_broken_series_are_reported(spark):
    daily = series(spark, lambda i, d: 5, days=29).unionByName(series(spark, lambda i, d: 5, days=30, sku="B"))
    models = forecast.fit_models(daily)
    assert as_set(forecast.training_report(models), "sku", "status", "error", "data_points") == {
        ("A", "error", forecast.TOO_SHORT, 29), ("B", "success", None, 30),
    }
    assert as_set(forecast.forecast(models, horizon=3), "sku") == {("B",)}


def test_synthetic_demand_is_repeatable_and_fits(spark):
    made = synthetic_demand(spark, skus=2, warehouses=2, days=120, end=date(2024, 1, 31))
    again = synthetic_demand(spark, skus=2, warehouses=2, days=120, end=date(2024, 1, 31))
    assert made.count() == 480 and made.exceptAll(again).count() == 0
    models = forecast.fit_models(made.withColumnRenamed("daily_sales", "demand"))
    assert models.filter("status = 'success'").count() == 4
    assert models.agg(F.max("mape")).first()[0] < 1.0


def test_registry_serves_the_newest_version_of_each_key(spark):
    path = fresh_dir(spark, "test-models")
    old = forecast.fit_models(series(spark, lambda i, d: 5, days=40).unionByName(
        series(spark, lambda i, d: 5, days=40, sku="B")))
    new = forecast.fit_models(series(spark, lambda i, d: 9, days=50))
    registry.save_models(old, path, trained_at=datetime(2024, 1, 1))
    registry.save_models(new, path, trained_at=datetime(2024, 1, 2))
    registry.save_models(new, path, trained_at=datetime(2024, 1, 2))
    got = registry.load_models(spark, path)
    assert as_set(got, "sku", "version", "data_points") == {("A", "20240102_000000", 50), ("B", "20240101_000000", 40)}
    assert forecast.forecast(got, horizon=2).count() == 4
    gone = spark.createDataFrame([("A", "W")], "sku string, warehouse_id string")
    assert as_set(registry.without_models(got, gone), *KEY) == {("B", "W")}
    listed = registry.list_models(spark, path)
    assert as_set(listed, "sku", "version", "is_newest") == {
        ("A", "20240101_000000", False), ("A", "20240102_000000", True), ("B", "20240101_000000", True),
    }
    registry.delete_models(spark, path, gone)  # the second version held nothing else
    assert as_set(registry.load_models(spark, path, newest=False), "sku", "version") == {("B", "20240101_000000")}
