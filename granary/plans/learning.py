"""Feature rows, model training, evaluation and forecasts."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from granary.ml import features, forecast, registry, train
from granary.operators import replenishment, series
from granary.plans.registry import query
from granary.plans.series import FRAME, RATIOS, VIEWS, frame, stock_levels
from granary.plans.views import Tables
from granary.schemas import KEY
from granary.session import fresh_dir, materialized

query("time_split", f"""
SELECT sku, warehouse_id, CAST(date AS VARCHAR) AS date,
       CASE WHEN date <= (SELECT max(date) FROM ({FRAME})) - 60 THEN 'train' ELSE 'test' END AS part
FROM ({FRAME})""", views=VIEWS)(
    lambda t: (lambda parts: parts[0].withColumn("part", F.lit("train")).unionByName(
        parts[1].withColumn("part", F.lit("test"))).select(*KEY, "date", "part"))(
        features.time_split(frame(t))
    )
)

EVALUATED = f"""
SELECT CAST(target AS DOUBLE) AS y, CAST(daily_sales AS DOUBLE) AS rf, sales_ma_7 AS gb,
       daily_sales * 0.6E0 + sales_ma_7 * 0.4E0 AS ensemble
FROM (SELECT *, lead(daily_sales) OVER (PARTITION BY sku, warehouse_id ORDER BY date) AS target FROM ({FRAME}))
WHERE target IS NOT NULL"""
_SCORES = " UNION ALL ".join(f"""
SELECT '{m}' AS model, avg(abs(y - {m})) AS mae, sqrt(avg((y - {m}) * (y - {m}))) AS rmse,
       1 - avg((y - {m}) * (y - {m})) / var_pop(y) AS r2, avg(abs((y - {m}) / (y + 1))) * 100 AS mape
FROM ({EVALUATED})""" for m in ("rf", "gb", "ensemble"))


@query("evaluate_models", f"""
WITH s AS ({_SCORES})
SELECT model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(mape, 6) AS mape,
       model = (SELECT arg_min(model, mae) FROM s) AS is_best FROM s""", views=VIEWS)
def _(t: Tables):
    """Two naive predictions, the last day and the moving mean, and their weighted sum."""
    rows = series.with_next_day_target(frame(t)).select(
        "target", F.col("daily_sales").cast("double").alias("rf"), F.col("sales_ma_7").alias("gb")
    )
    return train.evaluate(train.with_ensemble(rows), ["rf", "gb", "ensemble"])


def split_rows(t: Tables):
    before, after = features.time_split(frame(t))
    return features.feature_rows(before), features.feature_rows(after)


_inputs = {c: c for c in features.FEATURES} | {
    "day_sin": "sin(2 * pi() * day_of_week / 7)", "day_cos": "cos(2 * pi() * day_of_week / 7)",
    "month_sin": "sin(2 * pi() * month / 12)", "month_cos": "cos(2 * pi() * month / 12)",
}
# Scaled by the mean and sample deviation of the rows before the last 60 days; a constant input is 0.
MATRIX = f"""
WITH parts AS (SELECT *, date > (SELECT max(date) - 60 FROM ({RATIOS})) AS held_out FROM ({RATIOS})),
rows_of AS (SELECT *, lead(daily_sales) OVER (PARTITION BY sku, warehouse_id, held_out ORDER BY date) AS target FROM parts),
inputs AS (SELECT sku, warehouse_id, date, held_out, target,
  {", ".join(f"CAST(coalesce({sql}, 0) AS DOUBLE) AS {c}" for c, sql in _inputs.items())}
  FROM rows_of WHERE target IS NOT NULL),
seen AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}" for c in _inputs)} FROM inputs WHERE NOT held_out)
SELECT sku, warehouse_id, CAST(date AS VARCHAR) AS date, CAST(target AS DOUBLE) AS target,
  {", ".join(f"round(CASE WHEN d_{c} > 0 THEN ({c} - m_{c}) / d_{c} ELSE 0 END, 6) + 0.0 AS {c}" for c in _inputs)}
FROM inputs, seen WHERE held_out"""


@query("feature_matrix", MATRIX, views=VIEWS)
def _(t: Tables):
    learn, test = split_rows(t)
    vectors = features.feature_matrix(learn, test)
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array("features")
    return vectors.select(
        *KEY, "date", "target",
        *[values[i].alias(name) for i, name in enumerate(features.FEATURES)],
    )


# All dimensions of the grids, with fewer trees: FOREST_GRID and BOOSTED_GRID take minutes on the given tables.
FOREST = train.FOREST_GRID | {"numTrees": [30]}
BOOSTED = train.BOOSTED_GRID | {"maxIter": [10, 20]}


def searched(t: Tables):
    """Both searches over the training rows, and the test rows."""
    learn, test = (materialized(rows) for rows in split_rows(t))
    return train.tune(learn, train.forest, FOREST), train.tune(learn, train.boosted, BOOSTED), test


def scored(tuned: train.Tuned, name: str, test):
    """The errors of the best setting on the test rows, what it is, and its error over the folds."""
    return train.evaluate(train.predict({name: tuned.model}, test), [name]).withColumns({
        "setting": F.lit(json.dumps(tuned.setting, sort_keys=True)), "fold_mae": F.lit(tuned.error), "trials": F.lit(len(tuned.trials)),
    })


@query("train_random_forest")
def _(t: Tables):
    learn, test = (materialized(rows) for rows in split_rows(t))
    return scored(train.tune(learn, train.forest, FOREST), "rf", test)


@query("train_gbt")
def _(t: Tables):
    learn, test = (materialized(rows) for rows in split_rows(t))
    return scored(train.tune(learn, train.boosted, BOOSTED), "gb", test)


@query("ensemble_predict")
def _(t: Tables):
    """Predictions of both tuned models and their weighted sum."""
    rf, gb, test = searched(t)
    return train.with_ensemble(train.predict({"rf": rf.model, "gb": gb.model}, test))


@query("deploy_model")
def _(t: Tables):
    """The better of both tuned models on the test rows, stored with its scaler and read back: its metadata and importances."""
    rf, gb, test = searched(t)
    models = {"rf": rf, "gb": gb}
    errors = train.evaluate(train.predict({n: m.model for n, m in models.items()}, test), list(models)).collect()
    best = next(r for r in errors if r["is_best"])
    path = fresh_dir(t.spark, "deployed")
    version = registry.save_pipeline(
        t.spark, models[best["model"]].model, path, name="demand", trained_at=datetime(2001, 6, 30),
        metrics={m: best[m] for m in ("mae", "rmse", "r2", "mape")}, features=features.FEATURES,
        importances=models[best["model"]].importances(),
    )
    loaded = registry.load_pipeline(path, name="demand", version=version)
    again = train.evaluate(train.predict({best["model"]: loaded}, test), [best["model"]]).select(F.col("mae").alias("mae_read_back"))
    about = registry.load_metadata(t.spark, path, name="demand", version=version)
    return about.select("version", "model_type", "metrics", F.explode("importances").alias("feature", "importance")).join(again)


def daily_demand(t: Tables):
    return series.daily_net_demand(t.tx_dense).withColumnRenamed("day", "date")


# The models, in sums per key and group: `full` multiplicative on all days, `part` additive on the first four fifths.
_DAYS = """
SELECT *, date - min(date) OVER k AS d, count(*) OVER k AS n, row_number() OVER (PARTITION BY sku, warehouse_id ORDER BY date) AS rn
FROM (SELECT sku, warehouse_id, CAST(timestamp AS DATE) AS date, CAST(abs(sum(quantity_change)) AS DOUBLE) AS y FROM tx_dense
      WHERE transaction_type IN ('SALE', 'RETURN') GROUP BY ALL)
WINDOW k AS (PARTITION BY sku, warehouse_id)"""
_BLOCK = "coalesce(sum({r}) FILTER (seen) OVER (PARTITION BY sku, warehouse_id, v, {g}), 0) / (count(*) FILTER (seen) OVER (PARTITION BY sku, warehouse_id, v, {g}) + 1)"
MODELS = f"""
days AS ({_DAYS}),
variant AS (SELECT *, v = 'full' OR rn <= n * 4 // 5 AS seen, isodow(date) - 1 AS g_week, month(date) - 1 AS g_month,
  CAST(floor((d - 30.5E0 * floor(d / 30.5E0)) * 10 / 30.5E0) AS INT) AS g_cycle FROM days, (VALUES ('full'), ('part')) m(v)),
line AS (SELECT sku, warehouse_id, v, regr_slope(y, d) AS slope, regr_intercept(y, d) AS level, avg(abs(y)) AS size
  FROM variant WHERE seen GROUP BY ALL),
based AS (SELECT *, level + slope * d AS base FROM variant JOIN line USING (sku, warehouse_id, v)),
r0 AS (SELECT *, CASE v WHEN 'full' THEN y / greatest(base, size * 0.01E0, 1e-9) - 1 ELSE y - base END AS e0 FROM based),
r1 AS (SELECT *, {_BLOCK.format(r="e0", g="g_week")} AS week FROM r0),
r2 AS (SELECT *, {_BLOCK.format(r="e0 - week", g="g_month")} AS month_of FROM r1),
r3 AS (SELECT *, {_BLOCK.format(r="e0 - week - month_of", g="g_cycle")} AS cycle FROM r2),
fits AS (SELECT *, CASE v WHEN 'full' THEN base * (1 + week + month_of + cycle) ELSE base + week + month_of + cycle END AS fit FROM r3),
models AS (SELECT sku, warehouse_id, any_value(n) AS n, min(date) AS first_day, max(date) AS last_day,
  max(level) FILTER (v = 'full') AS level, max(slope) FILTER (v = 'full') AS slope,
  stddev_pop(y - fit) FILTER (v = 'full') AS deviation,
  avg(abs(y - fit) / greatest(abs(y), {forecast.TINY!r})) FILTER (v = 'part' AND NOT seen) AS mape FROM fits GROUP BY ALL),
report AS (SELECT *, CASE WHEN n >= {forecast.MIN_DAYS} THEN 'success' ELSE 'error' END AS status,
  CASE WHEN n < {forecast.MIN_DAYS} THEN '{forecast.TOO_SHORT}' END AS error FROM models)"""
HORIZON = 30
POINTS = f"""
weeks AS (SELECT DISTINCT sku, warehouse_id, g_week, week FROM fits WHERE v = 'full'),
months AS (SELECT DISTINCT sku, warehouse_id, g_month, month_of FROM fits WHERE v = 'full'),
cycles AS (SELECT DISTINCT sku, warehouse_id, g_cycle, cycle FROM fits WHERE v = 'full'),
ahead AS (SELECT r.*, last_day + CAST(step AS INT) AS date, CAST(step AS INT) AS step, last_day + CAST(step AS INT) - first_day AS d
  FROM report r, range(1, {HORIZON + 1}) h(step) WHERE status = 'success'),
points AS (SELECT a.sku, a.warehouse_id, a.date, a.step, level + slope * d AS base,
  (level + slope * d) * (1 + coalesce(week, 0) + coalesce(month_of, 0) + coalesce(cycle, 0)) AS yhat,
  coalesce(week, 0) + coalesce(month_of, 0) AS seasonality, deviation * {forecast.Z_95!r} AS around
  FROM ahead a LEFT JOIN weeks w ON a.sku = w.sku AND a.warehouse_id = w.warehouse_id AND isodow(a.date) - 1 = g_week
  LEFT JOIN months m ON a.sku = m.sku AND a.warehouse_id = m.warehouse_id AND month(a.date) - 1 = g_month
  LEFT JOIN cycles c ON a.sku = c.sku AND a.warehouse_id = c.warehouse_id
    AND CAST(floor((d - 30.5E0 * floor(d / 30.5E0)) * 10 / 30.5E0) AS INT) = g_cycle)"""


def _digits(name: str, sql: str | None = None) -> str:
    """SQL of both engines for a number to seven significant digits: relative errors of days without demand are huge."""
    x = sql or name
    power = f"pow(CAST(10 AS DOUBLE), floor(log10({x})))"
    return f"CASE WHEN {x} > 0 THEN round({x} / {power}, 6) * {power} ELSE {x} END AS {name}"


def reported(t: Tables):
    """The models, written once, and what happened to each key."""
    models = materialized(forecast.fit_models(daily_demand(t)))
    return models, forecast.training_report(models)


query("batch_train_pairs", f"""
WITH {MODELS}
SELECT sku, warehouse_id, status, error, CAST(n AS INT) AS data_points, CAST(last_day AS VARCHAR) AS last_date,
       {_digits("mape", "CASE status WHEN 'success' THEN mape END")} FROM report""", views="tx_dense")(
    lambda t: forecast.training_report(forecast.fit_models(daily_demand(t))).select(
        *KEY, "status", "error", "data_points", "last_date", F.expr(_digits("mape"))
    )
)
query("holdout_mape", f"""
WITH {MODELS} SELECT sku, warehouse_id, {_digits("mape")} FROM report WHERE status = 'success'""", views="tx_dense")(
    lambda t: forecast.fit_models(daily_demand(t)).filter("status = 'success'").select(*KEY, F.expr(_digits("mape")))
)


@query("forecast_per_key", f"""
WITH {MODELS}, {POINTS}
SELECT r.sku, r.warehouse_id, r.status, r.error, CAST(p.date AS VARCHAR) AS date, round(yhat, 5) + 0.0 AS yhat,
       round(yhat - around, 5) + 0.0 AS yhat_lower, round(yhat + around, 5) + 0.0 AS yhat_upper, round(base, 5) + 0.0 AS trend,
       round(seasonality, 5) + 0.0 AS seasonality
FROM report r LEFT JOIN points p ON r.sku = p.sku AND r.warehouse_id = p.warehouse_id""", views="tx_dense")
def _(t: Tables):
    """Every key: its days ahead, or the reason why there are none."""
    models, report = reported(t)
    ahead = forecast.forecast(models, horizon=HORIZON)
    values = ("yhat", "yhat_lower", "yhat_upper", "trend", "seasonality")
    return report.select(*KEY, "status", "error").join(ahead, KEY, "left").selectExpr(
        *KEY, "status", "error", "date", *[f"round({v}, 5) + 0.0 AS {v}" for v in values]
    )


@query("save_load_models", f"""
WITH {MODELS},
slots AS (SELECT sku, warehouse_id, 'weekly' AS block, g_week AS slot, week AS effect FROM fits WHERE v = 'full'
  UNION SELECT sku, warehouse_id, 'yearly', g_month, month_of FROM fits WHERE v = 'full'
  UNION SELECT sku, warehouse_id, 'monthly', g_cycle, cycle FROM fits WHERE v = 'full')
SELECT r.sku, r.warehouse_id, '20010630_000000' AS version, status, CAST(n AS INT) AS data_points, block, CAST(slot AS INT) AS slot,
       CASE status WHEN 'success' THEN round(effect, 5) + 0.0 END AS effect,
       CASE status WHEN 'success' THEN round(level, 5) + 0.0 END AS level, CASE status WHEN 'success' THEN round(slope, 5) + 0.0 END AS slope,
       CASE status WHEN 'success' THEN round(deviation, 5) + 0.0 END AS deviation,
       {_digits("mape", "CASE status WHEN 'success' THEN mape END")}
FROM report r JOIN slots s ON r.sku = s.sku AND r.warehouse_id = s.warehouse_id
WHERE status = 'success' AND effect <> 0""", views="tx_dense")
def _(t: Tables):
    """The newest of two stored versions, of the keys that have not been deleted: every coefficient that isn't 0."""
    path = fresh_dir(t.spark, "models")
    daily = daily_demand(t)
    registry.save_models(forecast.fit_models(daily, multiplicative=False), path, trained_at=datetime(2001, 6, 1))
    registry.save_models(forecast.fit_models(daily), path, trained_at=datetime(2001, 6, 30))
    stored = registry.load_models(t.spark, path).filter("status = 'success'")
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).alias("effects")) for b in forecast.BLOCKS])
    each = stored.withColumn("b", F.explode(blocks)).select("*", F.col("b.block").alias("block"), F.posexplode("b.effects").alias("slot", "effect"))
    number = lambda c: f"round({c}, 5) + 0.0 AS {c}"
    return each.filter("effect <> 0").withColumns({"level": F.col("trend")[0], "slope": F.col("trend")[1]}).selectExpr(
        *KEY, "version", "status", "data_points", "block", "slot", *map(number, ("effect", "level", "slope", "deviation")), _digits("mape"),
    )


query("stored_models", f"""
WITH {MODELS}
SELECT sku, warehouse_id, version, status, CAST(n AS INT) AS data_points, CAST(last_day AS VARCHAR) AS last_date, version = '20010630_000000' AS is_newest
FROM report, (VALUES ('20010601_000000'), ('20010630_000000')) x(version) WHERE warehouse_id <> 'WH0'""", views="tx_dense")(
    lambda t: _stored(t)
)


def _stored(t: Tables):
    """The list of all stored models after those of one warehouse have been deleted."""
    path = fresh_dir(t.spark, "models")
    models = materialized(forecast.fit_models(daily_demand(t)))
    for day in (datetime(2001, 6, 1), datetime(2001, 6, 30)):
        registry.save_models(models, path, trained_at=day)
    registry.delete_models(t.spark, path, models.filter("warehouse_id = 'WH0'"))
    return registry.list_models(t.spark, path).select(*KEY, "version", "status", "data_points", "last_date", "is_newest")


@query("replenishment_from_forecast", f"""
WITH {MODELS}, {POINTS},
needs AS (SELECT sku, warehouse_id, sum(CASE WHEN step <= 7 THEN yhat ELSE 0 END) + sum(CASE WHEN step <= 3 THEN yhat + around ELSE 0 END) AS point,
  sqrt(greatest(avg(yhat), 0) * 2 * 365 * 50 / 0.1E0) AS lot, count(*) AS points, round(sum(round(yhat, 2)), 2) AS predicted_demand FROM points GROUP BY ALL),
used AS (SELECT p.*, i.quantity_on_hand AS stock, sum(yhat) OVER (PARTITION BY p.sku, p.warehouse_id ORDER BY step) AS so_far
  FROM points p LEFT JOIN items_dense i ON p.sku = i.sku AND p.warehouse_id = i.warehouse_id),
crossed AS (SELECT sku, warehouse_id, min(date) AS stockout_date FROM used WHERE round(so_far, 9) >= coalesce(stock, 0) GROUP BY ALL),
whole AS (SELECT *, CAST(CASE WHEN round(point, 9) < 0 THEN ceil(round(point, 9)) ELSE floor(round(point, 9)) END AS INT) AS reorder_point FROM needs)
SELECT r.sku, r.warehouse_id, status, error, CAST(points AS INT) AS points, predicted_demand, i.quantity_on_hand AS current_inventory, w.reorder_point,
       greatest(CAST(floor(round(lot, 9)) AS INT), w.reorder_point) AS recommended_order_quantity, CAST(stockout_date AS VARCHAR) AS stockout_date,
       {_digits("model_accuracy", "CASE status WHEN 'success' THEN mape END")}
FROM report r LEFT JOIN whole w ON r.sku = w.sku AND r.warehouse_id = w.warehouse_id
LEFT JOIN crossed c ON r.sku = c.sku AND r.warehouse_id = c.warehouse_id
LEFT JOIN items_dense i ON r.sku = i.sku AND r.warehouse_id = i.warehouse_id AND status = 'success'""",
       views="tx_dense items_dense")
def _(t: Tables):
    """Every key: its plan with the points and the accuracy of its model, or the reason why there is none."""
    models, report = reported(t)
    ahead = materialized(forecast.forecast(models, horizon=HORIZON))
    plan = replenishment.with_points(replenishment.replenishment_plan(ahead, stock_levels(t)), ahead)
    full = report.select(*KEY, "status", "error", F.col("mape").alias("model_accuracy")).join(plan, KEY, "left")
    predicted = F.aggregate("predictions", F.lit(0.0), lambda total, p: total + p["predicted_demand"].cast("double"))
    return full.withColumns({
        "points": F.when(F.col("predictions").isNotNull(), F.size("predictions")),
        "predicted_demand": F.when(F.col("predictions").isNotNull(), F.round(predicted, 2)),
    }).selectExpr(
        *KEY, "status", "error", "points", "predicted_demand", "current_inventory", "reorder_point", "recommended_order_quantity", "stockout_date",
        _digits("model_accuracy"),
    )
