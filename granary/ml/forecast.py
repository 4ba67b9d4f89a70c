"""Seasonal demand forecasts, one small model per key, out of sums over its days.

The ledger is first summed to one row per key and day, so a key has at most one row per day of history. A model is a line
through the days and, one after the other, the effects of the weekday, of the month of the year and of the tenth of a
30.5-day cycle. Each block of effects is the ridge regression of what the blocks before it have left. Its inputs exclude each
other, so its normal equations are diagonal: an effect is the sum of its days' residuals over their number plus the penalty. All
of it is sums per key and group in the JVM; models are rows of coefficients, fitted, stored and applied as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.schemas import KEY

# Least history, interval, share of the days that the hold-out error's model sees, ridge penalty, days of the
# monthly cycle and its parts, and the smallest denominator of a relative error.
MIN_DAYS = 30
Z_95 = 1.959963984540054
TRAIN_TENTHS = 8
RIDGE = 1.0
CYCLE = 30.5
PHASES = 10
TINY = 2.220446049250313e-16
TOO_SHORT = "Insufficient historical data"

#: The blocks in the order in which they are fitted, with their sizes; monthly effects are no reported seasonality.
BLOCKS = {"weekly": 7, "yearly": 12, "monthly": PHASES}
REPORTED = ("weekly", "yearly")

MODEL_SCHEMA = (
    "sku string, warehouse_id string, status string, error string, data_points int, "
    "first_date date, last_date date, multiplicative boolean, trend array<double>, "
    "weekly array<double>, yearly array<double>, monthly array<double>, deviation double, mape double"
)


def _groups(date: Column, day: Column) -> dict[str, Column]:
    """Which effect of each block a day has, from 0."""
    return {
        "weekly": F.weekday(date),
        "yearly": F.month(date) - 1,
        "monthly": F.floor(F.pmod(day.cast("double"), F.lit(CYCLE)) * F.lit(float(PHASES)) / F.lit(CYCLE)).cast("int"),
    }


def _fitted(days: DataFrame, name: str, seen: Column, multiplicative: bool) -> DataFrame:
    """Add the model of the days that are `seen`, as columns that begin with `name`: the line, the effect that each block has
    on the day, and the fitted value of every day, seen or not."""
    whole = W.partitionBy(*KEY)
    y, day = F.when(seen, F.col("_y")), F.col("_day")
    out = days.withColumns({
        f"{name}_slope": F.regr_slope(y, day).over(whole),
        f"{name}_level": F.regr_intercept(y, day).over(whole),
        f"{name}_floor": F.greatest(F.avg(F.abs(y)).over(whole) * 0.01, F.lit(1e-9)),
    }).withColumn(f"{name}_base", F.col(f"{name}_level") + F.col(f"{name}_slope") * day)
    base = F.col(f"{name}_base")
    rest = F.col("_y") / F.greatest(base, F.col(f"{name}_floor")) - 1 if multiplicative else F.col("_y") - base
    out = out.withColumn(f"{name}_rest", rest)
    for block in BLOCKS:
        group = W.partitionBy(*KEY, f"_{block}")
        left = F.when(seen, F.col(f"{name}_rest"))
        effect = F.coalesce(F.sum(left).over(group), F.lit(0.0)) / (F.count(left).over(group) + F.lit(RIDGE))
        out = out.withColumn(f"{name}_{block}", effect).withColumn(f"{name}_rest", F.col(f"{name}_rest") - F.col(f"{name}_{block}"))
    effects = sum((F.col(f"{name}_{b}") for b in BLOCKS), F.lit(0.0))
    return out.withColumn(f"{name}_fit", base * (1 + effects) if multiplicative else base + effects)


def fit_models(daily: DataFrame, *, multiplicative: bool = True) -> DataFrame:
    """One row of coefficients per key of (sku, warehouse_id, date, demand), with the mean relative error, on the last fifth
    of the days, of an additive model that has not seen them.

    A key with too few days gets status "error" and the reason. Rows without a date or a demand are left out.
    """
    whole = W.partitionBy(*KEY)
    days = daily.select(
        *KEY, F.to_date("date").alias("date"), F.col("demand").cast("double").alias("_y")
    ).filter("date is not null and _y is not null").withColumns({
        "_first": F.min("date").over(whole), "_n": F.count(F.lit(1)).over(whole),
        "_at": F.row_number().over(whole.orderBy("date")),
    }).withColumn("_day", F.date_diff("date", "_first"))
    days = days.withColumns({f"_{b}": g for b, g in _groups(F.col("date"), F.col("_day")).items()})
    early = F.col("_at") <= F.expr(f"_n * {TRAIN_TENTHS} div 10")
    fitted = _fitted(_fitted(days, "_all", F.lit(True), multiplicative), "_part", early, False)
    miss = F.when(~early, F.abs(F.col("_y") - F.col("_part_fit")) / F.greatest(F.abs("_y"), F.lit(TINY)))

    def effects(block: str) -> Column:
        one = [F.coalesce(F.max(F.when(F.col(f"_{block}") == k, F.col(f"_all_{block}"))), F.lit(0.0)) for k in range(BLOCKS[block])]
        return F.array(*one).alias(block)

    models = fitted.groupBy(*KEY).agg(
        F.count(F.lit(1)).cast("int").alias("data_points"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.array(F.max("_all_level"), F.max("_all_slope")).alias("trend"),
        *[effects(b) for b in BLOCKS],
        F.stddev_pop(F.col("_y") - F.col("_all_fit")).alias("deviation"),
        F.avg(miss).alias("mape"),
    )
    enough = F.col("data_points") >= MIN_DAYS
    known = lambda c: F.when(enough, F.col(c)).alias(c)
    return models.select(
        *KEY,
        F.when(enough, "success").otherwise("error").alias("status"),
        F.when(~enough, TOO_SHORT).alias("error"),
        "data_points", "first_date", "last_date", F.lit(multiplicative).alias("multiplicative"),
        *[known(c) for c in ("trend", *BLOCKS, "deviation", "mape")],
    )


def forecast(models: DataFrame, *, horizon: int = 30) -> DataFrame:
    """The days after each key's last date, with a 95 % interval: (key, date, yhat, yhat_lower, yhat_upper, trend,
    seasonality)."""
    ahead = models.filter(F.col("status") == "success").withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = ahead.withColumn("date", F.date_add("last_date", F.col("_step"))).withColumn("_day", F.date_diff("date", "first_date"))
    effect = {b: F.col(b)[g] for b, g in _groups(F.col("date"), F.col("_day")).items()}
    base = F.col("trend")[0] + F.col("trend")[1] * F.col("_day")
    every = sum(effect.values(), F.lit(0.0))
    yhat = F.when(F.col("multiplicative"), base * (1 + every)).otherwise(base + every)
    around = F.col("deviation") * Z_95
    return ahead.select(
        *KEY, "date", yhat.alias("yhat"), (yhat - around).alias("yhat_lower"), (yhat + around).alias("yhat_upper"),
        base.alias("trend"), sum((effect[b] for b in REPORTED), F.lit(0.0)).alias("seasonality"),
    )


def training_report(models: DataFrame) -> DataFrame:
    """What happened to each key: samples, hold-out error, or why it failed."""
    return models.select(*KEY, "status", "error", "data_points", "mape", "last_date")
