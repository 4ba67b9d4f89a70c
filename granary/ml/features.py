"""From the training frame to feature vectors, split by time."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.series import with_cycles, with_next_day_target, with_stock_ratios
from granary.schemas import KEY
from granary.session import materialized

# The model's inputs, in order.
FEATURES = [
    "sales_lag_1", "sales_lag_7", "sales_lag_30",
    "sales_ma_7", "sales_ma_30", "sales_std_30",
    "day_sin", "day_cos", "month_sin", "month_cos",
    "inventory_ratio", "stockout_risk", "value_per_transaction",
    "cv_30", "velocity_value", "avg_inventory", "reorder_point",
]
TEST_DAYS = 60


def time_split(frame: DataFrame, *, test_days: int = TEST_DAYS) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last days of the whole frame are the test.

    The frame, one row per key and day, is written once: both parts and all that is fitted on
    them read it again, and none of them should go back to the ledger.
    """
    frame = materialized(frame)
    cut = F.date_sub(frame.agg(F.max("date")).scalar(), test_days)
    return frame.filter(F.col("date") <= cut), frame.filter(F.col("date") > cut)


def feature_rows(part: DataFrame) -> DataFrame:
    """Features and next-day target of one part of the split; missing features are 0.

    The target stays inside the part, so the last training day does not see the test.
    """
    rows = with_next_day_target(with_stock_ratios(with_cycles(part)))
    return rows.select(
        *KEY, "date", F.col("target").cast("double").alias("target"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES],
    )


def scaling() -> list:
    """Assembler and scaler stages; in a pipeline the scaler is fitted on training rows only."""
    return [
        VectorAssembler(inputCols=FEATURES, outputCol="raw_features"),
        StandardScaler(
            inputCol="raw_features", outputCol="features", withMean=True, withStd=True
        ),
    ]


def feature_matrix(train: DataFrame, part: DataFrame) -> DataFrame:
    """Scaled vectors of `part`, by the mean and deviation of `train`."""
    model = Pipeline(stages=scaling()).fit(train)
    return model.transform(part).select(*KEY, "date", "target", "features")
