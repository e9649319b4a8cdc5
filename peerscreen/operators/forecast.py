"""Final-value forecasts in fractions of the limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import quiet

BASELINES = ["persistence", "linear_extrapolation"]


def persistence() -> Column:
    return F.greatest(F.col("limit_fraction"), F.lit(0.0))


def linear_extrapolation() -> Column:
    ahead = F.col("limit_fraction") + F.col("slope_fraction_per_hour") * (S.TARGET_HOUR - S.AS_OF_HOUR)
    return F.greatest(ahead, F.lit(0.0))


def baseline(name: str) -> Column:
    return {"persistence": persistence, "linear_extrapolation": linear_extrapolation}[name]()


def gate(pred: Column, z: float = S.GATE_Z) -> Column:
    """Quiet parts keep the persistence forecast."""
    return F.when(quiet(z), persistence()).otherwise(pred)


TARGETS = ["normalized", "log1p_normalized", "residual_over_persistence", "log1p_residual_over_persistence"]


def encode_target(y: Column, target: str) -> Column:
    """What the learner fits; residual targets subtract the persistence offset."""
    if target not in TARGETS:
        raise ValueError(f"unknown target {target}")
    y = F.log1p(y) if target.startswith("log1p") else y
    return y - offset(target)


def offset(target: str) -> Column:
    if not target.endswith("residual_over_persistence"):
        return F.lit(0.0)
    base = F.col("limit_fraction")
    return F.log1p(base) if target.startswith("log1p") else base


def decode_prediction(raw: Column, target: str) -> Column:
    """Learner output back to limit fractions, never negative, no upper clipping."""
    total = raw + offset(target)
    return F.greatest(F.expm1(total) if target.startswith("log1p") else total, F.lit(0.0))


def joined_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with final_value and y = final / limit; y is NULL where the label is missing or bad."""
    final = F.col("final_value").cast("double")
    good = F.when(final >= 0, final)
    slim = labels.select(*S.KEY4, good.alias("final_value"))
    return features.join(slim, S.KEY4, "left").withColumn("y", F.try_divide(F.col("final_value"), F.col("upper_limit")))


def in_units(df: DataFrame, forecast: str = "forecast") -> DataFrame:
    """Forecast and bounds from limit fractions to measurement units."""
    limit = F.col("upper_limit")
    return df.withColumns(
        {
            "predicted_final_value": F.col(forecast) * limit,
            "prediction_lower": F.col("lower") * limit,
            "prediction_upper": F.col("upper") * limit,
        }
    )
