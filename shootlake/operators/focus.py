"""Focus verdicts: which frames are soft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blur past which a frame reads as soft, and the least judgeable share of a frame.
BLUR_THRESHOLD = 1.1
MINIMUM_JUDGEABLE = 0.08


def verdict(blur: Column, judgeable: Column, threshold: float = BLUR_THRESHOLD,
            minimum: float = MINIMUM_JUDGEABLE) -> Column:
    unknown = blur.isNull() | (F.coalesce(judgeable, F.lit(0.0)) < minimum)
    return F.when(unknown, "unknown").when(blur > threshold, "soft").otherwise("sharp")


def description(blur: Column, judgeable: Column, measured: Column) -> Column:
    """A phrase about one report; null where no report exists."""
    v = verdict(blur, judgeable)
    phrase = (F.when(v == "unknown", F.lit("focus unclear"))
              .when(v == "soft", F.format_string("soft · blur %.1f px", blur))
              .otherwise(F.format_string("sharp · blur %.2f px", blur)))
    return F.when(measured, phrase)


def with_verdicts(reports: DataFrame, **limits: float) -> DataFrame:
    return reports.withColumn("verdict", verdict(F.col("blur"), F.col("judgeable"), **limits))


def soft(reports: DataFrame, **limits: float) -> DataFrame:
    return with_verdicts(reports, **limits).where("verdict = 'soft'")


def counts(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Photos, measured photos and soft photos per key; counts combine map-side."""
    return with_verdicts(reports).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("photos"),
        F.count_if(F.col("blur").isNotNull()).alias("measured"),
        F.count_if(F.col("verdict") == "soft").alias("soft"))
