"""An extension: the form summary over a stream of submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_summary(stream: DataFrame, form: str, status: Column, at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """For each form and window of event time the submissions, the new ones and the latest; rows later than the watermark are dropped."""
    return (
        stream.withColumn(at, F.col(at).cast("timestamp"))
        .withWatermark(at, late)
        .groupBy(F.window(at, window), F.col(form).alias("form_id"))
        .agg(F.count("*").alias("submission_count"), F.count_if(status).alias("new_count"), F.max(at).alias("latest_submission"))
        .select(F.col("window.start").alias("start"), "form_id", "submission_count", "new_count", "latest_submission")
    )
