"""Ground truth: labels on windows, episodes, and the split by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators.features import assign_windows


def align(labels: DataFrame, windows: DataFrame, window_seconds: int, slide_seconds: int, least_fraction: float = 0.25) -> DataFrame:
    """Windows (machine_id, window_start in epoch seconds, sample_count) with their share of anomalous samples and episode."""
    spread = assign_windows(labels.where("is_anomaly"), window_seconds, slide_seconds)
    found = spread.groupBy("machine_id", "window_start").agg(
        F.count(F.lit(1)).cast("double").alias("anomalous_samples"), F.min_by("episode_id", "event_time").alias("episode_id"),
        F.min_by("anomaly_type", "event_time").alias("anomaly_type"),
    )
    joined = windows.join(found, ["machine_id", "window_start"], "left").withColumn("anomalous_samples", F.coalesce("anomalous_samples", F.lit(0.0)))
    fraction = F.when(F.col("sample_count") > 0, F.col("anomalous_samples") / F.col("sample_count")).otherwise(0.0)
    return joined.withColumn("anomaly_fraction", fraction).withColumn("is_anomaly", F.col("anomaly_fraction") >= least_fraction)


def episode_table(labels: DataFrame) -> DataFrame:
    rows = labels.where(F.col("is_anomaly") & F.col("episode_id").isNotNull())
    return rows.groupBy("episode_id").agg(
        F.min_by("machine_id", "event_time").alias("machine_id"), F.min_by("anomaly_type", "event_time").alias("anomaly_type"),
        F.min("event_time").alias("started_at"), F.max("event_time").alias("ended_at"), F.count(F.lit(1)).alias("labelled_samples"),
    ).withColumn("duration_seconds", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6)


def time_slice(rows: DataFrame, time: str, start, end) -> DataFrame:
    """Rows from ``start`` up to, not including, ``end``."""
    return rows.where((F.col(time) >= start) & (F.col(time) < end))


def temporal_split(samples: DataFrame, train_hours: float = 28, validation_hours: float = 38) -> DataFrame:
    """Samples with ``split``: train, validation or test by hours since the first event.

    The cut comes before any windowing, so that no window straddles it.
    """
    first = samples.agg(F.min("event_time").alias("_first"))
    hours = (F.unix_micros("event_time") - F.unix_micros("_first")) / 3.6e9
    split = F.when(hours < train_hours, "train").when(hours < validation_hours, "validation").otherwise("test")
    return samples.crossJoin(F.broadcast(first)).withColumn("split", split).drop("_first")  # one row


def split_summary(windows: DataFrame) -> DataFrame:
    """Per split: windows, machines, hours, anomalous windows, prevalence, episodes and span of window starts (epoch seconds)."""
    return windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("machine_id").alias("machines"),
        ((F.max("window_start") - F.min("window_start")) / 3600.0).alias("hours"), F.count_if("is_anomaly").alias("anomalous"),
        F.avg(F.col("is_anomaly").cast("double")).alias("prevalence"), F.count_distinct("episode_id").alias("episodes"),
        F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"),
    )
