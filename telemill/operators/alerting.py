"""Batch alerting: runs of anomalous windows, episodes, and the alert rows they open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.functions import scalars as S
from telemill.operators.policy import severity


def strongest(rows: DataFrame, arrival: str) -> DataFrame:
    """One row per machine and window: the highest score, the first arrival among equals."""
    n = F.row_number().over(W.partitionBy("machine_id", "window_start").orderBy(F.desc("anomaly_score"), arrival))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


SPAN = 7 * 86_400  # seconds of a machine's history that one task orders at a time


def runs_in_days(rows: DataFrame, keys: list[str], starts: Column, name: str = "_run", time: str = "window_start", span: int = SPAN) -> DataFrame:
    """Gaps and islands per key: ``starts`` (may use ``_gap``, seconds since the row before) opens a new run.

    A key's history is cut into spans of time, each ordered on its own. What a span must know of those before it, the last time and
    the number of runs so far, comes from a row per key and span, so a long history of one key is no single task.
    """
    cut = F.floor(F.col(time) / span)
    w = W.partitionBy(*keys, "_span").orderBy(time)
    spans = W.partitionBy(*keys).orderBy("_span")  # over a row per span
    rows = rows.withColumn("_span", cut)
    ends = rows.groupBy(*keys, "_span").agg(F.max(time).alias("_end"))
    ends = ends.select(*keys, "_span", F.lag("_end").over(spans).alias("_before"))
    opened = F.when(F.col("_gap").isNull() | starts, 1).otherwise(0)
    rows = rows.join(ends, [*keys, "_span"]).withColumn("_gap", F.col(time) - F.coalesce(F.lag(time).over(w), "_before")).withColumn("_open", opened)
    counts = rows.groupBy(*keys, "_span").agg(F.sum("_open").alias("_n"))
    counts = counts.select(*keys, "_span", F.coalesce(F.sum("_n").over(spans.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_so_far"))
    inside = F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.join(counts, [*keys, "_span"]).withColumn(name, inside + F.col("_so_far")).drop("_span", "_before", "_gap", "_open", "_so_far")


def number_runs(rows: DataFrame, starts: Column, name: str = "run_id") -> DataFrame:
    """Runs per machine, numbered in order of time (see ``runs_in_days``)."""
    return runs_in_days(rows, ["machine_id"], starts, name)


def alert_events(scored: DataFrame, threshold: Column | float, slide_seconds: int, least: int = 2) -> DataFrame:
    """Runs of adjoining windows over the threshold, at least ``least`` long (the offline rule)."""
    over = scored.where(F.col("score") >= threshold).select("machine_id", "window_start", "score")
    runs = number_runs(over, F.col("_gap") != slide_seconds)
    return runs.groupBy("machine_id", "run_id").agg(
        F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"), F.count(F.lit(1)).alias("windows"),
        F.max("score").alias("max_score"),
    ).where(F.col("windows") >= least).drop("run_id")


def episode_alerts(anomalous: DataFrame, gap_seconds: int = 120, open_after: int = 2) -> DataFrame:
    """The rows that open an alert (the online rule): the ``open_after``-th window of each episode.

    An episode ends with a silence of more than ``gap_seconds``. ``window_start`` is in epoch seconds; a row per window.
    """
    runs = number_runs(anomalous, F.col("_gap") > gap_seconds, "episode")
    n = F.row_number().over(W.partitionBy("machine_id", "episode").orderBy("window_start"))
    return runs.withColumn("consecutive_windows", n).where(F.col("consecutive_windows") == open_after)


def alert_rows(opening: DataFrame, published_at: Column) -> DataFrame:
    """Alerts of opening windows (``window_start`` and ``window_end`` as timestamps) with their derived identifiers."""
    return opening.select(
        S.alert_id(F.col("machine_id"), F.col("window_start"), F.col("model_name"), F.col("model_version")).alias("alert_id"),
        "machine_id", "line_id", severity(F.col("anomaly_score"), F.col("score_threshold")).alias("severity"), F.lit("NEW").alias("status"),
        "anomaly_score", "score_threshold", F.col("window_end").alias("detected_at"), "window_start", "window_end",
        published_at.alias("published_at"), "consecutive_windows", "model_name", "model_version",
    )


def latest_emission(rows: DataFrame, offset: str = "offset") -> DataFrame:
    """The last emission of each window."""
    n = F.row_number().over(W.partitionBy("machine_id", "window_start").orderBy(F.desc(offset)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def out_of_order(samples: DataFrame, order: str, time: str = "event_time") -> DataFrame:
    """Samples whose time lies before one that came earlier from the same machine.

    Offsets are cut into blocks; a block starts with the latest time of the blocks before it.
    """
    rows = samples.withColumn("_block", F.floor(F.col(order) / 100_000))
    blocks = rows.groupBy("machine_id", "_block").agg(F.max(time).alias("_last"))
    earlier = W.partitionBy("machine_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # over a row per block
    blocks = blocks.select("machine_id", "_block", F.max("_last").over(earlier).alias("_from"))
    before = W.partitionBy("machine_id", "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(blocks, ["machine_id", "_block"]).withColumn("_most", F.greatest(F.max(time).over(before), "_from"))
    return rows.where(F.col(time) < F.col("_most")).drop("_most", "_from", "_block")
